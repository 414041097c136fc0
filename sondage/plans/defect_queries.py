"""Named queries for planted defects: corpus, injectors and perturbed responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.operators import inject
from sondage.plans import views as v
from sondage.plans.registry import query, sql_bits, sql_case, sql_gauss, sql_in, sql_list, sql_uniform, with_views
from sondage.session import cut_lineage

V = v.VIEWS
SEED = config.SEED
_KINDS = {"STANDARD": "likert_5", "PROMO": "nps", "ECONOMY": "likert_7", "MEDIUM": "single_choice", "LARGE": "top_box", "SMALL": "open_end"}
V["instrument"] = f"""
SELECT 's' || p_partkey // 12 AS survey_id, 'Q' || p_partkey AS question_id, (p_partkey % 12)::INT AS position,
  CASE WHEN (p_partkey // 12) % 29 = 3 THEN 'open_end' ELSE {sql_case('p_type', _KINDS)} END AS type,
  CASE p_size % 3 WHEN 0 THEN 'How satisfied are you with the ' || p_name || '?'
    WHEN 1 THEN 'Likely or not, how important and likely is ' || p_name || '?' ELSE 'Rate the ' || p_name || '?' END AS text FROM part"""


def instrument(spark, sf_dir):
    key = F.col("p_partkey")
    block = F.floor(key / 12)
    kind = F.lit(None).cast("string")
    for name, t in _KINDS.items():
        kind = F.when(F.col("p_type") == name, t).otherwise(kind)
    text = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("How satisfied are you with the "), F.col("p_name"), F.lit("?")))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("Likely or not, how important and likely is "), F.col("p_name"), F.lit("?")))
        .otherwise(F.concat(F.lit("Rate the "), F.col("p_name"), F.lit("?")))
    )
    return v.table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), block).alias("survey_id"), F.concat(F.lit("Q"), key).alias("question_id"),
        (key % 12).cast("int").alias("position"), F.when(block % 29 == 3, "open_end").otherwise(kind).alias("type"), text.alias("text"),
    )


def _target_sql(defect, severity):
    return f"""SELECT survey_id, question_id AS target, position AS target_pos FROM (
      SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY md5('{SEED}|{defect}|{severity}|' || survey_id || '|' || question_id), question_id) AS rn
      FROM instrument WHERE type IN {sql_in(config.ORDINAL_TYPES)}) WHERE rn = 1"""


def _pick_sql(options, purpose, severity):
    return f"{sql_list(options)}[1 + {sql_bits(str(SEED), chr(39) + purpose + chr(39), chr(39) + severity + chr(39), 's.survey_id')} % {len(options)}]"


_BARE = "rtrim(text, '?')"
_LOW = lambda x: f"(lower(substr({x}, 1, 1)) || substr({x}, 2))"


def _new_text(defect, severity):
    if defect == "leading_wording":
        return f"{_pick_sql(config.LEADING_PREFIXES[severity], 'prefix', severity)} || {_LOW(_BARE)} || '?'"
    if defect == "double_barreled":
        return f"{_BARE} || ' and ' || {_pick_sql(config.EXTRA_FACETS[severity], 'facet', severity)} || '?'"
    return f"{_BARE} || {_pick_sql(config.LOADED_PHRASES[severity], 'phrase', severity)} || '?'"


def _clone_text(severity):
    pairs = config.SYNONYMS[severity]
    usable = "list_filter([" + ", ".join(
        f"CASE WHEN contains(lower(text), '{a}') THEN replace(replace(text, '{a}', '{b}'), '{a.capitalize()}', '{b.capitalize()}') END"
        for a, b in pairs
    ) + "], lambda x: x IS NOT NULL)"
    bits = sql_bits(str(SEED), "'synonym'", f"'{severity}'", "s.survey_id")
    return f"CASE WHEN len({usable}) > 0 THEN {usable}[1 + {bits} % greatest(len({usable}), 1)] ELSE '{config.CLONE_PREFIX[severity]}' || {_LOW('text')} END"


def inject_sql(defect, severity):
    base = "instrument s"
    if defect in inject.REWRITES:
        base += f" LEFT JOIN ({_target_sql(defect, severity)}) t ON t.survey_id = s.survey_id"
    hit = "coalesce(s.question_id = t.target, false)"
    if defect in ("leading_wording", "double_barreled", "loaded_language"):
        return f"""SELECT s.survey_id, s.question_id, s.position, s.type,
          CASE WHEN {hit} THEN {_new_text(defect, severity)} ELSE s.text END AS text, {hit} AS planted FROM {base}"""
    if defect == "redundant_pair":
        return f"""SELECT s.survey_id, s.question_id, s.position + CASE WHEN s.position > t.target_pos THEN 1 ELSE 0 END AS position,
          s.type, s.text, {hit} AS planted FROM {base} UNION ALL
          SELECT s.survey_id, s.question_id || '_redundant', s.position + 1, s.type, {_clone_text(severity)}, true FROM {base} WHERE {hit}"""
    plain = "SELECT survey_id, question_id, position, type, text, false AS planted FROM instrument"
    if defect != "fatigue_block":
        return plain
    size = config.FATIGUE_SIZE[severity]
    return f"""{plain} UNION ALL SELECT survey_id, 'FAT_' || lpad((rn - 1)::VARCHAR, 2, '0'), (n + rn - 1)::INT, 'likert_5',
      'On a scale of 1 to 5, how would you rate the brand on ' || a || '?', true FROM (
      SELECT survey_id, n, a, row_number() OVER (PARTITION BY survey_id ORDER BY md5('{SEED}|{severity}|' || survey_id || '|' || a), a) AS rn
      FROM (SELECT survey_id, max(position) + 1 AS n FROM instrument GROUP BY 1), (SELECT unnest({sql_list(config.FATIGUE_ATTRIBUTES)}) AS a)) WHERE rn <= {size}"""


def _register(name, defect, severity):
    @query(name, with_views(V, ["instrument"], inject_sql(defect, severity)))
    def run(spark, sf_dir):
        return inject.inject(instrument(spark, sf_dir), defect, severity)

    return run


inject_leading = _register("inject_leading", "leading_wording", "moderate")
inject_double_barreled = _register("inject_double_barreled", "double_barreled", "obvious")
inject_loaded = _register("inject_loaded", "loaded_language", "subtle")
inject_redundant = _register("inject_redundant", "redundant_pair", "subtle")
inject_fatigue = _register("inject_fatigue", "fatigue_block", "moderate")


@query("inject_quota", with_views(V, ["instrument"], " UNION ALL ".join(
    f"SELECT DISTINCT survey_id, '{s}' AS severity, '"
    + ",".join(f"{k}={config.INFEASIBLE_CELLS[s][k]}" for k in sorted(config.INFEASIBLE_CELLS[s]))
    + f"' AS cell, {config.INFEASIBLE_TARGET_N} AS target_n FROM instrument"
    for s in config.DEFECT_SEVERITIES
)))
def inject_quota(spark, sf_dir):
    from sondage.plans.population_queries import cell_text

    surveys = instrument(spark, sf_dir).select("survey_id").distinct()
    out = None
    for severity in config.DEFECT_SEVERITIES:
        part = inject.inject_quota(surveys, severity).withColumn("severity", F.lit(severity))
        out = part if out is None else out.unionByName(part)
    return cell_text(out)


@query("inject_fanout", with_views(V, ["instrument"], "SELECT 'clean' AS defect_class, 'none' AS severity, * FROM ("
    + inject_sql("clean", "none") + ") " + " ".join(
        f"UNION ALL SELECT '{d}', '{s}', * FROM ({inject_sql(d, s)})" for d, s in inject.VARIANTS)))
def inject_fanout(spark, sf_dir):
    return inject.fan_out(instrument(spark, sf_dir))


@query("inject_notes", with_views(V, ["instrument"], " UNION ALL ".join(
    f"""SELECT x.survey_id, '{d}' AS defect_class, '{s}' AS severity, {'t.target' if d in inject.REWRITES else 'NULL'} AS affected,
    {"CASE WHEN t.target IS NULL THEN 'no eligible ordinal question' END" if d in inject.REWRITES else 'NULL'} AS note
    FROM (SELECT DISTINCT survey_id FROM instrument) x """
    + (f"LEFT JOIN ({_target_sql(d, s)}) t USING (survey_id)" if d in inject.REWRITES else "")
    for d, s in inject.VARIANTS)))
def inject_notes(spark, sf_dir):
    return inject.fan_out_notes(instrument(spark, sf_dir))


_CATS, _SUBJ = list(config.CORPUS_SUBJECTS), list(config.CORPUS_SUBJECTS.values())
V["corpus_ids"] = f"""
SELECT s_suppkey AS idx, {sql_list(_CATS)}[1 + s_suppkey % {len(_CATS)}] AS category, {sql_list(_SUBJ)}[1 + s_suppkey % {len(_CATS)}] AS subject FROM supplier"""
_NUM = lambda options, purpose: f"{sql_list(options)}[1 + {sql_bits('7', chr(39) + purpose + chr(39), 'idx')} % {len(options)}]::INT"


@query("corpus_expand", with_views(V, ["corpus_ids"], " UNION ALL ".join(
    f"""SELECT 'clean-' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END || '-' || category AS survey_id,
    {_NUM(config.CORPUS_AGE_MIN, 'age_min')} AS age_min, {_NUM(config.CORPUS_AGE_MAX, 'age_max')} AS age_max,
    {_NUM(config.CORPUS_INCOME_MIN, 'income_min')} AS income_min, {i} AS position, '{q}' AS question_id, '{t}' AS type,
    replace(replace('{text}', '{{subject}}', subject), '{{category}}', replace(category, '_', ' ')) AS text FROM corpus_ids"""
    for i, (q, t, text) in enumerate(config.CORPUS_QUESTIONS))))
def corpus_expand(spark, sf_dir):
    ids = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"))
    return inject.clean_corpus(spark, ids)


# --- perturbed responses ----------------------------------------------------
RESP = ["raw_responses", "responses"]
_CLIP = lambda x, lo, hi: f"greatest({lo}, least({hi}, round_even({x}, 0)))"
_KEYED = "run_id", "persona_id", "question_id", "paraphrase_idx"


def _perturb(name, defect, question, lo, hi, expr):
    @query(name, with_views(V, RESP, f"""
    SELECT run_id, persona_id, question_id, paraphrase_idx,
      CASE WHEN question_id = '{question}' AND value IS NOT NULL THEN ({expr})::DOUBLE ELSE value END AS value FROM responses"""))
    def run(spark, sf_dir):
        rows = v.responses(spark, sf_dir).withColumn("affected", F.col("question_id") == question)
        return inject.perturb(rows, defect, F.lit(float(lo)), F.lit(float(hi))).drop("affected")

    return run


perturb_shift = _perturb(
    "perturb_shift", "shift", "click", 1, 5,
    f"CASE WHEN paraphrase_idx = 0 THEN {_CLIP(f'value + {config.SHIFT_FRACTION}::DOUBLE * 2.0', 1, 5)} ELSE value END",
)
perturb_dilute = _perturb(
    "perturb_dilute", "dilute", "view", 1, 7,
    "coalesce(lag(value) OVER (PARTITION BY run_id, question_id, paraphrase_idx, value IS NULL ORDER BY "
    f"{sql_uniform(str(SEED), chr(39) + 'dilute' + chr(39), *_KEYED)}, persona_id), value)"
)
perturb_concentrate = _perturb(
    "perturb_concentrate", "concentrate", "purchase", 0, 5, _CLIP(f"2.5 + {config.MIDDLE_SHARE}::DOUBLE * (value - 2.5)", 0, 5),
)


@query("perturb_correlate", with_views(V, RESP, f"""
SELECT r.run_id, r.persona_id, r.question_id, r.paraphrase_idx, CASE WHEN l.a IS NOT NULL AND r.value IS NOT NULL THEN
  {_CLIP(f"{config.TARGET_CORRELATION}::DOUBLE * (l.a - m.mean) + m.mean + sqrt(1 - {config.TARGET_CORRELATION}::DOUBLE * {config.TARGET_CORRELATION}::DOUBLE) * {config.CORRELATION_NOISE}::DOUBLE * "
         + sql_gauss(str(SEED), "'noise'", "r.run_id", "r.persona_id"), 1, 5)}::DOUBLE ELSE r.value END AS value
FROM responses r
LEFT JOIN (SELECT run_id, persona_id, value AS a FROM responses WHERE question_id = 'click' AND paraphrase_idx = 0 AND value IS NOT NULL) l
  ON l.run_id = r.run_id AND l.persona_id = r.persona_id AND r.question_id = 'view' AND r.paraphrase_idx = 0
LEFT JOIN (SELECT a.run_id, avg(a.value) AS mean FROM responses a JOIN responses b USING (run_id, persona_id)
  WHERE a.question_id = 'click' AND b.question_id = 'view' AND a.paraphrase_idx = 0 AND b.paraphrase_idx = 0
    AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1) m ON m.run_id = r.run_id"""))
def perturb_correlate(spark, sf_dir):
    return inject.perturb_correlate(v.responses(spark, sf_dir), "click", "view")


# --- quota cells of planted variants, against the population -----------------
def _cell_sql(cell):
    tests = []
    for key, value in cell.items():
        if key == "age_bucket":
            lo, hi = config.AGE_BUCKETS[value]
            tests.append(f"AGEP BETWEEN {lo} AND {hi}")
        elif key == "state":
            tests.append(f"ST = {next(code for code, usps in config.STATES.items() if usps == value)}")
        elif key == "income_bracket":
            lo, hi = config.INCOME_BRACKETS[value]
            tests.append(f"PINCP >= {lo} AND PINCP < '{hi}'::DOUBLE")
    return " AND ".join(tests)


_NOTABLE = lambda c: f"(100 * coalesce({c}, 0) / total < {config.QUOTA_MARGINAL_PCT})"
V["survey_reach"] = f"""
SELECT survey_id, sum(PWGTP)::DOUBLE AS total, sum(PWGTP) FILTER (SEX = 1) AS own, {', '.join(
    f"sum(PWGTP) FILTER ({_cell_sql(config.INFEASIBLE_CELLS[s])}) AS {s}" for s in config.DEFECT_SEVERITIES)}
FROM (SELECT DISTINCT survey_id, substr(survey_id, 2)::INT AS k FROM instrument) s
JOIN population p ON p.AGEP BETWEEN 18 + s.k % 10 AND 40 + s.k % 25 GROUP BY 1"""


@query("calibration_quota", with_views(V, ["instrument", "population", "survey_reach"], " UNION ALL ".join(
    f"SELECT survey_id, '{d}' AS defect_class, '{s}' AS severity, {_NOTABLE('own')}"
    + (f" OR {_NOTABLE(s)}" if d == "infeasible_screener" else "") + " AS flagged FROM survey_reach"
    for d, s in [("clean", "none"), *inject.VARIANTS])))
def calibration_quota(spark, sf_dir):
    """Which of a survey's nineteen variants the quota analysis flags."""
    from sondage.operators import calibrate
    from sondage.plans.population_queries import population

    questions = instrument(spark, sf_dir)
    k = F.substring("survey_id", 2, 9).cast("int")
    surveys = cut_lineage(questions.select("survey_id").distinct())
    audiences = surveys.select(
        F.col("survey_id").alias("audience_id"), (18 + k % 10).alias("age_min"), (40 + k % 25).alias("age_max"),
        F.array(F.lit("any")).alias("genders"), F.lit(None).cast("int").alias("income_min"), F.lit(None).cast("int").alias("income_max"),
        F.lit("any").alias("education_min"), F.array().cast("array<string>").alias("states"),
    )
    quotas = surveys.select(
        F.col("survey_id").alias("audience_id"), F.lit("q0").alias("cell_id"), F.create_map(F.lit("gender"), F.lit("male")).alias("cell"),
        F.lit(100).alias("target_n"),
    )
    runs = calibrate.variant_runs(surveys)
    flags = calibrate.variant_quota_flags(runs, population(spark, sf_dir), audiences, quotas)
    worst = flags.groupBy("run_id").agg(F.max(F.col("severity").isin("medium", "high")).alias("flagged"))
    return runs.join(worst, "run_id").drop("run_id")
