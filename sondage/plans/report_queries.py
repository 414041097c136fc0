"""Named queries for reports, calibration scores and run selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.operators import evaluate, feasibility, irt, redundancy, report, responses, shift, skiplogic
from sondage.plans import population_queries as pop
from sondage.plans import shift_queries as sq
from sondage.plans import skiplogic_queries as skip
from sondage.plans import views as v
from sondage.plans.fit_sql import add_fit_views
from sondage.plans.registry import query, rnd, sql_case, sql_in, sql_list, sql_signed2, with_views
from sondage.session import cut_lineage

V = v.VIEWS
V["base_items"] = f"""
SELECT r.run_id, r.persona_id, r.question_id AS item, r.value FROM responses r JOIN questions q USING (run_id, question_id)
WHERE r.paraphrase_idx = 0 AND r.value IS NOT NULL AND q.type IN {sql_in(config.ORDINAL_TYPES)}"""
V["base_binary"] = """
SELECT b.run_id, b.persona_id, b.item, CASE WHEN b.value > m.med THEN 1 ELSE 0 END AS y FROM base_items b
JOIN (SELECT run_id, item, median(value) AS med FROM base_items GROUP BY 1, 2) m USING (run_id, item)"""
FITTED = ["base_items", "base_binary", *add_fit_views(V, "fitted", "base_binary")]
_RANK = lambda c: f"coalesce(list_position({sql_list(config.SEVERITIES)}, {c}), 1)"
V["severities"] = f"""
SELECT q.run_id, q.question_id, q.position, q.type, s.severity AS shift_severity, p.severity AS irt_severity,
  {sql_list(config.SEVERITIES)}[greatest({_RANK('s.severity')}, {_RANK('p.severity')})] AS severity
FROM questions q LEFT JOIN shift_flags s USING (run_id, question_id) LEFT JOIN fitted p USING (run_id, question_id)"""
SEVERITY = [*sq.FLAGS, *FITTED, "severities"]


def discrimination_flags(items, questions):
    """Flags of the real fit; the variance proxy stands in only where it did not converge. Too small runs have none."""
    names = questions.select("run_id", "position", F.col("question_id").alias("item"))
    binary = irt.dichotomize(items.join(names, ["run_id", "position"]).select("run_id", "persona_id", "item", "value"))
    return irt.irt_flags(irt.fit_discrimination(binary))


def answers_once(spark, sf_dir):
    """The answers, read and brought up to date once for all analyses of a report."""
    return cut_lineage(v.responses(spark, sf_dir))


def fitted_flags(answers, questions):
    return discrimination_flags(redundancy.baseline_items(answers, questions), questions)


def severities(spark, sf_dir):
    answers, asked = answers_once(spark, sf_dir), v.questions(spark)
    return report.question_severity(asked, shift.shift_flags(answers, asked), fitted_flags(answers, asked))


@query("question_severity", skip.recursive(SEVERITY, "SELECT * FROM severities"))
def question_severity(spark, sf_dir):
    return severities(spark, sf_dir)


@query("report_exposure", skip.recursive(SEVERITY, """
SELECT run_id, count(*) FILTER (severity = 'high') AS high_severity_questions, count(*) FILTER (severity = 'medium') AS medium_severity_questions,
  count(*) FILTER (severity IN ('high', 'medium')) AS flagged_question_count FROM severities GROUP BY 1"""))
def report_exposure(spark, sf_dir):
    return report.report_exposure(severities(spark, sf_dir))


_FIRST = ["all", "young_women", "graduates", "unknown_state"]


def _survey_level(spark, sf_dir):
    """Screener findings and quota flags of all surveys and audiences, keyed by run."""
    found = skiplogic.skip_logic_flags(skip.skip_questions(spark, sf_dir), skip.rules(spark, sf_dir))
    screener = found.withColumn("run_id", F.concat(F.lit("r"), F.col("survey_id") % 2))
    shares = feasibility.quota_share(pop.population(spark, sf_dir), pop.audiences(spark), pop.cells(spark))
    quota = pop.cell_text(feasibility.quota_feasibility(shares)).select(
        F.when(F.col("audience_id").isin(_FIRST), "r0").otherwise("r1").alias("run_id"), "audience_id", "cell_id", "cell", "pct", "severity", "summary"
    )
    return screener, quota


def _redundant(answers, questions):
    return redundancy.redundancy_flags(redundancy.redundancy_pairs(redundancy.baseline_items(answers, questions)), questions)


V["pair_flags"] = f"""
SELECT run_id, qa AS q_id_a, qb AS q_id_b, CASE WHEN abs(r) >= {config.PEARSON_HIGH} THEN 'high' ELSE 'medium' END AS severity,
  qa || ' and ' || qb || CASE WHEN abs(r) >= {config.PEARSON_HIGH} THEN ' measure ' || CASE WHEN r > 0 THEN 'the same' ELSE 'opposite' END
    || ' thing (' || {sql_signed2('r')} || '); drop one' ELSE ' are correlated ' || {sql_signed2('r')} END AS summary FROM (
  SELECT a.run_id, qa.question_id AS qa, qb.question_id AS qb, corr(a.value, b.value) AS r
  FROM base_items a JOIN base_items b ON a.run_id = b.run_id AND a.persona_id = b.persona_id
  JOIN questions qa ON qa.run_id = a.run_id AND qa.question_id = a.item JOIN questions qb ON qb.run_id = b.run_id AND qb.question_id = b.item
  WHERE qa.position < qb.position GROUP BY 1, 2, 3
  HAVING count(*) >= {config.MIN_PAIRS} AND stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0) WHERE abs(r) >= {config.PEARSON_MED}"""


@query("report_findings", skip.recursive([*SEVERITY, "pair_flags", *skip.SKIP, *pop.SHARES, "quota_flags"], f"""
SELECT run_id, NULL::VARCHAR AS survey_id, 'paraphrase_shift' AS kind, question_id AS subject, severity, {sq.SHIFT_SUMMARY} AS summary FROM shift_flags
UNION ALL SELECT run_id, NULL, 'discrimination', question_id, severity, summary FROM fitted
UNION ALL SELECT run_id, NULL, 'redundant_pair', q_id_a || '|' || q_id_b, severity, summary FROM pair_flags
UNION ALL SELECT 'r' || survey_id % 2, survey_id::VARCHAR, 'screener', flag || '|' || subject || '|' || detail, 'high',
  'question ' || subject || ' ' || {sql_case('flag', skiplogic.SUMMARIES)} FROM skip_flags
UNION ALL SELECT CASE WHEN audience_id IN {sql_in(_FIRST)} THEN 'r0' ELSE 'r1' END, audience_id, 'quota', cell_id, severity, summary FROM quota_flags"""))
def report_findings(spark, sf_dir):
    screener, quota = _survey_level(spark, sf_dir)
    answers, asked = answers_once(spark, sf_dir), v.questions(spark)
    return report.report_findings(
        shift.shift_flags(answers, asked), _redundant(answers, asked), screener, quota, fitted_flags(answers, asked))


def report_cards(spark, sf_dir):
    """Every run's report, a document per sheet."""
    screener, quota = _survey_level(spark, sf_dir)
    answers = answers_once(spark, sf_dir)
    asked = v.questions(spark).withColumn("text", F.concat(F.lit("How was the "), F.col("question_id"), F.lit("?")))
    return report.report_cards(
        asked, shift.shift_flags(answers, asked), fitted_flags(answers, asked), _redundant(answers, asked), screener, quota,
        examples=shift.flag_examples(responses.matched_histogram(answers), asked),
    )


_CARD = """struct<run_id: string, sheet: int, per_question: array<struct<position: int, question_id: string, question_text: string, type: string, severity: string,
  paraphrase_shift: struct<severity: string, summary: string, examples: array<struct<paraphrase_idx: int, n: long>>>, irt: struct<severity: string, summary: string>>>,
  redundancy_pairs: array<struct<q_id_a: string, q_id_b: string, severity: string, summary: string>>,
  screener_issues: array<struct<survey_id: string, flag: string, subject: string, detail: string, summary: string>>,
  quota_feasibility: array<struct<audience_id: string, cell_id: string, severity: string, summary: string>>,
  estimated_panel_exposure: struct<high_severity_questions: long, medium_severity_questions: long, flagged_question_count: long>>"""


@query("report_card", skip.recursive([*SEVERITY, "pair_flags", *skip.SKIP, *pop.SHARES, "quota_flags"], f"""
SELECT s.run_id, 'question' AS section, s.position || '|' || s.question_id AS subject, s.severity,
  concat_ws('|', 'How was the ' || s.question_id || '?', s.type, f.severity, f.summary, i.severity, i.summary) AS body
FROM severities s LEFT JOIN (SELECT *, {sq.SHIFT_SUMMARY} AS summary FROM shift_flags) f USING (run_id, question_id) LEFT JOIN fitted i USING (run_id, question_id)
UNION ALL SELECT run_id, 'redundancy_pairs', q_id_a || '|' || q_id_b, severity, summary FROM pair_flags
UNION ALL SELECT 'r' || survey_id % 2, 'screener_issues', survey_id || '|' || flag || '|' || subject || '|' || detail, NULL,
  'question ' || subject || ' ' || {sql_case('flag', skiplogic.SUMMARIES)} FROM skip_flags
UNION ALL SELECT CASE WHEN audience_id IN {sql_in(_FIRST)} THEN 'r0' ELSE 'r1' END, 'quota_feasibility', audience_id || '|' || cell_id, severity, summary FROM quota_flags
UNION ALL SELECT run_id, 'exposure', count(*) FILTER (severity = 'high') || '|' || count(*) FILTER (severity = 'medium') || '|'
  || count(*) FILTER (severity IN ('high', 'medium')), NULL, NULL FROM severities GROUP BY run_id"""))
def report_card(spark, sf_dir):
    """The reports' documents, each sheet read again: a row for each question, pair, issue, cell and for the counts."""
    card = cut_lineage(report_cards(spark, sf_dir)).select(F.from_json("report", _CARD).alias("c")).select("c.*")
    text = lambda x, *columns: F.concat_ws("|", *[x[c].cast("string") for c in columns])
    row = lambda section, subject, severity, body: F.struct(
        F.lit(section).alias("section"), subject.alias("subject"), severity.cast("string").alias("severity"), body.cast("string").alias("body"))
    each = lambda section, subject, severity=lambda x: x["severity"], body=lambda x: x["summary"]: F.transform(
        section, lambda x: row(section, text(x, *subject), severity(x), body(x)))
    none = F.lit(None)
    asked = F.transform("per_question", lambda q: row("question", text(q, "position", "question_id"), q["severity"], F.concat_ws(
        "|", q["question_text"], q["type"], q["paraphrase_shift"]["severity"], q["paraphrase_shift"]["summary"], q["irt"]["severity"], q["irt"]["summary"])))
    totals = F.col("estimated_panel_exposure")
    counted = row("exposure", text(totals, "high_severity_questions", "medium_severity_questions", "flagged_question_count"), none, none)
    rows = F.concat(
        asked, each("redundancy_pairs", ("q_id_a", "q_id_b")),
        each("screener_issues", ("survey_id", "flag", "subject", "detail"), lambda x: none),
        each("quota_feasibility", ("audience_id", "cell_id")),
        F.filter(F.array(F.when(totals.isNotNull(), counted)), lambda x: x.isNotNull()))
    return card.select("run_id", F.explode(rows).alias("x")).select("run_id", "x.*")


V["base_pairs"] = f"""
SELECT a.run_id FROM base_items a JOIN base_items b ON a.run_id = b.run_id AND a.persona_id = b.persona_id AND a.item < b.item
GROUP BY a.run_id, a.item, b.item
HAVING count(*) >= {config.MIN_PAIRS} AND stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0
   AND abs(corr(a.value, b.value)) >= {config.PEARSON_MED}"""
OBSERVED = [*SEVERITY, "base_pairs", *skip.SKIP, *pop.SHARES, "quota_flags"]


@query("observed_classes", skip.recursive(OBSERVED, f"""
SELECT run_id, defect_class, count(*) AS flags FROM (
  SELECT run_id, 'leading_wording' AS defect_class FROM shift_flags WHERE severity IN ('medium', 'high')
  UNION ALL SELECT run_id, 'double_barreled' FROM fitted WHERE severity IN ('medium', 'high')
  UNION ALL SELECT DISTINCT run_id, 'redundant_pair' FROM base_pairs
  UNION ALL SELECT DISTINCT 'r' || survey_id % 2, 'infeasible_screener' FROM skip_flags
  UNION ALL SELECT DISTINCT CASE WHEN audience_id IN {sql_in(_FIRST)} THEN 'r0' ELSE 'r1' END, 'infeasible_screener' FROM quota_flags
    WHERE severity IN ('medium', 'high')) GROUP BY 1, 2"""))
def observed_classes(spark, sf_dir):
    screener, quota = _survey_level(spark, sf_dir)
    answers, asked = answers_once(spark, sf_dir), v.questions(spark)
    bag = evaluate.observed_classes(
        shift.shift_flags(answers, asked), fitted_flags(answers, asked), _redundant(answers, asked), screener, quota
    )
    return bag.groupBy("run_id", "defect_class").agg(F.count(F.lit(1)).alias("flags"))


# --- labelled outcomes, from documents and labels ---------------------------
_CLASSES = config.DEFECT_CLASSES
V["outcomes"] = f"""
SELECT doc_id AS survey_id, source, CASE WHEN doc_id % 7 > 0 THEN {sql_list(_CLASSES)}[doc_id % 7] END AS expected_class,
  CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'obvious' WHEN quality = 1 THEN 'subtle' ELSE 'moderate' END AS severity,
  list_concat(CASE WHEN coalesce(quality, 1) = 1 AND doc_id % 7 > 0 AND n_chars % 4 > 0 THEN [{sql_list(_CLASSES)}[doc_id % 7]] ELSE []::VARCHAR[] END,
    CASE WHEN n_chars % 5 = 0 THEN ['leading_wording'] ELSE []::VARCHAR[] END,
    CASE WHEN n_chars % 6 = 0 THEN ['double_barreled', 'double_barreled'] ELSE []::VARCHAR[] END,
    CASE WHEN lang = 'fr' AND n_chars % 3 = 0 THEN ['infeasible_screener'] ELSE []::VARCHAR[] END) AS observed
FROM documents LEFT JOIN labels USING (doc_id)"""
V["sev_outcomes"] = """
SELECT *, CASE WHEN expected_class IS NULL THEN 'subtle' ELSE coalesce(severity, 'moderate') END AS sev FROM outcomes"""
V["tally"] = """
SELECT defect_class, severity, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
  SELECT expected_class AS defect_class, sev AS severity, CASE WHEN list_contains(observed, expected_class) THEN 1 ELSE 0 END AS tp, 0 AS fp,
         CASE WHEN list_contains(observed, expected_class) THEN 0 ELSE 1 END AS fn FROM sev_outcomes WHERE expected_class IS NOT NULL
  UNION ALL
  SELECT c, sev, 0, 1, 0 FROM (SELECT sev, expected_class, unnest(observed) AS c FROM sev_outcomes)
  WHERE expected_class IS NULL OR c <> expected_class) GROUP BY 1, 2"""
TALLY = ["outcomes", "sev_outcomes", "tally"]
_PR = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1"""
V["grid"] = f"""
SELECT g.c AS defect_class, g.s AS severity, coalesce(t.tp, 0) AS tp, coalesce(t.fp, 0) AS fp, coalesce(t.fn, 0) AS fn
FROM (SELECT c, s FROM (SELECT unnest({sql_list(_CLASSES)}) AS c), (SELECT unnest({sql_list(config.DEFECT_SEVERITIES)}) AS s)) g
LEFT JOIN tally t ON t.defect_class = g.c AND t.severity = g.s"""
V["class_scores"] = f"""
SELECT 'class' AS level, defect_class, 'ALL' AS severity, tp, fp, fn, {_PR} FROM (
  SELECT defect_class, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM grid GROUP BY 1)"""


def outcomes(spark, sf_dir):
    expected = F.when(
        F.col("doc_id") % 7 > 0, F.get(F.array(*[F.lit(c) for c in _CLASSES]), (F.col("doc_id") % 7 - 1).cast("int"))
    )
    severity = (
        F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, "obvious")
        .when(F.col("quality") == 1, "subtle").otherwise("moderate")
    )
    n, none = F.col("n_chars"), F.array().cast("array<string>")
    some = lambda test, *names: F.when(test, F.array(*names)).otherwise(none)
    seen = F.concat(
        some((F.coalesce("quality", F.lit(1)) == 1) & expected.isNotNull() & (n % 4 > 0), expected),
        some(n % 5 == 0, F.lit("leading_wording")),
        some(n % 6 == 0, F.lit("double_barreled"), F.lit("double_barreled")),
        some((F.col("lang") == "fr") & (n % 3 == 0), F.lit("infeasible_screener")),
    )
    docs = v.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(v.table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("survey_id"), "source", expected.alias("expected_class"), severity.alias("severity"), seen.alias("observed")
    )


@query("calibration_tally", with_views(V, TALLY, "SELECT * FROM tally"))
def calibration_tally(spark, sf_dir):
    return evaluate.tally(outcomes(spark, sf_dir))


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("calibration_f1", with_views(V, [*TALLY, "grid", "class_scores"], f"""
SELECT level, defect_class, severity, tp, fp, fn, {rnd('precision')} AS precision, {rnd('recall')} AS recall, {rnd('f1')} AS f1 FROM (
  SELECT 'cell' AS level, defect_class, severity, tp, fp, fn, {_PR} FROM grid UNION ALL SELECT * FROM class_scores UNION ALL
  SELECT 'overall', 'ALL', 'ALL', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, avg(precision), avg(recall), avg(f1) FROM class_scores)"""))
def calibration_f1(spark, sf_dir):
    return _rounded(evaluate.calibration_f1(spark, evaluate.tally(outcomes(spark, sf_dir))), "precision", "recall", "f1")


@query("f1_regression", with_views(V, ["outcomes", "sev_outcomes"], f"""
SELECT revision, completed_at, {rnd('f1_overall')} AS f1_overall, {rnd('change')} AS change, coalesce(change < -{config.F1_DROP_GATE}, false) AS regressed FROM (
  SELECT *, f1_overall - lag(f1_overall) OVER (ORDER BY completed_at, revision) AS change FROM (
    SELECT source AS revision, substr(source, 4)::INT AS completed_at,
      sum(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END) / {len(_CLASSES)} AS f1_overall
    FROM (SELECT source, defect_class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
      SELECT source, expected_class AS defect_class, CASE WHEN list_contains(observed, expected_class) THEN 1 ELSE 0 END AS tp, 0 AS fp,
        CASE WHEN list_contains(observed, expected_class) THEN 0 ELSE 1 END AS fn FROM sev_outcomes WHERE expected_class IS NOT NULL
      UNION ALL SELECT source, c, 0, 1, 0 FROM (SELECT source, expected_class, unnest(observed) AS c FROM sev_outcomes)
      WHERE expected_class IS NULL OR c <> expected_class) GROUP BY 1, 2) GROUP BY 1))"""))
def f1_regression(spark, sf_dir):
    by_revision = evaluate.macro_f1(evaluate.tally(outcomes(spark, sf_dir), ("source",)), ("source",))
    history = by_revision.select(
        F.col("source").alias("revision"), F.substring("source", 4, 9).cast("int").alias("completed_at"), "f1_overall"
    )
    return _rounded(evaluate.f1_regression(history), "f1_overall", "change")


# --- run tables, from orders ------------------------------------------------
_STATUS = config.STATUS_PRIORITY
V["runs"] = f"""
SELECT o_orderkey AS run_id, o_custkey AS survey_id, {sql_list(_STATUS)}[1 + o_orderkey % 7] AS status, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 7 IN (0, 6) THEN o_orderdate + to_days((o_orderkey % 30)::INT) END AS completed_at, o_orderpriority AS batch FROM orders"""


def runs(spark, sf_dir):
    key = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(s) for s in _STATUS]), (key % 7).cast("int"))
    later = F.col("o_orderdate") + F.make_dt_interval((key % 30).cast("int"))
    return v.table(spark, sf_dir, "orders").select(
        key.alias("run_id"), F.col("o_custkey").alias("survey_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when((key % 7).isin(0, 6), later).alias("completed_at"), F.col("o_orderpriority").alias("batch"),
    )


@query("latest_runs", with_views(V, ["runs"], f"""
SELECT run_id, survey_id, status FROM runs WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, run_id DESC LIMIT {config.HISTORY_LENGTH}"""))
def latest_runs(spark, sf_dir):
    return report.latest_runs(runs(spark, sf_dir)).select("run_id", "survey_id", "status")


@query("best_run_per_survey", with_views(V, ["runs"], f"""
SELECT survey_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY survey_id
  ORDER BY list_position({sql_list(_STATUS)}, status), completed_at DESC NULLS FIRST, created_at DESC, run_id) AS rn FROM runs) WHERE rn = 1"""))
def best_run_per_survey(spark, sf_dir):
    return report.best_run_per_survey(runs(spark, sf_dir))


@query("dedupe_oldest", with_views(V, ["runs"], """
SELECT survey_id, max(CASE WHEN a = 1 THEN run_id END) AS canonical_run, max(CASE WHEN status = 'completed' AND b = 1 THEN run_id END) AS completed_run,
  max(CASE WHEN status NOT IN ('completed', 'failed') AND c = 1 THEN run_id END) AS in_flight_run FROM (
  SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY created_at, run_id) AS a,
    row_number() OVER (PARTITION BY survey_id, status ORDER BY completed_at DESC, run_id DESC) AS b,
    row_number() OVER (PARTITION BY survey_id, status IN ('completed', 'failed') ORDER BY created_at DESC, run_id DESC) AS c FROM runs) GROUP BY 1"""))
def dedupe_oldest(spark, sf_dir):
    return report.run_choices(runs(spark, sf_dir))


@query("seed_status", with_views(V, ["runs"], """
SELECT batch, count(*) AS seeded, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'completed') >= count(*) AS all_completed FROM runs GROUP BY 1"""))
def seed_status(spark, sf_dir):
    return report.seed_status(runs(spark, sf_dir), ("batch",))
