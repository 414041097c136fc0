"""Named queries over recorded responses: matched panels and wording shift."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.operators import free_values, responses as resp
from sondage.operators import shift
from sondage.plans import views as v
from sondage.plans.registry import query, rnd, sql_fixed2, sql_in, sql_list, with_views

V = v.VIEWS
V["wordings"] = "SELECT run_id, question_id, count(DISTINCT paraphrase_idx) AS nk FROM responses GROUP BY 1, 2"
V["panel"] = """
SELECT r.run_id, r.question_id, r.persona_id, count(*) AS n_variants
FROM responses r JOIN wordings w USING (run_id, question_id)
GROUP BY 1, 2, 3, w.nk HAVING count(*) = w.nk"""
V["matched"] = "SELECT r.* FROM responses r JOIN panel p USING (run_id, question_id, persona_id)"
V["means"] = """
SELECT run_id, question_id, paraphrase_idx, avg(value) AS mean, count(value) AS n, var_samp(value) AS variance
FROM matched WHERE value IS NOT NULL GROUP BY 1, 2, 3"""
V["counts"] = """
SELECT run_id, question_id, paraphrase_idx, value, count(*)::DOUBLE AS n FROM matched
WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4"""
V["pairs"] = """
SELECT b.run_id, b.question_id, b.paraphrase_idx, a.n::DOUBLE AS n0, b.n::DOUBLE AS nk,
       CASE WHEN (a.variance + b.variance) / 2 > 0
            THEN (a.mean - b.mean) / sqrt((a.variance + b.variance) / 2) END AS cohens_d
FROM means a JOIN means b USING (run_id, question_id) WHERE a.paraphrase_idx = 0 AND b.paraphrase_idx <> 0"""
V["support"] = "SELECT DISTINCT run_id, question_id, value FROM counts"
V["cdf"] = """
SELECT p.run_id, p.question_id, p.paraphrase_idx, s.value, p.n0, p.nk,
       sum(coalesce(a.n, 0) * p.nk - coalesce(b.n, 0) * p.n0)
         OVER (PARTITION BY p.run_id, p.question_id, p.paraphrase_idx ORDER BY s.value) AS diff,
       lead(s.value) OVER (PARTITION BY p.run_id, p.question_id, p.paraphrase_idx ORDER BY s.value) - s.value AS gap
FROM pairs p JOIN support s USING (run_id, question_id)
LEFT JOIN counts a ON a.run_id = p.run_id AND a.question_id = p.question_id AND a.paraphrase_idx = 0 AND a.value = s.value
LEFT JOIN counts b ON b.run_id = p.run_id AND b.question_id = p.question_id
                  AND b.paraphrase_idx = p.paraphrase_idx AND b.value = s.value"""
V["w1"] = """
SELECT run_id, question_id, paraphrase_idx, coalesce(sum(abs(diff) * gap), 0) / any_value(n0 * nk) AS w
FROM cdf GROUP BY 1, 2, 3"""
V["ordinal"] = "SELECT w1.*, p.cohens_d FROM w1 JOIN pairs p USING (run_id, question_id, paraphrase_idx)"
V["worst"] = """
SELECT q.run_id, q.question_id, coalesce(x.w, 0.0) AS score, x.paraphrase_idx AS worst_idx, x.cohens_d
FROM (SELECT DISTINCT run_id, question_id FROM ordinal) q LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY run_id, question_id ORDER BY w DESC, paraphrase_idx) AS rn
  FROM ordinal WHERE w > 0) x ON x.run_id = q.run_id AND x.question_id = q.question_id AND x.rn = 1"""
V["shares"] = """
SELECT run_id, question_id, paraphrase_idx, c, n, n / sum(n) OVER (PARTITION BY run_id, question_id, paraphrase_idx) AS share
FROM (SELECT c.run_id, c.question_id, c.paraphrase_idx, trunc(c.value)::BIGINT AS c, sum(c.n) AS n
      FROM counts c JOIN questions q USING (run_id, question_id)
      WHERE trunc(c.value) >= 0 AND trunc(c.value) < q.n_options GROUP BY 1, 2, 3, 4)"""
V["js"] = """
SELECT run_id, question_id, paraphrase_idx,
  sqrt(greatest(sum((CASE WHEN f > 0 THEN f * ln(2 * f / (f + g)) ELSE 0 END)
                  + (CASE WHEN g > 0 THEN g * ln(2 * g / (f + g)) ELSE 0 END)) / 2, 0)) AS js,
  sum(abs(f - g)) / 2 AS tv
FROM (
  SELECT k.run_id, k.question_id, k.paraphrase_idx, o.c, coalesce(a.share, 0) AS f, coalesce(b.share, 0) AS g
  FROM (SELECT DISTINCT s.run_id, s.question_id, s.paraphrase_idx FROM shares s
        WHERE s.paraphrase_idx <> 0 AND EXISTS (SELECT 1 FROM shares z WHERE z.run_id = s.run_id
              AND z.question_id = s.question_id AND z.paraphrase_idx = 0)) k
  JOIN (SELECT DISTINCT run_id, question_id, c FROM shares) o USING (run_id, question_id)
  LEFT JOIN shares a ON a.run_id = k.run_id AND a.question_id = k.question_id AND a.paraphrase_idx = 0 AND a.c = o.c
  LEFT JOIN shares b ON b.run_id = k.run_id AND b.question_id = k.question_id
                    AND b.paraphrase_idx = k.paraphrase_idx AND b.c = o.c)
GROUP BY 1, 2, 3"""
BASE = ["raw_responses", "responses", "questions", "wordings", "panel", "matched", "means", "counts"]
ORDINAL = [*BASE, "pairs", "support", "cdf", "w1", "ordinal", "worst"]
CHOICE = [*BASE, "shares", "js"]
_LADDER = lambda high, med: f"""
  CASE WHEN score >= {high} AND abs(coalesce(d, 0)) >= {config.COHENS_D_HIGH} THEN 'high'
       WHEN score >= {med} OR abs(coalesce(d, 0)) >= {config.COHENS_D_MED} THEN 'medium'
       WHEN score > 0 THEN 'low' ELSE 'none' END"""
V["flag_inputs"] = f"""
SELECT q.*, coalesce(m.n_matched, 0) AS n_matched, w.score AS w_score, w.cohens_d AS d0, j.js_score,
       x.mean_original, x.mean_variants,
       EXISTS (SELECT 1 FROM shares s WHERE s.run_id = q.run_id AND s.question_id = q.question_id
               AND s.paraphrase_idx = 0) AS has_choice,
       q.type IN {sql_in(config.ORDINAL_TYPES)} AS ordinal, q.type = 'single_choice' AS single
FROM questions q
LEFT JOIN (SELECT run_id, question_id, count(*) AS n_matched FROM panel GROUP BY 1, 2) m USING (run_id, question_id)
LEFT JOIN worst w USING (run_id, question_id)
LEFT JOIN (SELECT run_id, question_id, max(js) AS js_score FROM js GROUP BY 1, 2) j USING (run_id, question_id)
LEFT JOIN (SELECT run_id, question_id, max(CASE WHEN paraphrase_idx = 0 THEN mean END) AS mean_original,
                  avg(CASE WHEN paraphrase_idx <> 0 THEN mean END) AS mean_variants
           FROM means GROUP BY 1, 2) x USING (run_id, question_id)"""
V["flag_notes"] = f"""
SELECT *, CASE WHEN type IN {sql_in(config.SKIP_TYPES)} THEN 'paraphrase shift not computed for type=' || type
  WHEN n_matched < 5 THEN 'insufficient matched personas across paraphrases'
  WHEN ordinal AND mean_original IS NULL THEN 'no original responses available'
  WHEN single AND NOT (has_choice AND n_options > 0) THEN 'no options or no original responses'
  WHEN NOT ordinal AND NOT single THEN 'shift analysis not implemented for type=' || type END AS note
FROM flag_inputs"""
V["flag_scores"] = """
SELECT *, CASE WHEN note IS NOT NULL THEN 0.0 WHEN ordinal THEN coalesce(w_score, 0.0)
               ELSE coalesce(js_score, 0.0) END AS score,
       CASE WHEN note IS NULL AND ordinal THEN d0 END AS d FROM flag_notes"""
V["shift_flags"] = f"""
SELECT *, CASE WHEN note IS NOT NULL THEN 'skipped' WHEN ordinal THEN 'wasserstein' ELSE 'jensen_shannon' END AS metric,
       CASE WHEN type IN {sql_in(config.SKIP_TYPES)} THEN 0 ELSE n_matched END AS n_personas,
       CASE WHEN note IS NOT NULL THEN 'none'
            WHEN ordinal THEN {_LADDER(config.WASSERSTEIN_HIGH, config.WASSERSTEIN_MED)}
            ELSE {_LADDER(config.JS_HIGH, config.JS_MED)} END AS severity
FROM flag_scores"""
FLAGS = [*ORDINAL, "shares", "js", "flag_inputs", "flag_notes", "flag_scores", "shift_flags"]
FLAG_COLUMNS = f"run_id, question_id, type, metric, {rnd('score')} AS score, {rnd('d')} AS cohens_d, n_personas, severity, note"


def _hist(spark, sf_dir):
    return resp.matched_histogram(v.responses(spark, sf_dir))


def flags(spark, sf_dir):
    return shift.shift_flags(v.responses(spark, sf_dir), v.questions(spark))


def flag_columns(df):
    return df.select(
        "run_id", "question_id", "type", "metric", F.round("score", 6).alias("score"),
        F.round("cohens_d", 6).alias("cohens_d"), "n_personas", "severity", "note",
    )


@query("responses_upsert", with_views(V, ["raw_responses", "responses"], "SELECT * FROM responses"))
def responses_upsert(spark, sf_dir):
    return v.responses(spark, sf_dir)


@query("matched_panel", with_views(V, BASE[:5], "SELECT * FROM panel"))
def matched_panel(spark, sf_dir):
    return resp.matched_panel(v.responses(spark, sf_dir))


@query(
    "variant_means",
    with_views(V, BASE, f"SELECT run_id, question_id, paraphrase_idx, {rnd('mean')} AS mean, n FROM means"),
)
def variant_means(spark, sf_dir):
    return shift.shift_examples(_hist(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(
    "wasserstein_shift",
    with_views(V, ORDINAL, f"SELECT run_id, question_id, paraphrase_idx, {rnd('w')} AS wasserstein FROM w1"),
)
def wasserstein_shift(spark, sf_dir):
    return shift.ordinal_shift(_hist(spark, sf_dir)).drop("cohens_d").withColumn("wasserstein", F.round("wasserstein", 6))


@query(
    "cohens_d",
    with_views(V, ORDINAL, f"SELECT run_id, question_id, paraphrase_idx, {rnd('cohens_d')} AS cohens_d FROM pairs"),
)
def cohens_d(spark, sf_dir):
    return shift.ordinal_shift(_hist(spark, sf_dir)).drop("wasserstein").withColumn("cohens_d", F.round("cohens_d", 6))


@query(
    "shift_worst",
    with_views(V, ORDINAL, f"SELECT run_id, question_id, {rnd('score')} AS score, worst_idx, {rnd('cohens_d')} AS cohens_d FROM worst"),
)
def shift_worst(spark, sf_dir):
    worst = shift.worst_variant(shift.ordinal_shift(_hist(spark, sf_dir)))
    return worst.withColumn("score", F.round("score", 6)).withColumn("cohens_d", F.round("cohens_d", 6))


@query("shift_flags", with_views(V, FLAGS, f"SELECT {FLAG_COLUMNS} FROM shift_flags"))
def shift_flags(spark, sf_dir):
    return flag_columns(flags(spark, sf_dir))


_ORD, _CAT = shift.ORDINAL_VERDICTS, shift.CHOICE_VERDICTS
_POS = f"list_position({sql_list(config.SEVERITIES)}, severity)"
SHIFT_SUMMARY = f"""CASE WHEN note IS NOT NULL THEN ''
  WHEN ordinal AND mean_original - mean_variants IS NULL THEN ''
  WHEN ordinal THEN (CASE WHEN mean_original > mean_variants THEN 'inflates' ELSE 'deflates' END) || ' mean by '
    || {sql_fixed2('abs(mean_original - mean_variants)')} || ' (' || {sql_fixed2('mean_original')} || ' vs '
    || {sql_fixed2('mean_variants')} || '): ' || {sql_list(_ORD)}[{_POS}]
  ELSE 'distance ' || {sql_fixed2('score')} || ': ' || {sql_list(_CAT)}[{_POS}] END"""


@query("flag_summaries", with_views(V, FLAGS, f"SELECT run_id, question_id, {SHIFT_SUMMARY} AS summary FROM shift_flags"))
def flag_summaries(spark, sf_dir):
    return flags(spark, sf_dir).select("run_id", "question_id", "summary")


@query("js_shift", with_views(V, CHOICE, f"SELECT run_id, question_id, paraphrase_idx, {rnd('js')} AS js FROM js"))
def js_shift(spark, sf_dir):
    out = shift.choice_distances(_hist(spark, sf_dir), v.questions(spark))
    return out.select("run_id", "question_id", "paraphrase_idx", F.round("js", 6).alias("js"))


@query("tv_shift", with_views(V, CHOICE, f"SELECT run_id, question_id, paraphrase_idx, {rnd('tv')} AS tv FROM js"))
def tv_shift(spark, sf_dir):
    out = shift.choice_distances(_hist(spark, sf_dir), v.questions(spark))
    return out.select("run_id", "question_id", "paraphrase_idx", F.round("tv", 6).alias("tv"))


@query(
    "modal_choice",
    with_views(V, CHOICE, """SELECT run_id, question_id, paraphrase_idx, c AS choice FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, question_id, paraphrase_idx ORDER BY n DESC, c) AS rn
      FROM shares) WHERE rn = 1"""),
)
def modal_choice(spark, sf_dir):
    return shift.modal_choice(_hist(spark, sf_dir), v.questions(spark))


@query("shift_examples", with_views(V, CHOICE, f"""
SELECT run_id, question_id, paraphrase_idx, {rnd('mean_response')} AS mean_response, n,
  CASE WHEN paraphrase_idx = 0 THEN '<original>' ELSE '{config.VARIANT_PLACEHOLDER}' END AS text FROM (
  SELECT m.run_id, m.question_id, m.paraphrase_idx, m.mean AS mean_response, m.n FROM means m JOIN questions q USING (run_id, question_id)
  WHERE q.type IN {sql_in(config.ORDINAL_TYPES)}
  UNION ALL
  SELECT s.run_id, s.question_id, s.paraphrase_idx, s.c::DOUBLE, p.n FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, question_id, paraphrase_idx ORDER BY n DESC, c) AS rn FROM shares) s
  JOIN questions q USING (run_id, question_id)
  JOIN (SELECT run_id, question_id, count(*) AS n FROM panel GROUP BY 1, 2) p USING (run_id, question_id)
  WHERE s.rn = 1 AND q.type = 'single_choice')
JOIN (SELECT run_id, question_id FROM panel GROUP BY 1, 2 HAVING count(*) >= {config.MIN_MATCHED}) USING (run_id, question_id)"""))
def shift_examples(spark, sf_dir):
    out = shift.flag_examples(_hist(spark, sf_dir), v.questions(spark))
    return out.withColumn("mean_response", F.round("mean_response", 6))


V["sets"] = """
SELECT run_id, persona_id, question_id, paraphrase_idx,
       list_filter(range(0, 5), lambda i: (bits >> i) % 2 = 1) AS value FROM (
  SELECT CASE WHEN user_id % 5 = 0 THEN 'r1' ELSE 'r0' END AS run_id, 'p' || user_id AS persona_id,
         event_type AS question_id, event_id % 6 AS paraphrase_idx, floor(value)::BIGINT AS bits,
         row_number() OVER (PARTITION BY user_id, event_type, event_id % 6 ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1"""


@query(
    "jaccard_shift",
    with_views(V, ["sets"], f"""
    SELECT b.run_id, b.question_id, b.paraphrase_idx,
      {rnd('''avg(CASE WHEN len(a.value) + len(b.value) = 0 THEN 0.0
        ELSE 1.0 - len(list_intersect(a.value, b.value))::DOUBLE
                 / len(list_distinct(list_concat(a.value, b.value))) END)''')} AS jaccard, count(*) AS n
    FROM sets a JOIN sets b USING (run_id, question_id, persona_id)
    JOIN (SELECT run_id, question_id, persona_id FROM sets s
          JOIN (SELECT run_id, question_id, count(DISTINCT paraphrase_idx) AS nk FROM sets GROUP BY 1, 2) w
          USING (run_id, question_id) GROUP BY 1, 2, 3, w.nk HAVING count(*) = w.nk) m
      USING (run_id, question_id, persona_id)
    WHERE a.paraphrase_idx = 0 AND b.paraphrase_idx <> 0 GROUP BY 1, 2, 3"""),
)
def jaccard_shift(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    bits = F.floor("value").cast("bigint")
    chosen = F.filter(
        F.array(*[F.when(F.getbit(bits, F.lit(i)) == 1, F.lit(i)) for i in range(5)]), lambda x: x.isNotNull()
    )
    rows = events.select(
        F.when(F.col("user_id") % 5 == 0, "r1").otherwise("r0").alias("run_id"),
        F.concat(F.lit("p"), F.col("user_id")).alias("persona_id"),
        F.col("event_type").alias("question_id"), (F.col("event_id") % 6).alias("paraphrase_idx"),
        chosen.alias("value"), "ts", F.col("event_id").alias("seq"),
    )
    out = shift.jaccard_shift(resp.latest_responses(rows))
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query(
    "run_completeness",
    with_views(V, ["raw_responses", "responses", "questions"], f"""
    SELECT q.run_id, count(*) FILTER (q.type IN {sql_in(config.SCORABLE_TYPES)}) AS n_expected,
           count(*) FILTER (q.type IN {sql_in(config.SCORABLE_TYPES)} AND s.question_id IS NULL) AS n_missing,
           count(*) FILTER (q.type IN {sql_in(config.SCORABLE_TYPES)} AND s.question_id IS NULL) = 0 AS complete
    FROM questions q LEFT JOIN (SELECT DISTINCT run_id, question_id FROM responses) s USING (run_id, question_id)
    GROUP BY 1"""),
)
def run_completeness(spark, sf_dir):
    return resp.run_completeness(v.questions(spark), v.responses(spark, sf_dir))


@query("free_value_shift", f"""
WITH c AS (SELECT l_returnflag AS question_id, l_linenumber - 1 AS variant, l_extendedprice AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
e AS (SELECT question_id, variant, value, n AS f, 0 AS g FROM c WHERE variant <> 0 UNION ALL
  SELECT question_id, k.variant, value, 0, n FROM c JOIN (SELECT DISTINCT question_id, variant FROM c WHERE variant <> 0) k USING (question_id) WHERE c.variant = 0),
m AS (SELECT question_id, variant, value, sum(f) AS f, sum(g) AS g FROM e GROUP BY 1, 2, 3),
w AS (SELECT *, sum(f) OVER o AS cf, sum(g) OVER o AS cg, sum(f) OVER a AS n, sum(g) OVER a AS n_base, lead(value) OVER (PARTITION BY question_id, variant ORDER BY value) AS next
  FROM m WINDOW o AS (PARTITION BY question_id, variant ORDER BY value), a AS (PARTITION BY question_id, variant))
SELECT question_id, variant, {rnd('sum(abs(cf / n - cg / n_base) * coalesce(next - value, 0))', 4)} AS wasserstein, max(n)::BIGINT AS n, max(n_base)::BIGINT AS n_base
FROM w GROUP BY 1, 2""")
def free_value_shift(spark, sf_dir):
    """Prices of each position of an order against those of the first, by return flag: nearly every value is a new one."""
    values = v.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("question_id"), (F.col("l_linenumber") - 1).alias("variant"), F.col("l_extendedprice").alias("value"), F.lit(1).alias("n"))
    return free_values.value_distances(values, ["question_id"]).withColumn("wasserstein", F.round("wasserstein", 4))
