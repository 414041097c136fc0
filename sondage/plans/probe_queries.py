"""Named queries for variant gating, caches, work lists and answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.functions import hashing, scalars
from sondage.operators import gate, probes
from sondage.plans import population_queries as pop
from sondage.plans import views as v
from sondage.plans.registry import query, rnd, sql_bits, sql_case, sql_list, with_views

V = v.VIEWS
# cosines between unrelated vectors sit near zero, so the thresholds here do too
FLOOR, SIMILAR, DIVERGENT = -0.10, 0.20, -0.22

V["vectors"] = "SELECT 'q' || vec_id // 6 AS question_id, (vec_id % 6)::INT AS idx, embedding FROM embeddings"
_DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COS = lambda a, b: f"({_DOT(a, b)} / (sqrt({_DOT(a, a)}) * sqrt({_DOT(b, b)})))"
V["equivalence"] = f"""
SELECT b.question_id, b.idx, {_COS('a.embedding', 'b.embedding')} AS cosine
FROM vectors a JOIN vectors b USING (question_id) WHERE a.idx = 0 AND b.idx > 0"""
V["diversity"] = f"""
SELECT a.question_id, a.idx AS idx_a, b.idx AS idx_b, {_COS('a.embedding', 'b.embedding')} AS cosine
FROM vectors a JOIN vectors b USING (question_id) WHERE a.idx > 0 AND b.idx > a.idx"""
V["verdicts"] = f"""
SELECT question_id, min_equivalence, max_pair, min_pair,
  CASE WHEN min_equivalence < {FLOOR} THEN 'equivalence_below_floor' WHEN max_pair > {SIMILAR} THEN 'pair_too_similar'
       WHEN min_pair < {DIVERGENT} THEN 'pair_too_divergent' ELSE 'ok' END AS reason
FROM (SELECT question_id FROM vectors GROUP BY 1)
LEFT JOIN (SELECT question_id, min(cosine) AS min_equivalence FROM equivalence GROUP BY 1) USING (question_id)
LEFT JOIN (SELECT question_id, max(cosine) AS max_pair, min(cosine) AS min_pair FROM diversity GROUP BY 1) USING (question_id)"""
GATE = ["vectors", "equivalence", "diversity", "verdicts"]


def vectors(spark, sf_dir):
    return v.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("q"), F.floor(F.col("vec_id") / 6)).alias("question_id"), (F.col("vec_id") % 6).cast("int").alias("idx"), "embedding"
    )


def _verdicts(spark, sf_dir):
    return gate.variant_gate(vectors(spark, sf_dir), floor=FLOOR, too_similar=SIMILAR, too_divergent=DIVERGENT)


@query("variant_equivalence", with_views(V, GATE[:2], f"SELECT question_id, idx, {rnd('cosine', 5)} AS cosine FROM equivalence"))
def variant_equivalence(spark, sf_dir):
    return gate.variant_equivalence(vectors(spark, sf_dir)).withColumn("cosine", F.round("cosine", 5))


@query("variant_diversity", with_views(V, GATE[:3], f"SELECT question_id, idx_a, idx_b, {rnd('cosine', 5)} AS cosine FROM diversity"))
def variant_diversity(spark, sf_dir):
    return gate.variant_diversity(vectors(spark, sf_dir)).withColumn("cosine", F.round("cosine", 5))


@query("variant_gate", with_views(V, GATE, f"""SELECT question_id, {rnd('min_equivalence', 5)} AS min_equivalence,
  {rnd('max_pair', 5)} AS max_pair, {rnd('min_pair', 5)} AS min_pair, reason, reason = 'ok' AS passed FROM verdicts"""))
def variant_gate(spark, sf_dir):
    out = _verdicts(spark, sf_dir)
    for c in ("min_equivalence", "max_pair", "min_pair"):
        out = out.withColumn(c, F.round(c, 5))
    return out


@query("variant_fallback", with_views(V, GATE, f"""
SELECT question_id, 'Rate item ' || question_id AS text, unnest(range(1, {config.K_VARIANTS + 1}))::INT AS idx,
  '{config.FALLBACK_AXIS}' AS axis, false AS validated FROM verdicts WHERE reason <> 'ok'"""))
def variant_fallback(spark, sf_dir):
    questions = vectors(spark, sf_dir).where("idx = 0").select(
        "question_id", F.concat(F.lit("Rate item "), F.col("question_id")).alias("text")
    )
    return gate.fallback_variants(questions, _verdicts(spark, sf_dir))


# --- texts and caches, from part -------------------------------------------
V["part_texts"] = "SELECT p_partkey AS question_id, p_name || ' ' || p_brand || ' ' || p_size % 7 AS text FROM part"
# cached already: texts of the parts that sell more than parts do on average
V["good_sellers"] = """
SELECT l_partkey AS question_id FROM lineitem GROUP BY 1
HAVING sum(l_quantity) > (SELECT sum(l_quantity) / count(DISTINCT l_partkey) FROM lineitem)"""
V["part_cache"] = """
SELECT sha256('v1|' || text) AS question_hash, min(question_id) AS owner FROM part_texts JOIN good_sellers USING (question_id) GROUP BY 1"""
CACHE = ["part_texts", "good_sellers", "part_cache"]


def part_texts(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_brand", (F.col("p_size") % 7).cast("string"))
    return v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), text.alias("text"))


def part_cache(spark, sf_dir):
    sold = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("question_id")).agg(F.sum("l_quantity").alias("sold"))
    average = sold.agg(F.avg("sold").alias("average"))  # one row
    good = sold.join(F.broadcast(average), F.col("sold") > F.col("average"))
    rows = gate.with_hash(part_texts(spark, sf_dir).join(good, "question_id", "left_semi"))
    return rows.groupBy("question_hash").agg(F.min("question_id").alias("owner"))


@query("question_hash", with_views(V, ["part_texts"], "SELECT question_id, sha256('v1|' || text) AS question_hash FROM part_texts"))
def question_hash(spark, sf_dir):
    return part_texts(spark, sf_dir).select("question_id", hashing.question_hash(F.col("text")).alias("question_hash"))


@query("cache_hit_miss", with_views(V, CACHE, """
SELECT sha256('v1|' || text) AS question_hash, count(*) AS n_questions, min(question_id) AS first_question,
  sha256('v1|' || text) IN (SELECT question_hash FROM part_cache) AS hit FROM part_texts GROUP BY text"""))
def cache_hit_miss(spark, sf_dir):
    return gate.cache_lookup(part_texts(spark, sf_dir), part_cache(spark, sf_dir))


@query("cache_insert_new", with_views(V, CACHE, """
SELECT question_hash, owner FROM part_cache UNION ALL
SELECT sha256('v1|' || text), min(question_id) FROM part_texts
WHERE sha256('v1|' || text) NOT IN (SELECT question_hash FROM part_cache) GROUP BY 1"""))
def cache_insert_new(spark, sf_dir):
    rows = gate.with_hash(part_texts(spark, sf_dir)).select("question_hash", F.col("question_id").alias("owner"), F.col("question_id").alias("seq"))
    return gate.insert_absent(part_cache(spark, sf_dir), rows, "question_hash", "seq")


@query("variant_text", with_views(V, CACHE, f"""
SELECT t.question_id, i::INT AS idx, CASE WHEN i = 0 THEN t.text
  WHEN c.owner IS NOT NULL AND i <= 1 + c.owner % {config.K_VARIANTS} THEN 'wording ' || i || ' of ' || c.owner
  ELSE '{config.VARIANT_PLACEHOLDER}' END AS shown
FROM part_texts t LEFT JOIN part_cache c ON c.question_hash = sha256('v1|' || t.text),
     (SELECT unnest(range(0, {config.K_VARIANTS + 1})) AS i)"""))
def variant_text(spark, sf_dir):
    count = (1 + F.col("owner") % config.K_VARIANTS).cast("int")
    texts = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.struct(F.concat(F.lit("wording "), i.cast("string"), F.lit(" of "), F.col("owner").cast("string")).alias("text")),
    )
    cache = part_cache(spark, sf_dir).select("question_hash", texts.alias("paraphrases"))
    return gate.variant_texts(part_texts(spark, sf_dir), cache)


# --- work lists: panels asked about suppliers ------------------------------
_RUNS = [a[0] for a in pop._AUDIENCES]
V["asked"] = f"""
SELECT {sql_list(_RUNS)}[1 + s_suppkey % {len(_RUNS)}] AS run_id, 's' || s_suppkey AS question_id FROM supplier"""
SUB = 8
V["plan"] = f"""
SELECT q.run_id, p.persona_id, q.question_id, k::INT AS paraphrase_idx
FROM asked q JOIN panel_rows p ON p.audience_id = q.run_id,
     (SELECT unnest(range(0, {config.K_VARIANTS + 1})) AS k) WHERE k = 0 OR p.rank <= {SUB}"""
PLAN = [*pop.MEMBERS, "panel_rows", "asked", "plan"]
_DONE = sql_bits("'done'", "run_id", "persona_id", "question_id", "paraphrase_idx") + " % 5 < 2"


def _plan(spark, sf_dir):
    from sondage.operators.panel import build_panels

    panel = build_panels(pop.population(spark, sf_dir), pop.audiences(spark), pop.PANEL_SIZE)
    panel = panel.select(F.col("audience_id").alias("run_id"), "rank", "persona_id")
    key = F.col("s_suppkey")
    run = F.element_at(F.array(*[F.lit(r) for r in _RUNS]), (1 + key % len(_RUNS)).cast("int"))
    questions = v.table(spark, sf_dir, "supplier").select(run.alias("run_id"), F.concat(F.lit("s"), key).alias("question_id"))
    return probes.probe_plan(panel, questions, baseline_n=pop.PANEL_SIZE, subpanel_n=SUB)


@query("probe_plan", with_views(V, PLAN, "SELECT * FROM plan"))
def probe_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("probe_plan_remaining", with_views(V, PLAN, f"SELECT * FROM plan WHERE NOT ({_DONE})"))
def probe_plan_remaining(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    done = hashing.draw_bits("done", *[F.col(c) for c in probes.KEY]) % 5 < 2
    return probes.remaining(plan, plan.where(done))


# --- recorded payloads, from events ----------------------------------------
@query("payload_scalar", "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS value FROM events")
def payload_scalar(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select("event_id", scalars.payload_scalar(F.col("props"), "k").alias("value"))


_ANSWER_TYPES = ["likert_5", "likert_7", "nps", "top_box", "single_choice", "multi_choice", "open_end"]
V["payloads"] = f"""
SELECT event_id, {sql_list(_ANSWER_TYPES)}[1 + event_id % 7] AS type, (event_id % 5)::INT AS n_options,
  floor(value)::BIGINT % 13 - 1 AS a, (floor(value)::BIGINT // 13) % 5 AS b, event_id % 3 AS c, value / 450 AS confidence,
  event_id % 29 <> 0 AS has_confidence, event_id % 31 <> 0 AS has_value FROM events"""


@query("response_domain_check", with_views(V, ["payloads"], """
SELECT event_id, CASE WHEN NOT has_value THEN 'response_value missing' WHEN NOT has_confidence THEN 'confidence missing'
  WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range'
  WHEN NOT (CASE WHEN type IN ('likert_5', 'top_box') THEN a BETWEEN 1 AND 5 WHEN type = 'likert_7' THEN a BETWEEN 1 AND 7
    WHEN type = 'nps' THEN a BETWEEN 0 AND 10 WHEN type = 'single_choice' THEN a >= 0 AND a <= greatest(0, n_options - 1)
    WHEN type = 'multi_choice' THEN b <= greatest(0, n_options - 1) AND c <= greatest(0, n_options - 1) AND b <> c
    ELSE true END) THEN 'response_value out of domain' END AS problem FROM payloads"""))
def response_domain_check(spark, sf_dir):
    key, whole = F.col("event_id"), F.floor("value")
    kind = F.element_at(F.array(*[F.lit(t) for t in _ANSWER_TYPES]), (1 + key % 7).cast("int"))
    a, b, c = whole % 13 - 1, F.floor(whole / 13) % 5, key % 3
    text = lambda x: x.cast("string")
    value = (
        F.when(kind == "multi_choice", F.concat(F.lit("["), text(b), F.lit(","), text(c), F.lit("]")))
        .when(kind == "open_end", F.lit('"words"')).otherwise(text(a))
    )
    fields = F.concat_ws(
        ", ",
        F.when(key % 31 != 0, F.concat(F.lit('"response_value": '), value)),
        F.when(key % 29 != 0, F.concat(F.lit('"confidence": '), text(F.col("value") / 450))),
    )
    rows = v.table(spark, sf_dir, "events").select(
        "event_id", kind.alias("type"), (key % 5).cast("int").alias("n_options"),
        F.concat(F.lit("{"), fields, F.lit("}")).alias("payload"),
    )
    return probes.check_answers(rows).select("event_id", "problem")


V["rendered"] = f"""
SELECT p_partkey, {sql_list(config.QUESTION_TYPES)}[1 + p_partkey % 9] AS type, 'How good is ' || p_name || '?' AS text,
  p_brand, p_type, p_size FROM part"""


@query("question_render", with_views(V, ["rendered"], f"""
SELECT p_partkey AS question_id, concat_ws(chr(10) || chr(10), text, CASE
  WHEN type IN ('single_choice', 'multi_choice') THEN 'Choose by index:' || chr(10) || '0. ' || p_brand || chr(10) || '1. ' || p_type
       || CASE WHEN p_size % 2 = 0 THEN chr(10) || '2. Size ' || p_size ELSE '' END
  ELSE {sql_case('type', config.SCALE_HINTS)} END) AS shown FROM rendered"""))
def question_render(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in config.QUESTION_TYPES]), (1 + F.col("p_partkey") % 9).cast("int"))
    two = F.array("p_brand", "p_type")
    three = F.array("p_brand", "p_type", F.concat(F.lit("Size "), F.col("p_size")))
    options = F.when(F.col("p_size") % 2 == 0, three).otherwise(two)
    text = F.concat(F.lit("How good is "), F.col("p_name"), F.lit("?"))
    return v.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"), probes.render_question(kind, text, options).alias("shown")
    )
