"""Named queries over question and rule tables: skip logic and document checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.operators import skiplogic
from sondage.plans import views as v
from sondage.plans.registry import query, sql_case, sql_in, sql_list, with_views
from sondage.sources import surveys

V = v.VIEWS
_TYPES = config.QUESTION_TYPES
V["skip_questions"] = f"""
SELECT c_custkey // 50 AS survey_id, c_custkey AS question_id, (c_custkey % 50)::INT AS position,
  {sql_list(_TYPES)}[1 + c_custkey % 9] AS type, (c_custkey % 6)::INT AS n_options,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 97 = 1 THEN c_custkey WHEN c_custkey % 31 = 5 THEN -c_custkey
       ELSE (c_custkey // 50) * 50 + ((c_custkey % 50) * 7 + 3 + c_custkey // 50) % 50 END AS dep_id,
  {sql_list(config.OPERATORS)}[1 + c_custkey % 8] AS operator,
  CASE WHEN c_custkey % 19 = 0 THEN '"often"' WHEN c_custkey % 23 = 0 THEN 'true'
       WHEN c_custkey % 3 = 0 THEN '[' || c_custkey % 4 || ',' || c_custkey % 5 || ']'
       ELSE (c_custkey % 13 - 1)::VARCHAR END AS value
FROM customer"""
V["walk"] = """
SELECT survey_id, question_id AS start, question_id AS node, 0 AS step FROM skip_questions
UNION ALL
SELECT w.survey_id, w.start, q.dep_id, w.step + 1 FROM walk w JOIN skip_questions q
  ON q.survey_id = w.survey_id AND q.question_id = w.node
WHERE q.dep_id IS NOT NULL AND q.dep_id <> q.question_id AND w.step < 50 AND (w.step = 0 OR w.node <> w.start)"""
V["on_cycle"] = "SELECT survey_id, start AS question_id FROM walk WHERE step > 0 AND node = start"
V["cycle_rows"] = """
SELECT w.survey_id, m.cycle_id, w.start AS question_id, min(w.step) AS step FROM (
  SELECT w.survey_id, w.start, min(w.node) AS cycle_id FROM walk w JOIN on_cycle c
    ON c.survey_id = w.survey_id AND c.question_id = w.start GROUP BY 1, 2) m
JOIN walk w ON w.survey_id = m.survey_id AND w.start = m.start AND w.node = m.cycle_id GROUP BY 1, 2, 3"""
CYCLE = ["skip_questions", "walk", "on_cycle", "cycle_rows"]
V["dependencies"] = """
SELECT q.*, d.position AS dep_position, d.type AS dep_type, d.n_options AS dep_options
FROM skip_questions q LEFT JOIN skip_questions d ON d.survey_id = q.survey_id AND d.question_id = q.dep_id
WHERE q.dep_id IS NOT NULL"""
V["unreachable"] = """
SELECT survey_id, question_id, dep_id, position, dep_position,
  CASE WHEN dep_position IS NULL THEN 'dead_branch' ELSE 'unreachable_question' END AS flag
FROM dependencies WHERE dep_position IS NULL OR dep_position >= position"""
V["impossible"] = f"""
SELECT survey_id, question_id, dep_id, operator, value FROM (
  SELECT *, CASE WHEN value = 'true' THEN 1 ELSE try_cast(value AS BIGINT) END AS i,
    list_transform(str_split(trim(value, '[]'), ','), lambda x: try_cast(x AS BIGINT)) AS items,
    value LIKE '[%' AS is_list FROM dependencies)
WHERE dep_type IS NOT NULL AND operator IN {sql_in(config.COMPARISONS)} AND NOT (
  CASE WHEN dep_type IN ('likert_5', 'top_box') THEN coalesce(i BETWEEN 1 AND 5, false)
       WHEN dep_type = 'likert_7' THEN coalesce(i BETWEEN 1 AND 7, false)
       WHEN dep_type = 'nps' THEN coalesce(i BETWEEN 0 AND 10, false)
       WHEN dep_type = 'single_choice' THEN coalesce(i >= 0 AND i < dep_options, false)
       WHEN dep_type = 'multi_choice' THEN is_list AND dep_options > 0 AND len(list_filter(items,
            lambda x: x IS NULL OR x < 0 OR x >= dep_options)) = 0
       ELSE true END)"""
V["rules"] = """
SELECT o_custkey // 50 AS survey_id, o_orderkey AS rule_id, o_custkey AS q_id,
  CASE WHEN o_orderkey % 9 <> 0 THEN [o_orderkey % 11, (o_orderkey // 11) % 11] END AS if_value_in,
  CASE WHEN o_orderkey % 2 = 0 THEN 'terminate' ELSE 'qualify' END AS action FROM orders"""
V["contradictions"] = """
SELECT a.survey_id, a.q_id, a.rule_id AS terminate_rule, b.rule_id AS qualify_rule,
  array_to_string(list_sort(list_distinct(list_intersect(a.if_value_in, b.if_value_in))), ',') AS overlap
FROM rules a JOIN rules b ON a.survey_id = b.survey_id AND a.q_id = b.q_id
WHERE a.action = 'terminate' AND b.action = 'qualify' AND len(list_intersect(a.if_value_in, b.if_value_in)) > 0"""
V["skip_flags"] = """
SELECT survey_id, 'self_loop' AS flag, question_id::VARCHAR AS subject, '' AS detail FROM skip_questions WHERE dep_id = question_id
UNION ALL SELECT survey_id, 'loop', cycle_id::VARCHAR, 'questions=' || count(*) FROM cycle_rows GROUP BY survey_id, cycle_id
UNION ALL SELECT survey_id, flag, question_id::VARCHAR, 'depends on ' || dep_id FROM unreachable
UNION ALL SELECT survey_id, 'dead_branch', question_id::VARCHAR, 'requires ' || dep_id || ' ' || operator || ' ' || value FROM impossible
UNION ALL SELECT survey_id, 'contradicting_rule', q_id::VARCHAR, 'values ' || overlap FROM contradictions"""
SKIP = [*CYCLE, "dependencies", "unreachable", "impossible", "rules", "contradictions", "skip_flags"]


def recursive(needed, body):
    return with_views(V, needed, body).replace("WITH ", "WITH RECURSIVE ", 1)


def skip_questions(spark, sf_dir):
    key = F.col("c_custkey")
    block, local = F.floor(key / 50), key % 50
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (1 + i).cast("int"))
    dep = (
        F.when(key % 4 == 0, None).when(key % 97 == 1, key).when(key % 31 == 5, -key)
        .otherwise(block * 50 + (local * 7 + 3 + block) % 50)
    )
    value = (
        F.when(key % 19 == 0, '"often"').when(key % 23 == 0, "true")
        .when(key % 3 == 0, F.concat(F.lit("["), key % 4, F.lit(","), key % 5, F.lit("]")))
        .otherwise((key % 13 - 1).cast("string"))
    )
    return v.table(spark, sf_dir, "customer").select(
        block.alias("survey_id"), key.alias("question_id"), local.cast("int").alias("position"),
        pick(_TYPES, key % 9).alias("type"), (key % 6).cast("int").alias("n_options"), dep.alias("dep_id"),
        pick(config.OPERATORS, key % 8).alias("operator"), value.alias("value"),
    )


def rules(spark, sf_dir):
    key = F.col("o_orderkey")
    return v.table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 50).alias("survey_id"), key.alias("rule_id"), F.col("o_custkey").alias("q_id"),
        F.when(key % 9 != 0, F.array(key % 11, F.floor(key / 11) % 11)).alias("if_value_in"),
        F.when(key % 2 == 0, "terminate").otherwise("qualify").alias("action"),
    )


@query("skip_edges", with_views(V, ["skip_questions"], "SELECT survey_id, dep_id AS source, question_id AS target FROM skip_questions WHERE dep_id IS NOT NULL"))
def skip_edges(spark, sf_dir):
    return skiplogic.skip_edges(skip_questions(spark, sf_dir))


@query("skip_self_loops", with_views(V, ["skip_questions"], "SELECT survey_id, question_id FROM skip_questions WHERE dep_id = question_id"))
def skip_self_loops(spark, sf_dir):
    return skiplogic.self_loops(skip_questions(spark, sf_dir))


@query("skip_cycles", recursive(CYCLE, "SELECT * FROM cycle_rows"))
def skip_cycles(spark, sf_dir):
    return skiplogic.cycles(skip_questions(spark, sf_dir))


@query("skip_unreachable", with_views(V, ["skip_questions", "dependencies", "unreachable"], "SELECT * FROM unreachable"))
def skip_unreachable(spark, sf_dir):
    return skiplogic.unreachable(skip_questions(spark, sf_dir))


@query("skip_impossible", with_views(V, ["skip_questions", "dependencies", "impossible"], "SELECT * FROM impossible"))
def skip_impossible(spark, sf_dir):
    return skiplogic.impossible_conditions(skip_questions(spark, sf_dir))


@query("rule_contradictions", with_views(V, ["rules", "contradictions"], "SELECT * FROM contradictions"))
def rule_contradictions(spark, sf_dir):
    out = skiplogic.rule_contradictions(rules(spark, sf_dir))
    return out.withColumn("overlap", F.array_join(F.col("overlap").cast("array<string>"), ","))


@query("skip_logic_flags", recursive(SKIP, f"""
SELECT *, 'high' AS severity, 'question ' || subject || ' ' || {sql_case('flag', skiplogic.SUMMARIES)} AS summary FROM skip_flags"""))
def skip_logic_flags(spark, sf_dir):
    return skiplogic.skip_logic_flags(skip_questions(spark, sf_dir), rules(spark, sf_dir))


# --- survey documents built from part rows ---------------------------------
_KIND = "CASE WHEN p_partkey % 13 = 0 THEN 'matrix' ELSE 'likert_5' END"


def documents(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    n = F.col("p_partkey")
    condition = F.when(
        n % 3 == 0,
        F.concat(F.lit(', "conditional_on": {"q_id": "A", "operator": "'), F.when(n % 9 == 0, "~").otherwise("=="), F.when(n % 29 == 0, '"}').otherwise('", "value": 3}')),
    ).otherwise("")
    doc = F.concat(
        F.lit('{"id": "s'), key, F.lit('"'),
        F.when(n % 11 == 0, ', "rogue": 1').otherwise(""),
        F.when(n % 7 != 0, ', "brief": {"objectives": ["track"], "audience_criteria": "adults"}').otherwise(""),
        F.lit(', "audience": {"age_range": {"min": 18, "max": '), F.when(n % 17 == 0, "200").otherwise("60"), F.lit("}}"),
        F.lit(', "questions": [{"id": "A", "type": "'), F.when(n % 13 == 0, "matrix").otherwise("likert_5"),
        F.lit('", "text": "Rate '), F.col("p_name"), F.lit('"}, {"id": "B", "type": "single_choice", "text": "Pick", "options": '),
        F.when(n % 31 == 0, "[1, 2]").otherwise('["x", "y"]'), F.when(n % 37 == 0, ', "stimulus": {"kind": "ad"}').otherwise(""),
        condition, F.when(n % 19 == 0, ', "hue": "red"').otherwise(""), F.lit("}]"),
        F.lit(', "quotas": [{"cell": {"age_bucket": "18-24"}, "target_n": '), F.col("p_size").cast("string"), F.lit("}]"),
        F.when(n % 41 == 0, ', "fielding": {"target_n": "many"}').when(n % 43 == 0, ', "fielding": {"target_n": "500"}').otherwise(""),
        F.when(n % 23 == 0, "").otherwise("}"),
    )
    return v.table(spark, sf_dir, "part").select(F.concat(F.lit("s"), key).alias("slug"), doc.alias("doc"))


_REASON = """CASE WHEN p_partkey % 23 = 0 THEN 'not a JSON object' WHEN p_partkey % 11 = 0 THEN 'unknown top-level field'
 WHEN p_partkey % 7 = 0 THEN 'missing required field' WHEN p_partkey % 13 = 0 THEN 'unknown question type'
 WHEN p_partkey % 19 = 0 THEN 'unknown question field' WHEN p_partkey % 9 = 0 THEN 'bad condition'
 WHEN p_partkey % 3 = 0 AND p_partkey % 29 = 0 THEN 'bad condition' WHEN p_partkey % 37 = 0 THEN 'stimulus without description'
 WHEN p_partkey % 17 = 0 THEN 'age out of range' WHEN p_partkey % 31 = 0 OR p_partkey % 41 = 0 THEN 'wrong type' END"""


@query("survey_validate", f"SELECT 's' || p_partkey AS slug, {_REASON} AS reject_reason, ({_REASON}) IS NULL AS valid FROM part")
def survey_validate(spark, sf_dir):
    return surveys.validate(documents(spark, sf_dir)).select("slug", "reject_reason", "valid")


#: Fields that no valid document of these has.
_ABSENT = ", ".join(f"NULL::VARCHAR AS {c}" for c in ("scale_labels", "evaluation_axes", "stimulus_kind", "stimulus_description", "stimulus_url"))


@query("survey_flatten", f"""
SELECT 's' || p_partkey AS survey_id, 0 AS position, 'A' AS question_id, 'likert_5' AS type, 'Rate ' || p_name AS text,
  0 AS n_options, NULL AS dep_id, NULL AS operator, NULL AS value, NULL AS options, {_ABSENT} FROM part WHERE ({_REASON}) IS NULL UNION ALL
SELECT 's' || p_partkey, 1, 'B', 'single_choice', 'Pick', 2, CASE WHEN p_partkey % 3 = 0 THEN 'A' END,
  CASE WHEN p_partkey % 3 = 0 THEN '==' END, CASE WHEN p_partkey % 3 = 0 THEN '3' END, '["x","y"]', {_ABSENT} FROM part WHERE ({_REASON}) IS NULL""")
def survey_flatten(spark, sf_dir):
    """Every field of every question; lists as JSON text."""
    rows = surveys.flatten_questions(surveys.validate(documents(spark, sf_dir)).where("valid"))
    return rows.withColumns({c: F.to_json(c) for c in ("options", "scale_labels", "evaluation_axes")})


@query("survey_quotas", f"""SELECT 's' || p_partkey AS audience_id, 'q0' AS cell_id, '18-24' AS age_bucket, p_size AS target_n
FROM part WHERE ({_REASON}) IS NULL""")
def survey_quotas(spark, sf_dir):
    cells = surveys.flatten_quotas(surveys.validate(documents(spark, sf_dir)).where("valid"))
    return cells.select("audience_id", "cell_id", F.col("cell")["age_bucket"].alias("age_bucket"), "target_n")


@query("survey_load", f"""SELECT 's' || p_partkey AS slug, 's' || p_partkey AS survey_id, 'track' AS title, 'adults' AS objective
FROM part WHERE ({_REASON}) IS NULL""")
def survey_load(spark, sf_dir):
    return surveys.listing(surveys.validate(documents(spark, sf_dir)).where("valid"))
