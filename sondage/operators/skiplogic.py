"""Skip-logic and screener checks as joins and pointer doubling over question rows.

`questions`: survey_id, question_id, position, type, n_options, dep_id, operator
and value (the condition's value as JSON text). A question has at most one
condition, so the dependency graph is a set of pointers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.scalars import lookup
from sondage.session import cut_lineage

NODE = ["survey_id", "question_id"]
SUMMARIES = {
    "self_loop": "is conditional on itself and can never be reached",
    "loop": "starts a circular dependency, none of it can be reached",
    "unreachable_question": "depends on a question asked no earlier",
    "dead_branch": "has a condition that can never hold",
    "contradicting_rule": "is both terminated and qualified on the same answer",
}


def skip_edges(questions: DataFrame) -> DataFrame:
    return questions.where("dep_id IS NOT NULL").select("survey_id", F.col("dep_id").alias("source"), F.col("question_id").alias("target"))


def self_loops(questions: DataFrame) -> DataFrame:
    return questions.where("dep_id = question_id").select(*NODE)


def cycles(questions: DataFrame) -> DataFrame:
    """Members of every dependency cycle of two or more questions.

    Returns (survey_id, cycle_id, question_id, step): cycle_id is the smallest
    member, step its place when walking from there along dependency -> question.
    Every round doubles how far each pointer looks, so a survey of n questions
    needs log2(n) rounds; rounds write to the checkpoint folder.
    """
    edges = questions.where("dep_id IS NOT NULL AND dep_id <> question_id")
    known = questions.select("survey_id", F.col("question_id").alias("dep_id"))
    # a question nobody depends on cannot lie on a cycle, nor can one whose dependency is absent
    on_path = edges.join(edges.select("survey_id", F.col("dep_id").alias("question_id")).distinct(), NODE, "left_semi")
    jump = on_path.join(known, ["survey_id", "dep_id"], "left_semi").select(
        *NODE, F.col("dep_id").alias("ahead"),
        F.struct(F.col("question_id").alias("id"), F.lit(0).cast("bigint").alias("hops")).alias("low"),
    )
    jump = cut_lineage(jump)
    size = jump.groupBy("survey_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < size:
        far = jump.select(
            "survey_id", F.col("question_id").alias("ahead"), F.col("ahead").alias("further"), F.col("low").alias("far_low")
        )
        shifted = F.struct(F.col("far_low.id").alias("id"), (F.col("far_low.hops") + F.lit(reach)).alias("hops"))
        jump = cut_lineage(
            # a pointer that runs out of the graph has met a question without a condition
            jump.join(far, ["survey_id", "ahead"]).select(
                *NODE, F.col("further").alias("ahead"),
                F.when(F.col("low.id") <= F.col("far_low.id"), F.col("low")).otherwise(shifted).alias("low"),
            )
        )
        reach *= 2
    # after more steps than questions, exactly the cycle members are still pointed at
    members = jump.select("survey_id", F.col("ahead").alias("question_id")).distinct()
    return jump.join(members, NODE, "left_semi").select(
        "survey_id", F.col("low.id").alias("cycle_id"), "question_id", F.col("low.hops").alias("step")
    )


def _with_dependency(questions: DataFrame) -> DataFrame:
    dep = questions.select(
        "survey_id", F.col("question_id").alias("dep_id"), F.col("position").alias("dep_position"),
        F.col("type").alias("dep_type"), F.col("n_options").alias("dep_options"),
    )
    return questions.where("dep_id IS NOT NULL").join(dep, ["survey_id", "dep_id"], "left")


def unreachable(questions: DataFrame) -> DataFrame:
    """Unknown dependencies (dead_branch) and dependencies asked at the same place or later."""
    table = _with_dependency(questions)
    kind = F.when(F.col("dep_position").isNull(), "dead_branch").when(
        F.col("dep_position") >= F.col("position"), "unreachable_question"
    )
    return table.withColumn("flag", kind).where("flag IS NOT NULL").select(
        *NODE, "dep_id", "position", "dep_position", "flag"
    )


def _as_int(text: Column) -> Column:
    """Integer value of JSON text; booleans count as 0 and 1, anything else is NULL."""
    return F.when(text == "true", 1).when(text == "false", 0).when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint"))


def value_fits(kind: Column, n_options: Column, value: Column) -> Column:
    """Could any answer of this question type match the condition's value?"""
    whole = _as_int(F.trim(value))
    fits = F.when(kind.isNull(), F.lit(True))
    for name, (lo, hi) in config.SCALE_BOUNDS.items():
        fits = fits.when(kind == name, F.coalesce(whole.between(lo, hi), F.lit(False)))
    options = F.coalesce(n_options, F.lit(0))
    in_list = lambda x: F.coalesce((x >= 0) & (x < options), F.lit(False))
    inner = F.trim(F.regexp_extract(F.trim(value), r"^\[(.*)\]$", 1))
    parts = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
    is_list = F.trim(value).rlike(r"^\[.*\]$")
    return (
        fits.when(kind == "single_choice", (options > 0) & in_list(whole))
        .when(
            kind == "multi_choice",
            F.coalesce(is_list & (options > 0) & F.forall(parts, lambda p: in_list(_as_int(F.trim(p)))), F.lit(False)),
        )
        .otherwise(True)
    )


def impossible_conditions(questions: DataFrame) -> DataFrame:
    """Comparisons no valid answer of the dependency can satisfy; in / not_in are not judged."""
    table = _with_dependency(questions).where(
        F.col("dep_type").isNotNull() & F.col("operator").isin(config.COMPARISONS)
    )
    return table.where(~value_fits(F.col("dep_type"), F.col("dep_options"), F.col("value"))).select(
        *NODE, "dep_id", "operator", "value"
    )


def rule_contradictions(rules: DataFrame) -> DataFrame:
    """Terminate and qualify rules of one question that share a value.

    `rules`: survey_id, rule_id, q_id, if_value_in (array), action. Rules meet on
    the shared value, so only rule pairs that are reported are ever formed.
    """
    values = rules.where("if_value_in IS NOT NULL").select(
        "survey_id", "q_id", "rule_id", "action", F.explode(F.array_distinct("if_value_in")).alias("v")
    )
    side = lambda action, name: values.where(F.col("action") == action).select(
        "survey_id", "q_id", "v", F.col("rule_id").alias(name)
    )
    return (
        side("terminate", "terminate_rule")
        .join(side("qualify", "qualify_rule"), ["survey_id", "q_id", "v"])
        .groupBy("survey_id", "q_id", "terminate_rule", "qualify_rule")
        .agg(F.array_sort(F.collect_set("v")).alias("overlap"))
    )


def skip_logic_flags(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """All findings of a survey in one list: type, subject, detail and severity."""
    text = lambda c: F.col(c).cast("string")
    loops = cycles(questions).groupBy("survey_id", "cycle_id").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        self_loops(questions).select(
            "survey_id", F.lit("self_loop").alias("flag"), text("question_id").alias("subject"), F.lit("").alias("detail")
        ),
        loops.select(
            "survey_id", F.lit("loop").alias("flag"), text("cycle_id").alias("subject"),
            F.concat(F.lit("questions="), text("n")).alias("detail"),
        ),
        unreachable(questions).select(
            "survey_id", "flag", text("question_id").alias("subject"), F.concat(F.lit("depends on "), text("dep_id")).alias("detail")
        ),
        impossible_conditions(questions).select(
            "survey_id", F.lit("dead_branch").alias("flag"), text("question_id").alias("subject"),
            F.concat(F.lit("requires "), text("dep_id"), F.lit(" "), F.col("operator"), F.lit(" "), F.col("value")).alias("detail"),
        ),
        rule_contradictions(rules).select(
            "survey_id", F.lit("contradicting_rule").alias("flag"), text("q_id").alias("subject"),
            F.concat(F.lit("values "), F.array_join(F.col("overlap").cast("array<string>"), ",")).alias("detail"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    summary = F.concat(F.lit("question "), F.col("subject"), F.lit(" "), lookup(F.col("flag"), SUMMARIES))
    return out.withColumn("severity", F.lit("high")).withColumn("summary", summary)
