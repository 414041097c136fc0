"""Redundant item pairs: Pearson and Spearman over pairwise-complete respondents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.scalars import redundancy_severity, signed2
from sondage.operators import kernels
from sondage.session import ship_by_value

ship_by_value(kernels)
PAIR = ["run_id", "pos_a", "pos_b"]


def baseline_items(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """(run, respondent, position, value) of ordinal questions under the original wording."""
    ordinal = questions.where(F.col("type").isin(config.ORDINAL_TYPES)).select(
        "run_id", "question_id", "position"
    )
    return (
        responses.where("paraphrase_idx = 0 AND value IS NOT NULL")
        .join(ordinal, ["run_id", "question_id"])
        .select("run_id", "persona_id", "position", "value")
    )


def joint_counts(items: DataFrame) -> DataFrame:
    """Contingency table of every item pair of a survey.

    A respondent's list is bounded by the questionnaire's length. Counts are
    added up inside each task, so the shuffle carries scale points, not people.
    """
    answer = F.struct(F.col("position").cast("int").alias("pos"), F.col("value").cast("double").alias("value"))
    lists = (
        items.groupBy("run_id", "persona_id")
        .agg(F.collect_list(answer).alias("x"))
        .where(F.size("x") > 1)
        .select("run_id", F.col("x.pos").alias("pos"), F.col("x.value").alias("value"))
    )
    cells = lists.mapInPandas(
        kernels.pair_cells, "run_id string, pos_a int, pos_b int, va double, vb double, n bigint"
    )
    return cells.groupBy(*PAIR, "va", "vb").agg(F.sum("n").alias("n"))


def pair_statistics(cells: DataFrame, min_pairs: int = config.MIN_PAIRS) -> DataFrame:
    """Both coefficients from the joint counts, ranks averaged within the pair's own respondents."""
    cells = cells.repartition(*PAIR)
    pair = Window.partitionBy(*PAIR)

    def rank(column):
        below = pair.orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        ties = F.sum("n").over(Window.partitionBy(*PAIR, column))
        return F.sum("n").over(below) - (ties - 1) / 2

    cells = cells.withColumn("total", F.sum("n").over(pair)).where(F.col("total") >= min_pairs)
    cells = (
        cells.withColumn("xa", F.col("va") - F.sum(F.col("n") * F.col("va")).over(pair) / F.col("total"))
        .withColumn("xb", F.col("vb") - F.sum(F.col("n") * F.col("vb")).over(pair) / F.col("total"))
        .withColumn("ra", rank("va") - (F.col("total") + 1) / 2)
        .withColumn("rb", rank("vb") - (F.col("total") + 1) / 2)
    )
    moment = lambda p, q: F.sum(F.col("n") * F.col(p) * F.col(q))
    stats = cells.groupBy(*PAIR).agg(
        F.first("total").alias("n_personas"),
        F.try_divide(moment("xa", "xb"), F.sqrt(moment("xa", "xa") * moment("xb", "xb"))).alias("pearson"),
        F.try_divide(moment("ra", "rb"), F.sqrt(moment("ra", "ra") * moment("rb", "rb"))).alias("spearman"),
    )
    return stats.where(F.col("pearson").isNotNull() & F.col("spearman").isNotNull())


def redundancy_pairs(items: DataFrame, min_pairs: int = config.MIN_PAIRS) -> DataFrame:
    return pair_statistics(joint_counts(items), min_pairs)


def redundancy_flags(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """Pairs above the thresholds on |Pearson|, with question ids and text."""
    named = lambda side: questions.select(
        "run_id", F.col("position").alias(f"pos_{side}"), F.col("question_id").alias(f"q_id_{side}")
    )
    flags = (
        pairs.withColumn("severity", redundancy_severity(F.col("pearson")))
        .where("severity <> 'none'")
        .join(named("a"), ["run_id", "pos_a"])
        .join(named("b"), ["run_id", "pos_b"])
    )
    sense = F.when(F.col("pearson") > 0, "the same").otherwise("opposite")
    text = F.when(
        F.col("severity") == "high",
        F.concat(F.col("q_id_a"), F.lit(" and "), F.col("q_id_b"), F.lit(" measure "), sense,
                 F.lit(" thing ("), signed2(F.col("pearson")), F.lit("); drop one")),
    ).otherwise(
        F.concat(F.col("q_id_a"), F.lit(" and "), F.col("q_id_b"), F.lit(" are correlated "), signed2(F.col("pearson")))
    )
    return flags.select(
        "run_id", "q_id_a", "q_id_b", "pearson", "spearman", "n_personas", "severity", text.alias("summary")
    )
