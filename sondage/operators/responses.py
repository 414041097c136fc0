"""Response table: upsert, matched panel and the answer histogram.

Every response analysis starts from `matched_histogram`, whose size depends on
the number of questions, wordings and scale points, not on respondents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["run_id", "persona_id", "question_id", "paraphrase_idx"]


def latest_responses(rows: DataFrame, version: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Last write per key.

    An aggregate rather than a ranked window. Rows are dealt by respondent and
    question, which serves this grouping and the per-respondent windows after
    it, so the answers are shuffled once.
    """
    payload = [c for c in rows.columns if c not in KEY and c not in version]
    newest = F.max(F.struct(*version, *payload)).alias("_newest")
    return rows.repartition(*KEY[:3]).groupBy(*KEY).agg(newest).select(*KEY, *[F.col(f"_newest.{c}").alias(c) for c in payload])


def respondent_answers(responses: DataFrame) -> DataFrame:
    """One row per (run, question, respondent) with its answers by variant.

    The list holds one entry per wording of one question, because the input is
    unique on the response key.
    """
    return responses.groupBy("run_id", "question_id", "persona_id").agg(
        F.collect_list(F.struct("paraphrase_idx", "value")).alias("answers")
    )


def answer_cells(responses: DataFrame) -> DataFrame:
    """Answer counts split by how many wordings the respondent answered.

    The window holds one respondent's wordings of one question; the counts that
    leave each task are bounded by wordings and scale points.
    """
    respondent = Window.partitionBy("run_id", "question_id", "persona_id")
    return (
        responses.withColumn("present", F.count(F.lit(1)).over(respondent).cast("int"))
        .groupBy("run_id", "question_id", "present", "paraphrase_idx", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def matched_cells(cells: DataFrame) -> DataFrame:
    """Keep the respondents who answered every wording seen for the question.

    Presence counts even when the value is missing, so the test is on the number
    of wordings; it runs on the counts, never on the respondents.
    """
    question = Window.partitionBy("run_id", "question_id")
    variant = Window.partitionBy("run_id", "question_id", "paraphrase_idx")
    return (
        cells.withColumn("_wordings", F.size(F.collect_set("paraphrase_idx").over(question)))
        .where(F.col("present") == F.col("_wordings"))
        .withColumn("n_matched", F.sum("n").over(variant))
        .drop("present", "_wordings")
    )


def matched_histogram(responses: DataFrame) -> DataFrame:
    """(run, question, variant, value, n, n_matched) over matched respondents."""
    return matched_cells(answer_cells(responses))


def matched_panel(responses: DataFrame) -> DataFrame:
    """The matched respondents themselves."""
    wordings = (
        responses.groupBy("run_id", "question_id")
        .agg(F.count_distinct("paraphrase_idx").alias("n_variants"))
    )
    present = responses.groupBy("run_id", "question_id", "persona_id").agg(F.count(F.lit(1)).alias("n_variants"))
    return present.join(wordings, ["run_id", "question_id", "n_variants"], "left_semi")


def run_completeness(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """A run is complete when every scorable question has some response."""
    from sondage import config

    seen = responses.select("run_id", "question_id").distinct().withColumn("seen", F.lit(1))
    expected = questions.withColumn("scorable", F.col("type").isin(config.SCORABLE_TYPES))
    missing = F.count_if(F.col("scorable") & F.col("seen").isNull())
    return (
        expected.join(seen, ["run_id", "question_id"], "left")
        .groupBy("run_id")
        .agg(F.count_if("scorable").alias("n_expected"), missing.alias("n_missing"))
        .withColumn("complete", F.col("n_missing") == 0)
    )
