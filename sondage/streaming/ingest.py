"""Streaming responses: a stored table of the latest answers, and the answer histogram that flags are computed from.

There is no state in executors: the tables are the state. Answers have one row per response key, are rewritten only in
the partitions that a batch touches, and take rows in any order, since (ts, seq) decides which answer is the latest. So
rows may be as late as they like, and a replayed batch changes nothing. The histogram takes each batch's changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondage.operators.shift import flags_from_histogram, shift_flags
from sondage.sources import statistics
from sondage.sources.tables import BUCKETS, read_responses, upsert_responses


def keep_responses(responses: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Start a stream that upserts every batch by response key; a replayed batch changes nothing.

    Rows carry ts and seq as write order, like the batch upsert.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_responses(batch.sparkSession, path, batch, buckets)

    return (
        responses.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_flags(spark: SparkSession, path: str, questions: DataFrame, run_id: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Shift flags of the stored answers; a run and questions restrict the scan to their partitions and rows."""
    return shift_flags(read_responses(spark, path, run_id, only), questions)


def keep_statistics(responses: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, compact_after: int = statistics.COMPACT_AFTER):
    """Start a stream that keeps the answers and their histogram; see `statistics.apply_batch`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        statistics.apply_batch(batch.sparkSession, path, batch, batch_id, buckets, compact_after)

    return (
        responses.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def kept_flags(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """Shift flags of all answers so far from the kept histogram; no answer is read."""
    return flags_from_histogram(statistics.stored_histogram(spark, path), questions)
