"""The answer histogram as a stored view that is kept up to date by changes, never by reading all answers again.

A batch of answers touches some respondents. What they answered to a question before is taken out of the histogram and
what they answer now is put in: a few cells per batch, written as a delta folder named by the batch. The histogram is the
last compacted folder plus the deltas after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators.responses import KEY, answer_cells, matched_cells
from sondage.sources import snapshots, storage
from sondage.sources.tables import BUCKETS, held_buckets, tidy_responses, touched_rows, upsert_responses

CELL = ["run_id", "question_id", "present", "paraphrase_idx", "value"]
COMPACT_AFTER = 8


def cell_changes(before: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cells of the histogram with the number of respondents they gain or lose by `incoming`.

    `before` holds the stored rows of the touched respondents, one per response key. Both carry ts and seq.
    """
    columns = [*KEY, "value", "ts", "seq"]
    newest = F.max(F.struct("ts", "seq", "value")).alias("z")
    after = before.select(columns).unionByName(incoming.select(columns)).groupBy(*KEY).agg(newest).select(*KEY, "z.value")
    gained = answer_cells(after)
    lost = answer_cells(before.select(*KEY, "value")).withColumn("n", -F.col("n"))
    return gained.unionByName(lost).groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def _versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Complete folders `kind=<number>`, ascending."""
    found = [n for n in storage.names(spark, f"{path}/cells") if n.startswith(f"{kind}=")]
    return sorted(int(n.split("=")[1]) for n in found if storage.exists(spark, f"{path}/cells/{n}/_SUCCESS"))


def apply_batch(spark: SparkSession, path: str, batch: DataFrame, batch_id: int, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER) -> None:
    """Changes the histogram and then the stored answers by one batch; a batch that comes again changes nothing.

    The delta is written first, against the answers as they were, and only if it is not there: so a batch that was
    stopped between the two, or after both, is finished and not counted twice. One writer at a time.
    """
    delta, table = f"{path}/cells/batch={batch_id}", f"{path}/responses"
    rows = batch.persist()
    try:
        if not storage.exists(spark, f"{delta}/_SUCCESS"):
            who = ["run_id", "persona_id", "question_id"]
            stored = snapshots.read(spark, table)
            held = held_buckets(stored)
            before = touched_rows(stored, rows, held).join(rows.select(*who).distinct(), who, "left_semi") if held else rows.limit(0)
            cell_changes(before, rows).write.mode("overwrite").option("compression", "zstd").parquet(delta)
        upsert_responses(spark, table, rows, buckets)
    finally:
        rows.unpersist()
    done = _versions(spark, path, "base")
    if len([b for b in _versions(spark, path, "batch") if b > (done[-1] if done else -1)]) > compact_after:
        compact(spark, path)
        tidy_responses(spark, table)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The histogram (CELL and n) as of the last complete batch."""
    bases = _versions(spark, path, "base")
    last = bases[-1] if bases else -1
    folders = [f"{path}/cells/base={b}" for b in bases[-1:]] + [f"{path}/cells/batch={b}" for b in _versions(spark, path, "batch") if b > last]
    return spark.read.parquet(*folders).groupBy(*CELL).agg(F.sum("n").alias("n")).where("n <> 0")


def compact(spark: SparkSession, path: str) -> None:
    """Folds all complete deltas into a new base. The base before it and the deltas after that one stay for readers that
    have begun; what is older goes."""
    bases, batches = _versions(spark, path, "base"), _versions(spark, path, "batch")
    newest = max(bases + batches)
    if newest in bases:
        return
    read_cells(spark, path).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/cells/base={newest}")
    kept = bases[-1] if bases else -1
    for kind, versions in (("base", [b for b in bases if b < kept]), ("batch", [b for b in batches if b <= kept])):
        for version in versions:
            storage.delete(spark, f"{path}/cells/{kind}={version}")


def stored_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(run, question, variant, value, n, n_matched) over matched respondents, from the stored cells alone."""
    return matched_cells(read_cells(spark, path))
