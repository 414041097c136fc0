"""Stored tables: responses, caches and reports, written so that reruns converge.

Tables are partitioned by run and a hash bucket, so that one very large run is
still many partitions and an upsert rewrites only the buckets it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.operators.gate import absent_rows
from sondage.operators.responses import KEY
from sondage.sources import snapshots

BUCKETS = 64
PARTITIONS = ["run_id", "bucket"]


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """The number of buckets is part of the table: it is written with the rows and read back from them."""
    bucket = F.pmod(F.xxhash64("question_id", "persona_id"), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).withColumn("buckets", F.lit(buckets))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def held_buckets(stored: DataFrame | None) -> int | None:
    """The number of buckets of a stored table that has rows."""
    first = stored.select("buckets").first() if stored is not None else None
    return first["buckets"] if first else None


def touched_rows(stored: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """Stored rows in the partitions that `new` falls into: a semi-join on the partition columns, which prunes the scan."""
    touched = _bucketed(new, buckets).select("run_id", "bucket").distinct()
    return stored.join(touched, ["run_id", "bucket"], "left_semi")


def upsert_responses(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> int:
    """Last write per response key wins; partitions the batch does not touch stay as they are.

    `new` carries ts and seq as the write order and no null run_id. `buckets` holds for a new table, an existing one keeps
    its own number. Published as one version, whose number is returned: readers see all of a batch or nothing, and any
    number of writers may be at work; one that meets another in a partition starts again from what the other left.
    """
    kept = [c for c in new.columns if c not in KEY]
    newest = F.max(F.struct("ts", "seq", *[c for c in kept if c not in ("ts", "seq")])).alias("z")
    batch = new.persist()

    def merged(version: int | None) -> DataFrame:
        stored = None if version is None else snapshots.read(spark, path, version)
        held = held_buckets(stored)
        rows = _bucketed(batch, held or buckets)
        if held:
            rows = touched_rows(stored, batch, held).select(*rows.columns).unionByName(rows)
        rows = rows.groupBy(*KEY, "bucket", "buckets").agg(newest)
        return rows.select(*KEY, *[F.col(f"z.{c}").alias(c) for c in kept], "buckets", "bucket")

    try:
        return snapshots.commit(spark, path, merged, PARTITIONS)
    finally:
        batch.unpersist()


def read_responses(spark: SparkSession, path: str, run_id: str | None = None, questions: list[str] | None = None,
                   version: int | None = None) -> DataFrame:
    """Stored responses as of a version, by default the newest; run and question filters reach the partition list and the
    file statistics."""
    rows = snapshots.read(spark, path, version)
    if rows is None:
        raise FileNotFoundError(f"no stored responses in {path}")
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if questions is not None:
        rows = rows.where(F.col("question_id").isin(questions))
    return rows.drop("bucket", "buckets")


def tidy_responses(spark: SparkSession, path: str, keep: int = snapshots.KEEP) -> None:
    """Gives back the space of replaced partitions; the newest `keep` versions stay readable."""
    snapshots.compact(spark, path, PARTITIONS)
    snapshots.expire(spark, path, keep)


def append_absent(spark: SparkSession, path: str, rows: DataFrame, key: str, order: str) -> None:
    """Cache sink where the first write wins: only keys the cache lacks are appended, cached rows are never rewritten.

    `rows` has the cache's columns and `order`; of rows with one key, the lowest `order` is the first.
    """
    cache = _stored(spark, path)
    if cache is None:
        cache = rows.drop(order).limit(0)
    absent_rows(cache, rows, key, order).write.mode("append").option("compression", "zstd").parquet(path)


def write_reports(reports: DataFrame, path: str) -> int:
    """Replaces the reports of the runs at hand and leaves all others alone, as one version."""
    return snapshots.commit(reports.sparkSession, path, lambda version: reports, ["run_id"])


def read_reports(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    return snapshots.read(spark, path, version)
