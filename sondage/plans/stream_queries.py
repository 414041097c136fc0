"""Named queries that run as streams over the given tables until all input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sondage.plans import log_queries as lq
from sondage.plans import shift_queries as sq
from sondage.plans import views as v
from sondage.plans.registry import query, with_views
from sondage.session import checkpoint_root
from sondage.streaming import ingest, monitors


def fresh_folder(spark) -> str:
    return f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"


def in_files(spark, df, folder):
    """The rows, which have a column `part`, as a stream that takes the files of one part per batch, in their order.

    A part is dealt over as many files as there are cores, and a batch takes as many: a very small part has fewer, so a batch
    may then begin with what is next in order.
    """
    kind, width = df.drop("part").schema, spark.sparkContext.defaultParallelism
    for k in sorted(r["part"] for r in df.select("part").distinct().collect()):
        df.where(F.col("part") == k).drop("part").repartition(width).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", width).parquet(folder)


@query("stream_shift", with_views(v.VIEWS, sq.FLAGS, f"SELECT {sq.FLAG_COLUMNS} FROM shift_flags"))
def stream_shift(spark, sf_dir):
    """Answers come in four batches in no order of time, so many are late or change an answer; the flags read the kept histogram."""
    folder = fresh_folder(spark)
    events = v.table(spark, sf_dir, "events").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    rows = in_files(spark, events, f"{folder}/feed")
    ingest.keep_statistics(v.raw_from_events(rows), folder, f"{folder}/progress", buckets=4, compact_after=2).awaitTermination()
    return sq.flag_columns(ingest.kept_flags(spark, folder, v.questions(spark)))


def _to_table(spark, stream, schema):
    """Run a stream to the end of its input into a table in the shared folder."""
    folder = fresh_folder(spark)
    job = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


@query("stream_status_changes", with_views(v.VIEWS, lq.STATUS, """
SELECT run_id, status, seq FROM status_prev WHERE (end_ts IS NULL OR ts <= end_ts) AND (prev IS NULL OR prev <> status)"""))
def stream_status_changes(spark, sf_dir):
    """The log comes in six files of which each holds rows that are older than some of the file before."""
    folder = fresh_folder(spark)
    log = lq.status_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    span = log.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    begin, step = span["a"] or 0, max(1, ((span["b"] or 0) - (span["a"] or 0)) // 4)
    part = F.floor((at - begin) / step) + F.col("seq") % 2
    # a last entry, far ahead, lets the watermark pass all others
    close = spark.range(1).select(
        F.lit("close").alias("run_id"), F.lit("close").alias("status"), F.timestamp_micros(F.lit(begin + 20 * step)).alias("ts"),
        F.lit(0).cast("long").alias("seq"), F.lit(9).cast("long").alias("part"))
    both = log.select("run_id", "status", "ts", F.col("seq").cast("long").alias("seq"), part.alias("part")).unionByName(close)
    stream = in_files(spark, both, f"{folder}/feed")
    with monitors.rocksdb_state(spark):
        changes = monitors.status_change_stream(stream, delay=f"{2 * step // 1_000_000 + 1} seconds", keep=f"{30 * step // 1_000_000 + 1} seconds")
        return _to_table(spark, changes.where("run_id <> 'close'"), "run_id string, status string, seq bigint")
