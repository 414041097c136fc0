"""Balanced contiguous shards from global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.common import partitions, stage


def shard_by_size(docs: DataFrame, shards: int = 40, overhead: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal every document to one of `shards` contiguous runs of about equal bytes.

    Rows are range-partitioned by id. One total per partition gives each partition its global offset, so the running sum
    inside a partition is a global prefix sum. A row belongs to the shard in which its first byte falls when the whole is
    cut at equal targets; a shard is at most one document off its target.

    Returns doc_id, size (UTF-8 bytes plus `overhead`), text_crc32, shard, slot (gapless from 0 in id order).
    Null text counts as no bytes; null ids come first; rows with equal id are ordered by checksum and size, so repeated
    rows are interchangeable. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    light = stage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    ), "sizes")
    order = ["doc_id", "text_crc32", "size"]
    ranged = stage(
        light.repartitionByRange(partitions(docs), *[F.col(c).asc_nulls_first() for c in order])
        .withColumn("part", F.spark_partition_id()), "ranges",
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # one row per partition: as small as the number of partitions, whatever the data
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = ranged.join(F.broadcast(offsets), "part").select(
        *order,
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"), "all_bytes",
    ).select("*", F.expr(f"cast((at * {shards}) div all_bytes as int)").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot"))
