"""Order-dependent work per key that stays bounded when one key is very large.

A window partitioned by a key sorts that key in one task. When the largest key
has been measured to be small that is the right plan. Otherwise rows get their
exact place in the key's order and are cut into chunks of consecutive rows, each
carrying copies of the few rows before and after it that its windows look at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sondage import config
from sondage.session import cut_lineage


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest key: a partial aggregate over the key columns only."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def with_place(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add `_place`, the 0-based position within the key, without a per-key sort.

    Rows are range-partitioned on key and order, so one key may span any number
    of partitions. The result is checkpointed before partition ids are used,
    which fixes the partitioning for every later read.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    part = F.shiftright("_seq", 33).alias("_part")
    runs = ranged.groupBy(*keys, part).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = ranged.withColumn("_part", F.shiftright("_seq", 33)).join(runs, [*keys, "_part"])
    return placed.withColumn("_place", F.col("_before") + F.col("_seq") - F.col("_first")).drop(
        "_seq", "_part", "_first", "_before"
    )


def over_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns, before: int = 0, after: int = 0,
    max_group: int = config.MAX_GROUP_ROWS,
) -> DataFrame:
    """Add window columns that look at most `before` rows back and `after` rows ahead.

    `columns(window)` maps an ordered window specification to named columns.
    """
    if largest_group(df, keys) <= max_group:
        return _add(df, columns, Window.partitionBy(*keys).orderBy(*order))
    if max(before, after) > max_group:
        raise ValueError("chunks must be longer than the rows a window looks at")
    placed = with_place(df, keys, order)
    chunk = F.floor(F.col("_place") / max_group)
    inside = F.col("_place") % max_group
    copies = F.array(
        F.struct(chunk.alias("chunk"), F.lit(True).alias("own")),
        F.when(inside >= max_group - before, F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))),
        F.when((inside < after) & (chunk > 0), F.struct((chunk - 1).alias("chunk"), F.lit(False).alias("own"))),
    )
    cut = placed.withColumn("_c", F.explode(F.filter(copies, lambda c: c.isNotNull()))).select(
        "*", F.col("_c.chunk").alias("_chunk"), F.col("_c.own").alias("_own")
    )
    window = Window.partitionBy(*keys, "_chunk").orderBy("_place")
    return _add(cut, columns, window).where("_own").drop("_c", "_chunk", "_own", "_place")


def _add(df: DataFrame, columns, window: WindowSpec) -> DataFrame:
    added: dict[str, Column] = columns(window)
    for name, column in added.items():
        df = df.withColumn(name, column)
    return df
