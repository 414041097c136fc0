"""Distances between distributions of free numeric values, of which a wording may have any number.

Scale answers have few distinct values and fit one array (`shift.ordinal_shift`). Here no value list is made: the values
of each compared pair are put in order by range partitions, counted inside each partition, and moved up by the totals of
the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.session import cut_lineage


PART_ROWS = 250_000  # rows that a task puts in order


def paired_counts(hist: DataFrame, keys: Sequence[str], base: int = 0, parts: int = 1) -> DataFrame:
    """Per key, variant other than `base` and value: how often the variant (`f`) and the base (`g`) have the value.

    `hist` has the keys, variant, value and n. The base's counts are dealt to the variants of its key, so they are
    repeated as often as there are wordings. A value that both have is two rows, one for each.
    The base's values are spread over `parts` before they are dealt.
    """
    cells = hist.where(F.col("value").isNotNull()).groupBy(*keys, "variant", "value").agg(F.sum("n").alias("n"))
    others = cells.where(F.col("variant") != base)
    against = cells.where(F.col("variant") == base).drop("variant").repartition(parts, *keys, "value").join(
        others.select(*keys, "variant").distinct(), list(keys))
    none = F.lit(0).cast("long")
    return others.select(*keys, "variant", "value", F.col("n").alias("f"), none.alias("g")).unionByName(
        against.select(*keys, "variant", "value", none.alias("f"), F.col("n").alias("g")))


def most_paired(hist: DataFrame, keys: Sequence[str], base: int = 0) -> int:
    """A bound on the rows of `paired_counts`, from the rows of each variant: no value is looked at."""
    sizes = hist.groupBy(*keys, "variant").agg(F.count(F.lit(1)).alias("n"))
    other = F.col("variant") != base
    dealt = F.coalesce(F.sum(F.when(~other, F.col("n"))), F.lit(0)) * F.count_if(other)
    return sizes.groupBy(*keys).agg((F.coalesce(F.sum(F.when(other, F.col("n"))), F.lit(0)) + dealt).alias("n")).agg(F.sum("n")).first()[0] or 0


def value_distances(hist: DataFrame, keys: Sequence[str], base: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """(keys, variant, wasserstein, n, n_base): the 1-Wasserstein distance of each variant's values from the base's.

    It is the area between the two distribution functions: at each value the difference of the shares so far, times the
    way to the next value. Counts so far are whole numbers, so the order of summation does not touch them, and of two rows
    of one value the first has no way to go. A variant whose key has no base, or no values, is left out; so is a null value.
    The number of ranges follows the rows, so that a task orders about `part_rows` whatever the input.
    """
    pair = [*keys, "variant"]
    ranges = max(1, -(-most_paired(hist, keys, base) // part_rows))
    ranged = cut_lineage(
        paired_counts(hist, keys, base, ranges).repartitionByRange(ranges, *pair, "value").sortWithinPartitions(*pair, "value")
        .withColumn("_part", F.spark_partition_id())
    )
    parts = ranged.groupBy(*pair, "_part").agg(F.min("value").alias("_first"), F.sum("f").alias("_f"), F.sum("g").alias("_g"))
    order = Window.partitionBy(*pair).orderBy("_part")
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*pair)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    parts = parts.select(
        *pair, "_part", so_far("_f").alias("_f_before"), so_far("_g").alias("_g_before"), F.lead("_first").over(order).alias("_then"),
        F.sum("_f").over(whole).alias("n"), F.sum("_g").over(whole).alias("n_base"))
    inside = Window.partitionBy(*pair, "_part").orderBy("value")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.repartition(2 * ranges, *pair, "_part").join(parts.where("n > 0 AND n_base > 0"), [*pair, "_part"])
    share = lambda c, n: (F.col(f"_{c}_before") + F.sum(c).over(running)) / F.col(n)
    step = F.coalesce(F.lead("value").over(inside), F.col("_then")) - F.col("value")
    area = placed.select(*pair, "n", "n_base", (F.abs(share("f", "n") - share("g", "n_base")) * F.coalesce(step, F.lit(0.0))).alias("_area"))
    return area.groupBy(*pair, "n", "n_base").agg(F.sum("_area").alias("wasserstein")).select(*pair, "wasserstein", "n", "n_base")
