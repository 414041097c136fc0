"""Call ledger, failure alarm and status logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.scalars import call_cost
from sondage.operators.ordered import over_order
from sondage.session import literal_table


def price_list(spark: SparkSession, prices: dict | None = None) -> DataFrame:
    names = ("model", "price_in", "price_out", "price_write", "price_read")
    rows = [dict(zip(names, (m, *p))) for m, p in (prices or config.PRICES).items()]
    return literal_table(spark, rows, "model string, price_in double, price_out double, price_write double, price_read double")


def priced_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of every call, and what it would have cost without the prompt cache."""
    c = F.col
    rates = (c("price_in"), c("price_out"), c("price_write"), c("price_read"))
    used = call_cost(c("input_tokens"), c("output_tokens"), c("cache_read_tokens"), c("cache_write_tokens"), *rates)
    plain = call_cost(c("input_tokens"), c("output_tokens"), F.lit(0), F.lit(0), *rates)
    joined = calls.join(prices, "model", "left")
    return joined.withColumn("cost_usd", used).withColumn("cost_uncached_usd", plain).drop(
        "price_in", "price_out", "price_write", "price_read"
    )


def spend_rollup(priced: DataFrame, levels: tuple[str, ...] = ("day", "model", "purpose")) -> DataFrame:
    """Calls and spend at every level of the hierarchy; ALL marks a total."""
    out = priced.rollup(*levels).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"),
        *[F.grouping(level).alias(f"_g_{level}") for level in levels],
    )
    for level in levels:
        out = out.withColumn(level, F.when(F.col(f"_g_{level}") == 1, "ALL").otherwise(F.col(level).cast("string")))
    return out.drop(*[f"_g_{level}" for level in levels])


def _crossing(rows: DataFrame, bucket: str, cap: float) -> DataFrame:
    """Per day: the first bucket whose spend passes the cap, and the spend before it."""
    totals = rows.groupBy("day", bucket).agg(F.sum("cost_usd").alias("cost"), F.first("before").alias("before"))
    running = Window.partitionBy("day").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("upto", F.col("before") + F.sum("cost").over(running))
    return totals.where(F.col("upto") > cap).groupBy("day").agg(
        F.min(F.struct(bucket, (F.col("upto") - F.col("cost")).alias("before"), F.col("upto").alias("spent_usd"))).alias("x")
    )


def spend_cap_breach(priced: DataFrame, cap: float = config.DAILY_CAP_USD) -> DataFrame:
    """First call of each day that takes the day's spend above the cap.

    The crossing is narrowed down on totals: the second, then the instant, then
    the call. No step orders more than a day's seconds, a second's instants or
    the calls of one instant.
    """
    rows = priced.select("day", "ts", "call_id", "cost_usd", F.date_trunc("second", "ts").alias("second"), F.lit(0.0).alias("before"))
    for bucket in ("second", "ts"):
        inside = _crossing(rows, bucket, cap).select("day", F.col(f"x.{bucket}").alias(bucket), "x.before")
        rows = rows.drop("before").join(inside, ["day", bucket])
    return _crossing(rows, "call_id", cap).select("day", "x.call_id", "x.spent_usd")


def cache_savings(priced: DataFrame, by: str = "model") -> DataFrame:
    totals = priced.groupBy(by).agg(
        F.sum("cache_read_tokens").alias("read_tokens"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.sum("cost_uncached_usd").alias("cost_uncached_usd"),
    )
    return totals.withColumn("read_share", F.try_divide("read_tokens", "input_tokens")).withColumn(
        "saved_usd", F.col("cost_uncached_usd") - F.col("cost_usd")
    )


def rolling_failures(
    calls: DataFrame, keys: list[str], order: list[str], window: int = config.ALARM_WINDOW,
    ratio: float = config.ALARM_RATIO, max_group: int = config.MAX_GROUP_ROWS,
) -> DataFrame:
    """Failure share of the last `window` calls; alarms only once the window is full."""

    def columns(spec):
        last = spec.rowsBetween(-(window - 1), 0)
        failed = F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)).over(last)
        return {"failure_ratio": failed, "in_window": F.count(F.lit(1)).over(last)}

    rows = over_order(calls, keys, order, columns, before=window - 1, max_group=max_group)
    alarm = (F.col("in_window") == window) & (F.col("failure_ratio") >= ratio)
    return rows.withColumn("alarm", alarm)


def allowed_pairs(spark: SparkSession, transitions: dict | None = None) -> DataFrame:
    table = (transitions or config.RUN_TRANSITIONS).items()
    pairs = [{"from_status": a, "to_status": b} for a, bs in table for b in bs]
    return literal_table(spark, pairs, "from_status string, to_status string")


def transition_audit(
    log: DataFrame, allowed: DataFrame, initial: str = "pending", max_group: int = config.MAX_GROUP_ROWS
) -> DataFrame:
    """Status pairs that may not follow each other; a log must begin with `initial`.

    `log`: run_id, status, ts, seq.
    """
    rows = over_order(
        log, ["run_id"], ["ts", "seq"], lambda w: {"from_status": F.lag("status").over(w)}, before=1, max_group=max_group
    )
    pairs = rows.withColumnRenamed("status", "to_status").where(
        F.col("from_status").isNotNull() | (F.col("to_status") != initial)
    )
    return pairs.join(allowed, ["from_status", "to_status"], "left_anti").select("run_id", "seq", "from_status", "to_status")


def status_changes(
    log: DataFrame, terminal: list[str] = config.TERMINAL_STATUSES, max_group: int = config.MAX_GROUP_ROWS
) -> DataFrame:
    """Rows where the status differs from the one before, up to the first terminal one."""
    ends = log.where(F.col("status").isin(terminal)).groupBy("run_id").agg(
        F.min(F.struct("ts", "seq")).alias("_end")
    )
    live = log.join(ends, "run_id", "left").where(F.col("_end").isNull() | (F.struct("ts", "seq") <= F.col("_end")))
    rows = over_order(
        live.drop("_end"), ["run_id"], ["ts", "seq"], lambda w: {"_prev": F.lag("status").over(w)}, before=1,
        max_group=max_group,
    )
    return rows.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("status"))).drop("_prev")


def stage_durations(log: DataFrame, max_group: int = config.MAX_GROUP_ROWS) -> DataFrame:
    """Seconds spent in each status, per run and status."""
    seconds = lambda c: F.unix_micros(F.to_timestamp(c)) / 1e6

    def columns(spec):
        return {"_left": F.lead("ts").over(spec)}

    rows = over_order(log, ["run_id"], ["ts", "seq"], columns, after=1, max_group=max_group)
    spent = seconds(F.col("_left")) - seconds(F.col("ts"))
    return rows.where("_left IS NOT NULL").groupBy("run_id", "status").agg(
        F.sum(spent).alias("seconds"), F.count(F.lit(1)).alias("visits")
    )


def route_failures(failed: DataFrame, max_attempts: int = config.MAX_ATTEMPTS) -> DataFrame:
    """Failed jobs go back with one more attempt, or to the dead letters with their reason."""
    again = F.col("attempt") < max_attempts
    return (
        failed.withColumn("route", F.when(again, "retry").otherwise("dead_letter"))
        .withColumn("next_attempt", F.when(again, F.col("attempt") + 1))
        .withColumn("reason", F.when(~again, F.col("reason")))
    )
