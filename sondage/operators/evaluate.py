"""Scoring the analyses against planted defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage import config
from sondage.operators.ordered import over_order
from sondage.session import literal_table

NOTABLE = ["medium", "high"]


def observed_classes(
    shift: DataFrame, irt: DataFrame, redundancy: DataFrame, screener: DataFrame, quota: DataFrame
) -> DataFrame:
    """(run_id, defect_class) bag: one entry per notable question flag, one per notable survey-level kind."""
    notable = F.col("severity").isin(NOTABLE)
    entry = lambda df, name: df.select("run_id", F.lit(name).alias("defect_class"))
    return (
        entry(shift.where(notable), "leading_wording")
        .unionByName(entry(irt.where(notable), "double_barreled"))
        .unionByName(entry(redundancy.where(notable).select("run_id").distinct(), "redundant_pair"))
        .unionByName(entry(screener.where("severity = 'high'").select("run_id").distinct(), "infeasible_screener"))
        .unionByName(entry(quota.where(notable).select("run_id").distinct(), "infeasible_screener"))
    )


def tally(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """True positives, false positives and misses per class and severity.

    `outcomes`: expected_class (NULL = clean), severity and the observed bag. A
    hit counts once per survey, a false positive once per bag entry; a clean
    survey's false positives are charged to subtle. Everything is added up in
    one pass without joining.
    """
    expected = F.col("expected_class")
    severity = F.when(expected.isNull(), "subtle").otherwise(F.coalesce("severity", F.lit("moderate")))
    hit = F.coalesce(F.array_contains("observed", expected), F.lit(False))
    row = lambda cls, tp, fp, fn: F.struct(
        cls.alias("defect_class"), tp.cast("int").alias("tp"), fp.cast("int").alias("fp"), fn.cast("int").alias("fn")
    )
    own = F.when(expected.isNotNull(), F.array(row(expected, hit, F.lit(0), ~hit))).otherwise(
        F.array().cast("array<struct<defect_class:string,tp:int,fp:int,fn:int>>")
    )
    wrong = F.transform(
        F.filter("observed", lambda c: expected.isNull() | (c != expected)), lambda c: row(c, F.lit(0), F.lit(1), F.lit(0))
    )
    entries = outcomes.select(*by, severity.alias("severity"), F.explode(F.concat(own, wrong)).alias("e"))
    return entries.groupBy(*by, "e.defect_class", "severity").agg(
        *[F.sum(f"e.{c}").alias(c) for c in ("tp", "fp", "fn")]
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1, each 0 when its denominator is."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", _ratio(2 * p * r, p + r))


def calibration_f1(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Scores per cell, per class and overall (mean F1 over all six classes)."""
    cells = [{"defect_class": c, "severity": s} for c in config.DEFECT_CLASSES for s in config.DEFECT_SEVERITIES]
    grid = literal_table(spark, cells, "defect_class string, severity string")
    filled = grid.join(counts, ["defect_class", "severity"], "left").fillna(0, ["tp", "fp", "fn"])
    sums = filled.rollup("defect_class", "severity").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.grouping_id().alias("_level"),
    ).where("_level < 3")
    rows = scores(sums).withColumn("level", F.when(F.col("_level") == 0, "cell").otherwise("class")).drop("_level")
    overall = rows.where("level = 'class'").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
    )
    overall = overall.withColumn("level", F.lit("overall")).withColumn("defect_class", F.lit("ALL"))
    out = rows.unionByName(overall.withColumn("severity", F.lit("ALL")))
    return out.fillna("ALL", ["severity"])


def macro_f1(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Overall F1 per group, classes never seen counting as 0."""
    per_class = scores(counts.groupBy(*by, "defect_class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    return per_class.groupBy(*by).agg((F.sum("f1") / len(config.DEFECT_CLASSES)).alias("f1_overall"))


def f1_regression(
    history: DataFrame, gate: float = config.F1_DROP_GATE, max_group: int = config.MAX_GROUP_ROWS
) -> DataFrame:
    """Change against the previous calibration; a drop beyond the gate is a regression."""
    rows = over_order(
        history.withColumn("_all", F.lit(0)), ["_all"], ["completed_at", "revision"],
        lambda w: {"change": F.col("f1_overall") - F.lag("f1_overall").over(w)}, before=1, max_group=max_group,
    )
    return rows.drop("_all").withColumn("regressed", F.coalesce(F.col("change") < -gate, F.lit(False)))
