"""How much of an audience a quota cell can draw on, for many audiences and cells.

Audiences and cells become boxes over (age, sex, state, education, income).
Population weight inside a box comes from prefix sums over income per exact
combination of the other attributes: boxes look up two points per combination
instead of meeting the population row by row. Boxes with the same bounds are
looked up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage import config
from sondage.functions import people
from sondage.functions.scalars import fixed1, quota_severity
from sondage.operators.panel import normalise_audiences
from sondage.session import cut_lineage

KEY = ["age", "sex_key", "st_key", "edu_key", "known_key"]
MODE = ["any_sex", "any_state", "edu_key", "known_key"]
SHAPE = ["age_lo", "age_hi", "sexes", "states", "edu_min", "known_only", "inc_lo", "inc_hi", "hi_included"]
BUCKET, TOP = 5_000.0, float("inf")  # an open bound lies above every income
ANY = -1


def normalise_cells(cells: DataFrame) -> DataFrame:
    """Cell maps as bounds; unknown keys and values are wildcards.

    Input: audience_id, cell_id, cell (map of string), target_n.
    """
    value = lambda key: F.try_element_at(F.col("cell"), F.lit(key))
    bounds = lambda table: F.create_map(
        *[x for k, (lo, hi) in table.items() for x in (F.lit(k), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))]
    )
    codes = F.create_map(*[F.lit(x) for code, usps in config.STATES.items() for x in (usps, code)])
    age = F.try_element_at(bounds(config.AGE_BUCKETS), F.coalesce(value("age_bucket"), F.lit("")))
    income = F.try_element_at(bounds(config.INCOME_BRACKETS), F.coalesce(value("income_bracket"), F.lit("")))
    return cells.select(
        "audience_id", "cell_id", "cell", "target_n",
        age["lo"].cast("int").alias("c_age_lo"), age["hi"].cast("int").alias("c_age_hi"),
        F.when(value("gender") == "male", 1).when(value("gender") == "female", 2).alias("c_sex"),
        income["lo"].alias("c_inc_lo"), income["hi"].alias("c_inc_hi"),
        F.try_element_at(codes, F.coalesce(value("state"), F.lit(""))).alias("c_state"),
    )


def unknown_cell_entries(cells: DataFrame) -> DataFrame:
    """Cell keys and values that were ignored."""
    known = (
        F.when(F.col("key") == "age_bucket", F.col("value").isin(list(config.AGE_BUCKETS)))
        .when(F.col("key") == "gender", F.col("value").isin("male", "female"))
        .when(F.col("key") == "income_bracket", F.col("value").isin(list(config.INCOME_BRACKETS)))
        .when(F.col("key") == "state", F.col("value").isin(list(config.STATES.values())))
    )
    entries = cells.select("audience_id", "cell_id", F.explode("cell").alias("key", "value"))
    reason = F.when(known.isNull(), "unknown_key").otherwise("unknown_value")
    return entries.where(~F.coalesce(known, F.lit(False))).select(
        "audience_id", "cell_id", "key", "value", reason.alias("reason")
    )


def audience_boxes(audiences: DataFrame) -> DataFrame:
    return normalise_audiences(audiences).select(
        F.col("audience_id").alias("box_id"), "age_lo", "age_hi", "sexes", "states", "edu_min",
        F.lit(False).alias("known_only"), F.col("inc_min").alias("inc_lo"),
        F.col("inc_max").alias("inc_hi"), F.lit(True).alias("hi_included"),
    )


def cell_boxes(audiences: DataFrame, cells: DataFrame) -> DataFrame:
    """Audience and cell conditions intersected."""
    both = normalise_cells(cells).join(normalise_audiences(audiences), "audience_id")
    one = lambda own, cell: F.when(F.col(own).isNull(), F.when(F.col(cell).isNotNull(), F.array(cell))).otherwise(
        F.when(F.col(cell).isNull(), F.col(own)).otherwise(F.array_intersect(own, F.array(cell)))
    )
    cell_first = F.col("c_inc_hi").isNotNull() & (F.col("inc_max").isNull() | (F.col("c_inc_hi") <= F.col("inc_max")))
    return both.select(
        F.concat_ws("#", "audience_id", "cell_id").alias("box_id"),
        F.greatest("age_lo", "c_age_lo").alias("age_lo"), F.least("age_hi", "c_age_hi").alias("age_hi"),
        one("sexes", "c_sex").alias("sexes"), one("states", "c_state").alias("states"), "edu_min",
        F.col("c_inc_lo").isNotNull().alias("known_only"),
        F.greatest("inc_min", "c_inc_lo").alias("inc_lo"),
        F.when(cell_first, F.col("c_inc_hi")).otherwise(F.col("inc_max")).alias("inc_hi"),
        (~cell_first).alias("hi_included"),
    )


def _probes(boxes: DataFrame) -> DataFrame:
    """Two signed income points per attribute combination of a box."""
    wild = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(ANY))).otherwise(F.col(c))
    upper = F.struct(
        F.coalesce("inc_hi", F.lit(TOP)).alias("x"),
        F.when(F.col("inc_hi").isNull() | F.col("hi_included"), 1).otherwise(-1).alias("side"),
        F.lit(1).alias("sign"),
    )
    lower = F.struct(F.col("inc_lo").alias("x"), F.lit(-1).alias("side"), F.lit(-1).alias("sign"))
    points = F.when(F.col("inc_lo").isNull(), F.array(upper)).otherwise(F.array(upper, lower))
    empty = F.col("inc_lo").isNotNull() & (F.col("inc_lo") > F.coalesce("inc_hi", F.lit(TOP)))
    return (
        boxes.where((F.col("age_lo") <= F.col("age_hi")) & ~empty)
        .withColumn("any_sex", F.col("sexes").isNull())
        .withColumn("any_state", F.col("states").isNull())
        .withColumn("age", F.explode(F.sequence("age_lo", "age_hi")))
        .withColumn("sex_key", F.explode(wild("sexes")))
        .withColumn("st_key", F.explode(wild("states")))
        .withColumn("p", F.explode(points))
        .select(
            "box_id", "age", "sex_key", "st_key", F.col("edu_min").alias("edu_key"),
            F.col("known_only").alias("known_key"), "any_sex", "any_state", "p.x", "p.side", "p.sign",
        )
    )


def box_totals(population: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, weight, people) for every box; boxes nobody fits get zeros."""
    numbered = box_shapes(boxes)
    totals = cut_lineage(_shape_totals(population, numbered.withColumnRenamed("shape_id", "box_id")))
    found = numbered.join(totals, numbered["shape_id"] == totals["box_id"]).select(*SHAPE, "weight", "people")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in SHAPE]
    return boxes.alias("b").join(found.alias("f"), same).select("b.box_id", "f.weight", "f.people")


def box_shapes(boxes: DataFrame) -> DataFrame:
    """The distinct bounds of the boxes, numbered; stored, since the numbers depend on the tasks."""
    return cut_lineage(boxes.select(*SHAPE).distinct().withColumn("shape_id", F.monotonically_increasing_id()))


def _shape_totals(population: DataFrame, boxes: DataFrame) -> DataFrame:
    probes = cut_lineage(_probes(boxes))
    # at most 2 x 2 x 5 x 2 ways to leave attributes open, whatever the data
    modes = [tuple(r) for r in probes.select(*MODE).distinct().collect()]
    bucket = F.floor(F.least(F.col("x"), F.lit(1.0e9)) / BUCKET).alias("bucket")
    # incomes are told apart only by the points asked for: people between two points are one row before anything is expanded
    cuts = probes.select("x", bucket).distinct().groupBy("bucket").agg(F.collect_list("x").alias("cuts"))
    rows = population.select(
        F.col("AGEP").alias("age"), F.col("SEX").alias("sex"), F.col("ST").alias("st"),
        people.education_rank(F.col("SCHL")).alias("edu"), F.col("PINCP").isNotNull().alias("known"),
        F.coalesce(F.col("PINCP"), F.lit(0.0)).cast("double").alias("x"), "PWGTP",
    ).withColumn("bucket", bucket).join(cuts, "bucket", "left")
    below = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("x"))), F.lit(0))
    profile = rows.groupBy(
        "age", "sex", "st", "edu", "known", "bucket", below.alias("below"), F.coalesce(F.array_contains("cuts", F.col("x")), F.lit(False)).alias("at_cut"),
    ).agg(F.min("x").alias("x"), F.sum("PWGTP").cast("double").alias("weight"), F.count(F.lit(1)).cast("double").alias("people"))
    options = [
        F.when(
            (F.lit(edu == 0) | (F.col("edu") >= edu)) & (F.lit(not known) | F.col("known")),
            F.struct(
                (F.lit(ANY) if any_sex else F.col("sex")).alias("sex_key"),
                (F.lit(ANY) if any_state else F.col("st")).alias("st_key"),
                F.lit(edu).alias("edu_key"), F.lit(known).alias("known_key"),
            ),
        )
        for any_sex, any_state, edu, known in modes
    ]
    no_key = F.array().cast("array<struct<sex_key:int,st_key:int,edu_key:int,known_key:boolean>>")
    keyed = profile.withColumn("k", F.explode(F.filter(F.array(*options), lambda k: k.isNotNull()) if options else no_key))
    stock = keyed.groupBy("age", "k.sex_key", "k.st_key", "k.edu_key", "k.known_key", "x").agg(
        F.sum("weight").alias("weight"), F.sum("people").alias("people")
    )
    points = probes.select(*KEY, "x", "side").distinct()
    line = stock.select(*KEY, "x", F.lit(0).alias("side"), "weight", "people", bucket).unionByName(
        points.select(*KEY, "x", "side", F.lit(0.0).alias("weight"), F.lit(0.0).alias("people"), bucket)
    )
    inside = Window.partitionBy(*KEY, "bucket").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = line.groupBy(*KEY, "bucket").agg(F.sum("weight").alias("bw"), F.sum("people").alias("bp"))
    buckets = buckets.select(
        *KEY, "bucket", F.coalesce(F.sum("bw").over(before), F.lit(0.0)).alias("w0"),
        F.coalesce(F.sum("bp").over(before), F.lit(0.0)).alias("p0"),
    )
    reached = (
        line.withColumn("w1", F.sum("weight").over(inside))
        .withColumn("p1", F.sum("people").over(inside))
        .where("side <> 0")
        .join(buckets, [*KEY, "bucket"])
        .select(*KEY, "x", "side", (F.col("w0") + F.col("w1")).alias("w"), (F.col("p0") + F.col("p1")).alias("p"))
    )
    totals = (
        probes.join(reached, [*KEY, "x", "side"])
        .groupBy("box_id")
        .agg(F.sum(F.col("sign") * F.col("w")).alias("weight"), F.sum(F.col("sign") * F.col("p")).alias("people"))
    )
    return boxes.select("box_id").join(totals, "box_id", "left").select(
        "box_id", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("people", F.lit(0.0)).cast("bigint").alias("people"),
    )


def audience_match_counts(population: DataFrame, audiences: DataFrame) -> DataFrame:
    return box_totals(population, audience_boxes(audiences)).withColumnRenamed("box_id", "audience_id")


def quota_share(population: DataFrame, audiences: DataFrame, cells: DataFrame) -> DataFrame:
    """Weighted share of each audience that also satisfies the cell, in percent."""
    boxes = audience_boxes(audiences).unionByName(cell_boxes(audiences, cells))
    totals = box_totals(population, boxes)
    inner = totals.select(F.col("box_id").alias("_cell"), F.col("weight").alias("cell_weight"))
    outer = totals.select(F.col("box_id").alias("audience_id"), F.col("weight").alias("audience_weight"))
    pct = F.when(F.col("audience_weight") > 0, F.col("cell_weight") / F.col("audience_weight") * 100).otherwise(0.0)
    return (
        cells.withColumn("_cell", F.concat_ws("#", "audience_id", "cell_id"))
        .join(inner, "_cell")
        .join(outer, "audience_id")
        .select("audience_id", "cell_id", "cell", "target_n", "audience_weight", pct.alias("pct"))
    )


def quota_feasibility(shares: DataFrame) -> DataFrame:
    """Severity and projected completes; an audience matching nobody fails every cell."""
    empty = F.col("audience_weight") <= 0
    text = (
        F.when(empty, "audience matches nobody")
        .when(F.col("severity") == "none", F.concat(fixed1(F.col("pct")), F.lit("% fits the cell")))
        .otherwise(F.concat(F.lit("only "), fixed1(F.col("pct")), F.lit("% fits the cell")))
    )
    return (
        shares.withColumn("severity", quota_severity(F.col("pct")))
        .withColumn("estimated_n", F.floor(F.col("pct") / 100 * F.col("target_n")))
        .withColumn("summary", text)
        .drop("audience_weight")
    )
