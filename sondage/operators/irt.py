"""Item discrimination: dichotomised items and a two-parameter logistic fit.

The fit is marginal maximum likelihood by expectation-maximisation, all surveys
at once. Respondents collapse to counted answer patterns, which are partitioned
by run once and do not move again: each iteration joins the parameters of all
open runs to them in place, and only expected counts per item and node move.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.scalars import discrimination_label, discrimination_severity, fixed2
from sondage.operators import kernels
from sondage.session import checkpoint_root, cut_lineage, ship_by_value

ship_by_value(kernels)
BOUNDS_A, BOUNDS_B = (0.05, 4.0), (-5.0, 5.0)
NODES, SPAN = 21, 4.0
TASK_PATTERNS = 20_000  # patterns that a task sums in an iteration
STATE = (
    "run_id string, param_item array<string>, param_a array<double>, param_b array<double>, slices int, "
    "iterations int, converged boolean, open boolean"
)


def item_medians(items: DataFrame) -> DataFrame:
    """Exact median per item from its value counts."""
    counts = items.groupBy("run_id", "item", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("run_id", "item").agg(
        F.percentile("value", F.lit(0.5), F.col("n")).alias("median"), F.sum("n").alias("n_personas")
    )


def dichotomize(items: DataFrame) -> DataFrame:
    """y = 1 above the item's median, strictly; a missing answer stays missing."""
    rows = items.where(F.col("value").isNotNull())
    return rows.join(item_medians(rows).select("run_id", "item", "median"), ["run_id", "item"]).select(
        "run_id", "persona_id", "item", (F.col("value") > F.col("median")).cast("int").alias("y")
    )


def item_response(theta, a, b):
    """P(y = 1) with the logit and the probability kept off their limits."""
    z = F.greatest(F.least(a * (theta - b), F.lit(30.0)), F.lit(-30.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))


def negative_log_likelihood(binary: DataFrame) -> DataFrame:
    """Per run, for rows carrying y, theta, a and b."""
    p = item_response(F.col("theta"), F.col("a"), F.col("b"))
    term = F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return binary.groupBy("run_id").agg((-F.sum(term)).alias("nll"), F.count(F.lit(1)).alias("n"))


def _respondents(binary: DataFrame) -> DataFrame:
    """Sorted (item, y) list per respondent, bounded by the questionnaire's length."""
    return binary.groupBy("run_id", "persona_id").agg(
        F.array_sort(F.collect_list(F.struct("item", "y"))).alias("x")
    )


def answer_patterns(binary: DataFrame) -> DataFrame:
    """Distinct answer patterns with their counts."""
    return (
        _respondents(binary)
        .groupBy("run_id", "x")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("run_id", F.col("x.item").alias("items"), F.col("x.y").alias("ys"), "n")
    )


def _packed(parameters: DataFrame) -> DataFrame:
    """One row per run with its items' parameters as arrays."""
    rows = F.array_sort(F.collect_list(F.struct("item", "a", "b")))
    return parameters.groupBy("run_id").agg(rows.alias("p")).select(
        "run_id", F.col("p.item").alias("param_item"), F.col("p.a").alias("param_a"), F.col("p.b").alias("param_b")
    )


def posterior_counts(patterns: DataFrame, parameters: DataFrame, nodes: int = NODES, span: float = SPAN) -> DataFrame:
    """Expected answers (n*) and right answers (r*) per run, item and node."""
    columns = [f"r{q}" for q in range(nodes)] + [f"n{q}" for q in range(nodes)]
    schema = "run_id string, item string, " + ", ".join(f"{c} double" for c in columns)
    partial = patterns.join(_packed(parameters), "run_id").mapInPandas(kernels.expected_counts(nodes, span), schema)
    return partial.groupBy("run_id", "item").agg(*[F.sum(c).alias(c) for c in columns])


def abilities(binary: DataFrame, parameters: DataFrame, nodes: int = NODES, span: float = SPAN) -> DataFrame:
    """Expected a-posteriori trait per respondent."""
    people = _respondents(binary).select(
        "run_id", "persona_id", F.col("x.item").alias("items"), F.col("x.y").alias("ys")
    )
    return people.join(_packed(parameters), "run_id").mapInPandas(
        kernels.abilities(nodes, span), "run_id string, persona_id string, theta double"
    )


def item_statistics(patterns: DataFrame) -> DataFrame:
    """Share right, answers and sample variance per item, from the counted patterns."""
    cells = patterns.select("run_id", "n", F.explode(F.arrays_zip("items", "ys")).alias("c"))
    totals = cells.groupBy("run_id", F.col("c.items").alias("item")).agg(
        F.sum("n").alias("n_personas"), F.sum(F.col("n") * F.col("c.ys")).alias("_right")
    )
    p = F.col("_right") / F.col("n_personas")
    variance = F.when(F.col("n_personas") > 1, p * (1 - p) * F.col("n_personas") / (F.col("n_personas") - 1)).otherwise(0.0)
    return totals.select("run_id", "item", p.alias("p"), "n_personas", variance.alias("variance"))


def starting_values(patterns: DataFrame) -> DataFrame:
    """Slope 1 and the logit of the share right, for runs of at least the minimum shape."""
    stats = item_statistics(patterns)
    persons = patterns.groupBy("run_id").agg(F.sum("n").alias("persons"))
    items = stats.groupBy("run_id").agg(F.count(F.lit(1)).alias("m"))
    enough = (F.col("persons") >= config.IRT_MIN_PERSONS) & (F.col("m") >= config.IRT_MIN_ITEMS)
    fitted = items.join(persons, "run_id").where(enough).select("run_id")
    p = F.greatest(F.least(F.col("p"), F.lit(0.99)), F.lit(0.01))
    return stats.join(fitted, "run_id", "left_semi").select(
        "run_id", "item", F.lit(1.0).alias("a"), (-F.ln(p / (1 - p))).alias("b"), "n_personas", "variance"
    )


def spread_patterns(patterns: DataFrame, task_patterns: int = TASK_PATTERNS) -> DataFrame:
    """The patterns with the number of slices of their run and their own slice, partitioned by both.

    A run is cut into slices of about `task_patterns`, so one very large run is many tasks and a small one is a single key.
    """
    sizes = patterns.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / task_patterns).cast("int").alias("slices"))
    sliced = patterns.join(sizes, "run_id").withColumn("slice", F.pmod(F.xxhash64("items", "ys"), F.col("slices")).cast("int"))
    tasks = max(1, -(-patterns.count() // task_patterns))
    return sliced.repartition(tasks, "run_id", "slice").sortWithinPartitions("run_id", "slice")


def fit_discrimination(
    binary: DataFrame,
    max_iterations: int = 200,
    tolerance: float = 0.005,
    nodes: int = NODES,
    span: float = SPAN,
    task_patterns: int = TASK_PATTERNS,
) -> DataFrame:
    """(run, item, a, b, iterations, converged, n_personas, variance) per fitted item.

    Runs below the minimum shape are left out. Answers become counted patterns, partitioned once by run and slice. A job
    takes a step for all runs that are still open: their parameters, one row a run, are dealt to the slices and joined
    where the patterns lie; a run of one slice goes on there until it settles, the sums of the others are added up per run
    and its items improve. So the patterns are scanned as often as the slowest of the large runs takes steps, however many
    runs there are, and nothing passes through the driver. The parameters of each step are a table in the shared folder.
    A run closes when it settles itself, whatever the other runs do.
    """
    spark = binary.sparkSession
    counted = answer_patterns(binary).persist(StorageLevel.MEMORY_AND_DISK)
    # stored once with their partitioning, so an iteration neither recomputes nor shuffles them; kept at hand as well
    patterns = cut_lineage(spread_patterns(counted, task_patterns)).persist(StorageLevel.MEMORY_AND_DISK)
    start = cut_lineage(starting_values(counted))
    counted.unpersist()
    path = f"{checkpoint_root(spark)}/fit-{uuid.uuid4().hex}"
    slices = patterns.groupBy("run_id").agg(F.max("slices").alias("slices"))
    _packed(start).join(slices, "run_id").select(
        "*", F.lit(0).alias("iterations"), F.lit(False).alias("converged"), F.lit(True).alias("open")
    ).write.parquet(f"{path}/step=0")
    stored = lambda step: spark.read.schema(STATE).parquet(f"{path}/step={step}")
    done = 0
    while done < max_iterations:
        live = stored(done).where(F.col("open") & (F.col("iterations") < max_iterations))
        if live.isEmpty():
            break
        dealt = live.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        joined = patterns.drop("slices").join(dealt, ["run_id", "slice"]).sortWithinPartitions("run_id")
        counts = joined.mapInPandas(
            kernels.run_steps(nodes, span, tolerance, max_iterations, BOUNDS_A, BOUNDS_B), f"{STATE}, counts array<double>")
        same = [F.first(c).alias(c) for c in kernels.STATE[1:]]
        runs = counts.groupBy("run_id").agg(F.collect_list("counts").alias("counts"), *same)
        done += 1
        runs.mapInPandas(
            kernels.improve_runs(nodes, span, tolerance, BOUNDS_A, BOUNDS_B), STATE
        ).write.parquet(f"{path}/step={done}")
    patterns.unpersist()
    steps = spark.read.schema(f"{STATE}, step int").parquet(path)
    fitted = steps.where(~F.col("open") | (F.col("step") == done) | (F.col("iterations") == max_iterations)).select(
        "run_id", F.explode(F.arrays_zip("param_item", "param_a", "param_b")).alias("p"), "iterations", "converged")
    return fitted.select(
        "run_id", F.col("p.param_item").alias("item"), F.col("p.param_a").alias("a"), F.col("p.param_b").alias("b"), "iterations", "converged"
    ).join(start.drop("a", "b"), ["run_id", "item"])


def variance_proxy(binary: DataFrame) -> DataFrame:
    """Stand-in when the fit did not converge: sample variance of the binary item."""
    stats = binary.groupBy("run_id", "item").agg(
        F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("discrimination"), F.count(F.lit(1)).alias("n_personas")
    )
    return stats.withColumn(
        "severity", F.when(F.col("discrimination") < config.PROXY_LOW_VARIANCE, "high").otherwise("none")
    )


def irt_flags(fit: DataFrame) -> DataFrame:
    """One flag per fitted item; runs that did not converge fall back to the variance proxy."""
    ok = F.col("converged")
    a = F.when(ok, F.col("a")).otherwise(F.col("variance"))
    label = F.when(ok, discrimination_label(F.col("a"))).otherwise("experimental")
    proxy = F.when(F.col("variance") < config.PROXY_LOW_VARIANCE, "high").otherwise("none")
    return fit.select(
        "run_id", F.col("item").alias("question_id"), a.alias("discrimination"), label.alias("interpretation"),
        ok.alias("convergence_ok"), "n_personas",
        F.when(ok, discrimination_severity(F.col("a"))).otherwise(proxy).alias("severity"),
        F.when(~ok, "fit did not converge; variance proxy used").alias("note"),
        F.concat(label, F.lit(" discrimination "), fixed2(a)).alias("summary"),
    )
