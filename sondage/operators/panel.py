"""Audience filters, weighted panels without replacement and persona rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage import config
from sondage.functions import people
from sondage.functions.hashing import uniform
from sondage.session import cut_lineage


def audience_predicate(
    age_min=18, age_max=65, genders=("any",), income_min=None, income_max=None, education_min="any", states=()
) -> Column:
    """Filter for one audience; every condition can be pushed to the scan or pruned."""
    keep = F.col("AGEP").between(age_min, age_max)
    if genders and "any" not in genders:
        keep &= F.col("SEX").isin([code for name, code in (("male", 1), ("female", 2)) if name in genders])
    income = F.coalesce(F.col("PINCP"), F.lit(0.0))
    if income_min is not None:
        keep &= income >= income_min
    if income_max is not None:
        keep &= income <= income_max
    if education_min != "any":
        keep &= people.education_rank(F.col("SCHL")) >= config.EDUCATION_MIN[education_min]
    known = [code for code, usps in config.STATES.items() if usps in set(states)]
    if known:
        keep &= F.col("ST").isin(known)
    return keep


def filter_audience(population: DataFrame, **audience) -> DataFrame:
    return population.where(audience_predicate(**audience))


def normalise_audiences(audiences: DataFrame) -> DataFrame:
    """Audience rows as numeric bounds; NULL stands for no restriction.

    Input: audience_id, age_min, age_max, genders, income_min, income_max,
    education_min, states.
    """
    genders, states = F.col("genders"), F.col("states")
    open_gender = genders.isNull() | (F.size(genders) == 0) | F.array_contains(genders, "any")
    sexes = F.transform(
        F.filter(genders, lambda g: g.isin("male", "female")), lambda g: F.when(g == "male", 1).otherwise(2)
    )
    codes = F.create_map(*[F.lit(x) for code, usps in config.STATES.items() for x in (usps, code)])
    known = F.filter(F.transform(states, lambda s: F.try_element_at(codes, s)), lambda c: c.isNotNull())
    return audiences.select(
        "audience_id",
        F.col("age_min").alias("age_lo"),
        F.col("age_max").alias("age_hi"),
        F.when(~open_gender, F.array_distinct(sexes)).alias("sexes"),
        F.when(F.size(known) > 0, F.array_distinct(known)).alias("states"),
        F.col("income_min").cast("double").alias("inc_min"),
        F.col("income_max").cast("double").alias("inc_max"),
        F.coalesce(
            F.try_element_at(
                F.create_map(*[F.lit(x) for k, r in config.EDUCATION_MIN.items() for x in (k, r)]), F.col("education_min")
            ),
            F.lit(0),
        ).alias("edu_min"),
    )


def _fits() -> Column:
    unset = lambda c: F.col(c).isNull()
    return (
        (unset("sexes") | F.array_contains(F.col("sexes"), F.col("SEX")))
        & (unset("states") | F.array_contains(F.col("states"), F.col("ST")))
        & (unset("inc_min") | (F.col("_inc") >= F.col("inc_min")))
        & (unset("inc_max") | (F.col("_inc") <= F.col("inc_max")))
        & ((F.col("edu_min") == 0) | (F.col("_edu") >= F.col("edu_min")))
    )


def _with_bounds_columns(population: DataFrame) -> DataFrame:
    income = F.coalesce(F.col("PINCP"), F.lit(0.0)).cast("double")
    return population.withColumn("_inc", income).withColumn("_edu", people.education_rank(F.col("SCHL")))


def _by_age(bounds: DataFrame) -> DataFrame:
    return bounds.where("age_lo <= age_hi").withColumn("AGEP", F.explode(F.sequence(F.col("age_lo"), F.col("age_hi"))))


def audience_members(population: DataFrame, audiences: DataFrame) -> DataFrame:
    """Rows of the population that fit each audience, all of them.

    An equi-join on single years of age with the other bounds as residual
    conditions. No side is forced to broadcast: the audience side is broadcast
    when its measured size is small, and otherwise the join shuffles and splits
    heavy ages.
    """
    joined = _with_bounds_columns(population).join(_by_age(normalise_audiences(audiences)), "AGEP").where(_fits())
    return joined.select("audience_id", *population.columns)


def sampling_key(person: Column, weight: Column, seed: int) -> Column:
    """Exponential key: the n smallest are a weighted draw without replacement."""
    return -F.ln(uniform(seed, person)) / weight


def weighted_sample(population: DataFrame, n: int, seed: int = config.SEED, person: str = "person_id") -> DataFrame:
    """min(n, rows) rows drawn in proportion to PWGTP; a top-n, not a full sort."""
    if "PWGTP" not in population.columns:
        raise ValueError("population has no PWGTP column")
    keyed = population.where("PWGTP > 0").withColumn("_key", sampling_key(F.col(person), F.col("PWGTP"), seed))
    return keyed.orderBy("_key", person).limit(n).drop("_key")


LEVELS = 40


def _candidates(keyed: DataFrame, audiences: DataFrame, n: int) -> DataFrame:
    """Members that can be among an audience's n smallest keys, and no audience short of them.

    The key does not depend on the audience, so small keys are candidates
    everywhere. People get a level, one more per halving of the key's quantile.
    Each audience joins only the levels that should hold 4n of its members; its
    true size, counted without joining, tells whether that sufficed, and the
    audiences it did not suffice for join everybody.
    """
    from sondage.operators.feasibility import audience_match_counts

    quantiles = F.percentile_approx("_key", [2.0 ** -i for i in range(1, LEVELS)], 100_000)
    cuts = keyed.agg(quantiles.alias("q")).first()["q"] or []
    level = F.lit(0)
    for cut in cuts:
        level = level + (F.col("_key") <= F.lit(cut)).cast("int")
    sizes = cut_lineage(audience_match_counts(keyed.drop("_key"), audiences).select("audience_id", "people"))
    deepest = F.floor(F.log2(F.greatest(F.col("people") / F.lit(4.0 * n), F.lit(1.0)))).cast("int")
    bounds = normalise_audiences(audiences).join(sizes, "audience_id").where("people > 0")
    first = _by_age(bounds.withColumn("from_level", F.least(deepest, F.lit(len(cuts)))))
    first = first.withColumn("_level", F.explode(F.sequence(F.col("from_level"), F.lit(len(cuts)))))
    people_rows = _with_bounds_columns(keyed).withColumn("_level", level)
    kept = ["audience_id", *keyed.columns]
    near = people_rows.join(first, ["AGEP", "_level"]).where(_fits()).select(*kept)
    found = near.groupBy("audience_id").agg(F.count(F.lit(1)).alias("found"))
    short = cut_lineage(
        sizes.join(found, "audience_id", "left").where(
            F.coalesce("found", F.lit(0)) < F.least(F.col("people"), F.lit(n))
        ).select("audience_id")
    )
    if short.isEmpty():
        return near
    rest = audience_members(keyed, audiences.join(short, "audience_id", "left_semi"))
    return near.join(short, "audience_id", "left_anti").select(*kept).unionByName(rest.select(*kept))


def build_panels(
    population: DataFrame, audiences: DataFrame, n: int, seed: int = config.SEED, person: str = "person_id",
    styles: dict | None = None,
) -> DataFrame:
    """A weighted panel of persona rows for every audience at once.

    Only likely candidates are tested against an audience, with an exact second
    pass where they run short. The rank
    filter lets Spark keep n rows per audience in each task before the shuffle,
    so a large audience sends no more than that to one task.
    """
    # drawn once, by as many tasks as a shuffle has, and stored: a condition on the key's level would draw it for every level
    spread = population.where("PWGTP > 0").repartition(int(population.sparkSession.conf.get("spark.sql.shuffle.partitions")), person)
    keyed = cut_lineage(spread.withColumn("_key", sampling_key(F.col(person), F.col("PWGTP"), seed)))
    members = _candidates(keyed, audiences, n)
    order = Window.partitionBy("audience_id").orderBy("_key", person)
    ranked = members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    suffix = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "audience_id", F.col(person).cast("string"))), 1, 8)
    persona = F.concat(F.lit("p_"), F.format_string("%04d", F.col("rank") - 1), F.lit("_"), suffix)
    ident = F.concat_ws("|", "audience_id", F.col(person).cast("string"))
    columns = people.demographic() | people.traits(ident, seed, styles)
    return ranked.select(
        "audience_id", "rank", person, persona.alias("persona_id"), *[c.alias(k) for k, c in columns.items()]
    )


def empty_audiences(population: DataFrame, audiences: DataFrame) -> DataFrame:
    """Audiences that match nobody; a panel cannot be drawn for them."""
    return audiences.join(audience_members(population, audiences).select("audience_id").distinct(), "audience_id", "left_anti")


def write_panel_json(panels: DataFrame, path: str) -> None:
    """Persona rows as JSON lines, demographics and style nested, one folder per audience."""
    style = list(config.TRAITS)
    who = ["age", "sex", "education", "income", "state", "race", "marital"]
    panels.select(
        "audience_id", F.col("persona_id").alias("id"), F.struct(*who).alias("demographic"),
        F.struct(*style).alias("response_style"),
    ).write.mode("overwrite").partitionBy("audience_id").json(path)
