"""The calibration loop: plant every defect, show it in recorded answers, analyse, score.

All variants of all surveys are one set of runs; nothing loops over surveys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.hashing import gaussian
from sondage.functions.scalars import lookup
from sondage.operators import evaluate, feasibility, inject, irt, redundancy
from sondage.operators.inject import clip_scale
from sondage.operators.shift import shift_flags
from sondage.operators.skiplogic import skip_logic_flags
from sondage.session import cut_lineage

SIGNATURES = {
    "leading_wording": "shift", "loaded_language": "shift", "double_barreled": "dilute", "fatigue_block": "concentrate",
}


#: Cells that were planted are named by this and their severity.
PLANTED = "planted_"


def _run_id() -> Column:
    return F.concat_ws("|", "survey_id", "defect_class", "severity")


def variant_runs(surveys: DataFrame) -> DataFrame:
    """(run_id, survey_id, defect_class, severity) of the nineteen variants every survey of `surveys` has."""
    return inject.variant_names(surveys.where("survey_id IS NOT NULL")).withColumn("run_id", _run_id())


def variant_questions(questions: DataFrame, seed: int = config.SEED) -> DataFrame:
    """Question rows of all nineteen variants; `source_id` names the question whose answers each one starts from."""
    planted = inject.fan_out(questions, seed)
    ordinal = F.when(F.col("type").isin(config.ORDINAL_TYPES), F.col("question_id"))
    first = questions.groupBy("survey_id").agg(F.min(ordinal).alias("_first"))
    added = F.col("question_id").startswith("FAT_") & (F.col("defect_class") == "fatigue_block")
    source = F.when(added, F.col("_first")).otherwise(F.regexp_replace("question_id", "_redundant$", ""))
    return planted.join(first, "survey_id").withColumn("source_id", source).withColumn("run_id", _run_id()).drop("_first")


def variant_responses(variants: DataFrame, recorded: DataFrame, seed: int = config.SEED) -> DataFrame:
    """Recorded answers carried to every variant, rewritten where a defect was planted.

    `recorded`: survey_id, persona_id, question_id, paraphrase_idx, value.
    """
    answers = recorded.select(
        "survey_id", F.col("question_id").alias("source_id"), "persona_id", "paraphrase_idx", F.col("value").alias("given")
    )
    bounds = lambda i: lookup(F.col("type"), {t: float(b[i]) for t, b in config.SCALE_BOUNDS.items()})
    rows = variants.join(answers, ["survey_id", "source_id"]).withColumn("lo", bounds(0)).withColumn("hi", bounds(1))
    key = [F.col(c) for c in ("run_id", "persona_id", "question_id", "paraphrase_idx")]
    given, lo, hi = F.col("given"), F.col("lo"), F.col("hi")
    mid, c = (lo + hi) / 2, config.TARGET_CORRELATION
    base = F.col("paraphrase_idx") == 0
    signature = lookup(F.col("defect_class"), SIGNATURES)
    twin = F.col("question_id").endswith("_redundant")
    follow = c * (given - mid) + mid + (1 - c * c) ** 0.5 * config.CORRELATION_NOISE * gaussian(seed, "noise", *key)
    shown = (
        F.when(~F.col("planted") | lo.isNull(), given)
        .when(twin & base, clip_scale(follow, lo, hi))
        .when((signature == "shift") & base, clip_scale(given + config.SHIFT_FRACTION * (hi - mid), lo, hi))
        .when(signature == "concentrate", inject.to_middle(given, lo, hi))
        .otherwise(given)
    )
    # the defect is known from the variants, so each half of the union reads its own part of them
    mixed = F.coalesce(F.col("planted") & lo.isNotNull() & (signature == "dilute"), F.lit(False))
    answered = lambda part: part.select("run_id", "persona_id", "question_id", "paraphrase_idx", shown.cast("double").alias("value"))
    return answered(rows.where(~mixed)).unionByName(inject.exchanged(answered(rows.where(mixed)), seed))


def variant_quota_flags(variants: DataFrame, population: DataFrame, audiences: DataFrame, quotas: DataFrame) -> DataFrame:
    """(run_id, cell_id, severity) of each variant's quota cells: the survey's own, and the planted one where there is one.

    `variants`: their question rows, or only their runs as `variant_runs` names them.
    `audiences` and `quotas` name a survey as audience_id. A cell's share does not depend on the variant, so each
    survey's own and planted cells are analysed once and then handed to the variants that have them.
    """
    surveys = variants.select("survey_id").distinct()
    cells = quotas.select("audience_id", "cell_id", "cell", "target_n")
    for severity in config.DEFECT_SEVERITIES:
        planted = inject.inject_quota(surveys, severity)
        cells = cells.unionByName(planted.select(
            F.col("survey_id").alias("audience_id"), F.lit(f"{PLANTED}{severity}").alias("cell_id"), "cell", "target_n"))
    flags = feasibility.quota_feasibility(feasibility.quota_share(population, audiences, cells)).select(
        F.col("audience_id").alias("survey_id"), "cell_id", F.col("severity").alias("found"))
    runs = variants.select("run_id", "survey_id", "defect_class", "severity").distinct()
    own = ~F.col("cell_id").startswith(PLANTED)
    here = (F.col("defect_class") == "infeasible_screener") & (F.col("cell_id") == F.concat(F.lit(PLANTED), "severity"))
    return runs.join(flags, "survey_id").where(own | here).select("run_id", "cell_id", F.col("found").alias("severity"))


def variant_screener_flags(variants: DataFrame, conditions: DataFrame, rules: DataFrame) -> DataFrame:
    """(run_id, flag, severity): skip logic is a survey's own in every variant, so it is analysed once per survey."""
    flags = skip_logic_flags(conditions, rules).select("survey_id", "flag", "severity")
    return variants.select("run_id", "survey_id").distinct().join(flags, "survey_id").drop("survey_id")


def run_calibration(
    spark: SparkSession, questions: DataFrame, recorded: DataFrame, quota_flags: DataFrame | None = None,
    options: int = 5, seed: int = config.SEED, screener_flags: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scores, outcomes). `quota_flags` and `screener_flags`: run_id and severity, as the functions above give them."""
    variants = cut_lineage(variant_questions(questions, seed))
    answers = cut_lineage(variant_responses(variants, recorded, seed))
    asked = variants.select(
        "run_id", "question_id", "position", "type", F.when(F.col("type") == "single_choice", options).otherwise(0).alias("n_options")
    )
    items = redundancy.baseline_items(answers, asked)
    redundant = redundancy.redundancy_flags(redundancy.redundancy_pairs(items), asked)
    named = items.join(asked.select("run_id", "position", F.col("question_id").alias("item")), ["run_id", "position"])
    fit = irt.fit_discrimination(irt.dichotomize(named.select("run_id", "persona_id", "item", "value")))
    nothing = variants.limit(0).select("run_id", F.lit("none").alias("severity"))
    bag = evaluate.observed_classes(
        shift_flags(answers, asked), irt.irt_flags(fit), redundant, nothing if screener_flags is None else screener_flags,
        nothing if quota_flags is None else quota_flags,
    )
    # a run's bag holds at most one entry per question and flag kind
    bags = bag.groupBy("run_id").agg(F.collect_list("defect_class").alias("observed"))
    runs = variants.select("run_id", "survey_id", "defect_class", "severity").distinct()
    planted = F.col("defect_class") != "clean"
    outcomes = cut_lineage(
        runs.join(bags, "run_id", "left").select(
            "run_id", "survey_id", F.when(planted, F.col("defect_class")).alias("expected_class"),
            F.when(planted, F.col("severity")).alias("severity"),
            F.coalesce("observed", F.array().cast("array<string>")).alias("observed"),
        )
    )
    return evaluate.calibration_f1(spark, evaluate.tally(outcomes)), outcomes
