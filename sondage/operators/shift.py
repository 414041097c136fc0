"""Wording sensitivity: how far answers move between the original and its variants.

The matched histogram is folded to one row per wording holding its (value, n)
steps, at most one per scale point. From there every distance is a column
expression on a wording's row next to the original's, so nothing is self-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.scalars import fixed2, shift_severity
from sondage.operators.responses import matched_histogram, respondent_answers

QUESTION = ["run_id", "question_id"]
VARIANT = [*QUESTION, "paraphrase_idx"]


def _weighted(steps: Column, term) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s["n"] * term(s["value"]))


def wordings(hist: DataFrame) -> DataFrame:
    """One row per wording: n, mean, sample variance, its steps, and the original's beside it."""
    answered = F.col("value").isNotNull()
    rows = hist.groupBy(*VARIANT).agg(
        F.max("n_matched").alias("n_matched"),
        F.coalesce(F.sum(F.when(answered, F.col("n"))), F.lit(0)).alias("n"),
        F.array_sort(
            F.collect_list(F.when(answered, F.struct("value", F.col("n").cast("double").alias("n"))))
        ).alias("steps"),
    )
    mean = F.when(F.col("n") > 0, _weighted(F.col("steps"), lambda x: x) / F.col("n"))
    rows = rows.withColumn("mean", mean)
    squares = _weighted(F.col("steps"), lambda x: (x - F.col("mean")) * (x - F.col("mean")))
    rows = rows.withColumn("variance", F.when(F.col("n") > 1, squares / (F.col("n") - 1)))
    base = F.first(
        F.when(F.col("paraphrase_idx") == 0, F.struct("n", "mean", "variance", "steps")), ignorenulls=True
    )
    return rows.withColumn("base", base.over(Window.partitionBy(*QUESTION)))


def comparable(table: DataFrame) -> DataFrame:
    """Variants that can be compared: both they and the original have answers."""
    return table.where((F.col("paraphrase_idx") != 0) & (F.col("n") > 0) & (F.col("base.n") > 0))


def effect_size() -> Column:
    """Cohen's d, original minus variant over the root of the plain mean of both variances."""
    pooled = (F.col("base.variance") + F.col("variance")) / 2
    return F.when(pooled > 0, (F.col("base.mean") - F.col("mean")) / F.sqrt(pooled))


def step_area() -> Column:
    """1-Wasserstein distance: area between the two step CDFs, exact.

    Counts are cross-multiplied so the running difference stays integral; equal
    distances then compare equal whatever the order of summation.
    """
    n0, nk = F.col("base.n").cast("double"), F.col("n").cast("double")
    up = F.transform("base.steps", lambda s: F.struct(s["value"].alias("at"), (s["n"] * nk).alias("mass")))
    down = F.transform("steps", lambda s: F.struct(s["value"].alias("at"), (-s["n"] * n0).alias("mass")))
    start = F.struct(
        F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("height"), F.lit(0.0).alias("area")
    )
    swept = F.aggregate(
        F.array_sort(F.concat(up, down)),
        start,
        lambda acc, s: F.struct(
            s["at"].alias("at"),
            (acc["height"] + s["mass"]).alias("height"),
            (acc["area"] + F.abs(acc["height"]) * F.coalesce(s["at"] - acc["at"], F.lit(0.0))).alias("area"),
        ),
    )
    return swept["area"] / (n0 * nk)


def ordinal_shift(hist: DataFrame) -> DataFrame:
    """Distance and effect size per variant."""
    return comparable(wordings(hist)).select(
        *VARIANT, step_area().alias("wasserstein"), effect_size().alias("cohens_d")
    )


def worst_variant(shift: DataFrame) -> DataFrame:
    """Largest distance per question; ties go to the lowest variant."""
    best = F.max(
        F.when(
            F.col("wasserstein") > 0,
            F.struct("wasserstein", (-F.col("paraphrase_idx")).alias("neg"), "cohens_d"),
        )
    )
    return shift.groupBy(*QUESTION).agg(best.alias("_b")).select(
        *QUESTION,
        F.coalesce("_b.wasserstein", F.lit(0.0)).alias("score"),
        (-F.col("_b.neg")).alias("worst_idx"),
        F.col("_b.cohens_d").alias("cohens_d"),
    )


def choice_counts(steps: Column) -> Column:
    """Answers per option code; codes outside the option list are ignored."""
    codes = F.when(F.col("n_options") > 0, F.sequence(F.lit(0), F.col("n_options") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        codes,
        lambda c: F.aggregate(
            steps, F.lit(0.0), lambda acc, s: acc + F.when(s["value"].cast("bigint") == c, s["n"]).otherwise(0.0)
        ),
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)


def with_choices(table: DataFrame, options: DataFrame) -> DataFrame:
    """Add option counts of the wording and of the original."""
    return (
        table.join(options.select(*QUESTION, "n_options"), QUESTION)
        .withColumn("g_counts", choice_counts(F.col("steps")))
        .withColumn("f_counts", choice_counts(F.col("base.steps")))
        .withColumn("g_total", _total(F.col("g_counts")))
        .withColumn("f_total", F.coalesce(_total(F.col("f_counts")), F.lit(0.0)))
    )


def _share_pairs() -> Column:
    return F.transform(
        F.arrays_zip("f_counts", "g_counts"),
        lambda z: F.struct(
            F.try_divide(z["f_counts"], F.col("f_total")).alias("f"),
            F.try_divide(z["g_counts"], F.col("g_total")).alias("g"),
        ),
    )


def jensen_shannon() -> Column:
    """Root of the Jensen-Shannon divergence with natural logarithm."""
    part = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    total = F.aggregate(
        _share_pairs(),
        F.lit(0.0),
        lambda acc, z: acc + part(z["f"], (z["f"] + z["g"]) / 2) + part(z["g"], (z["f"] + z["g"]) / 2),
    )
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def total_variation() -> Column:
    return F.aggregate(_share_pairs(), F.lit(0.0), lambda acc, z: acc + F.abs(z["f"] - z["g"])) / 2


def choice_distances(hist: DataFrame, options: DataFrame) -> DataFrame:
    """Jensen-Shannon distance and total variation per variant."""
    table = with_choices(comparable(wordings(hist)), options)
    return table.where((F.col("f_total") > 0) & (F.col("g_total") > 0)).select(
        *VARIANT, jensen_shannon().alias("js"), total_variation().alias("tv")
    )


def modal_choice(hist: DataFrame, options: DataFrame) -> DataFrame:
    """Most chosen option per wording, the lowest code on ties."""
    table = with_choices(wordings(hist), options).where(F.col("g_total") > 0)
    top = F.array_position("g_counts", F.array_max("g_counts")) - 1
    return table.select(*VARIANT, top.alias("choice"))


def shift_examples(hist: DataFrame) -> DataFrame:
    """Mean response and n per wording, for the report."""
    return wordings(hist).where("n > 0").select(*VARIANT, "mean", "n")


def flag_examples(hist: DataFrame, questions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """What each wording of a question got: mean answer and n, or the modal option of a choice.

    `texts` (question_id, idx, shown) supplies the wording; without it the
    original and its variants carry placeholders.
    """
    table = with_choices(wordings(hist), questions).join(questions.select(*QUESTION, "type"), QUESTION)
    ordinal, single = F.col("type").isin(config.ORDINAL_TYPES), F.col("type").isin(config.SINGLE_TYPES)
    modal = (F.array_position("g_counts", F.array_max("g_counts")) - 1).cast("double")
    rows = table.where(
        (F.col("n_matched") >= config.MIN_MATCHED) & F.col("base").isNotNull()
        & ((ordinal & (F.col("n") > 0) & (F.col("base.n") > 0)) | (single & (F.col("g_total") > 0) & (F.col("f_total") > 0)))
    ).select(
        *VARIANT, F.when(ordinal, F.col("mean")).otherwise(modal).alias("mean_response"),
        F.when(ordinal, F.col("n")).otherwise(F.col("n_matched")).alias("n"),
    )
    plain = F.when(F.col("paraphrase_idx") == 0, "<original>").otherwise(config.VARIANT_PLACEHOLDER)
    if texts is None:
        return rows.withColumn("text", plain)
    shown = texts.select("question_id", F.col("idx").alias("paraphrase_idx"), F.col("shown").alias("_shown"))
    joined = rows.join(shown, ["question_id", "paraphrase_idx"], "left")
    return joined.withColumn("text", F.coalesce("_shown", plain)).select(*VARIANT, "mean_response", "n", "text")


def jaccard_shift(responses: DataFrame) -> DataFrame:
    """Multi-select shift: mean 1 - |A∩B| / |A∪B| of original and variant per respondent.

    `value` is the array of chosen options; two empty selections agree fully.
    """
    answers = respondent_answers(responses)
    seen = responses.groupBy(*QUESTION).agg(F.count_distinct("paraphrase_idx").alias("_wordings"))
    matched = answers.withColumn("_wordings", F.size("answers").cast("bigint")).join(
        seen, [*QUESTION, "_wordings"], "left_semi"
    )
    original = F.get(F.filter("answers", lambda a: a["paraphrase_idx"] == 0), F.lit(0))["value"]
    rows = (
        matched.withColumn("a", original)
        .select(*QUESTION, "a", F.explode("answers").alias("v"))
        .select(*QUESTION, F.col("v.paraphrase_idx").alias("paraphrase_idx"), "a", F.col("v.value").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("paraphrase_idx") != 0))
    )
    union = F.size(F.array_union("a", "b"))
    distance = F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("a", "b")) / union)
    return rows.groupBy(*VARIANT).agg(F.avg(distance).alias("jaccard"), F.count(F.lit(1)).alias("n"))


def question_statistics(hist: DataFrame, questions: DataFrame) -> DataFrame:
    """Every question with the statistics its flag needs, from one pass over the wordings."""
    table = with_choices(wordings(hist), questions)
    variant = (F.col("paraphrase_idx") != 0) & (F.col("n") > 0) & (F.col("base.n") > 0)
    chosen = variant & (F.col("f_total") > 0) & (F.col("g_total") > 0)
    table = table.select(
        *VARIANT, "n", "n_matched", "mean", "g_total",
        F.when(variant, step_area()).alias("w"),
        F.when(variant, effect_size()).alias("d"),
        F.when(chosen, jensen_shannon()).alias("js"),
    )
    is_original = F.col("paraphrase_idx") == 0
    best = F.max(F.when(F.col("w") > 0, F.struct("w", (-F.col("paraphrase_idx")).alias("neg"), "d")))
    stats = table.groupBy(*QUESTION).agg(
        F.max("n_matched").alias("n_matched"),
        best.alias("_b"),
        F.max("js").alias("js_score"),
        F.max(F.when(is_original, F.col("mean"))).alias("mean_original"),
        F.avg(F.when(~is_original, F.col("mean"))).alias("mean_variants"),
        F.max(is_original & (F.col("n") > 0)).alias("has_original"),
        F.max(is_original & (F.col("g_total") > 0)).alias("has_choice"),
    )
    stats = stats.withColumn("w_score", F.col("_b.w")).withColumn("cohens_d", F.col("_b.d")).drop("_b")
    return questions.join(stats, QUESTION, "left")


def shift_flags(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """One flag per question: metric, score, effect, severity, note and summary.

    `questions` carries run_id, question_id, type and n_options.
    """
    return flags_from_histogram(matched_histogram(responses), questions)


def flags_from_histogram(hist: DataFrame, questions: DataFrame) -> DataFrame:
    return label_flags(question_statistics(hist, questions))


def label_flags(table: DataFrame) -> DataFrame:
    """Turn the per-question statistics into the flag record."""
    kind, matched = F.col("type"), F.coalesce("n_matched", F.lit(0)).cast("bigint")
    skip_type = kind.isin(config.SKIP_TYPES)
    ordinal, single = kind.isin(config.ORDINAL_TYPES), kind.isin(config.SINGLE_TYPES)
    no_original = ~F.coalesce("has_original", F.lit(False))
    no_choice = ~F.coalesce("has_choice", F.lit(False))
    note = (
        F.when(skip_type, F.concat(F.lit("paraphrase shift not computed for type="), kind))
        .when(matched < config.MIN_MATCHED, "insufficient matched personas across paraphrases")
        .when(ordinal & no_original, "no original responses available")
        .when(single & no_choice, "no options or no original responses")
        .when(~ordinal & ~single, F.concat(F.lit("shift analysis not implemented for type="), kind))
    )
    table = table.withColumn("note", note).withColumn("_ok", F.col("note").isNull())
    score = (
        F.when(~F.col("_ok"), 0.0)
        .when(ordinal, F.coalesce("w_score", F.lit(0.0)))
        .otherwise(F.coalesce("js_score", F.lit(0.0)))
    )
    table = table.withColumn("score", score).withColumn("cohens_d", F.when(F.col("_ok") & ordinal, F.col("cohens_d")))
    severity = (
        F.when(~F.col("_ok"), "none")
        .when(ordinal, shift_severity(F.col("score"), F.col("cohens_d"), config.WASSERSTEIN_HIGH, config.WASSERSTEIN_MED))
        .otherwise(shift_severity(F.col("score"), F.lit(None).cast("double"), config.JS_HIGH, config.JS_MED))
    )
    metric = F.when(~F.col("_ok"), "skipped").when(ordinal, "wasserstein").otherwise("jensen_shannon")
    return (
        table.withColumn("metric", metric)
        .withColumn("severity", severity)
        .withColumn("n_personas", F.when(skip_type, F.lit(0)).otherwise(matched).cast("bigint"))
        .withColumn("summary", F.when(F.col("_ok"), _summary(ordinal)).otherwise(""))
        .select(*QUESTION, "type", "metric", "score", "cohens_d", "n_personas", "severity", "note", "summary")
    )


ORDINAL_VERDICTS = ["stable under rewording", "slight wording effect", "wording effect, review it", "leading, rewrite it"]
CHOICE_VERDICTS = ["stable choices", "slight choice shift", "choices shift, review it", "choices depend on wording"]


def _summary(ordinal: Column) -> Column:
    delta = F.col("mean_original") - F.col("mean_variants")
    rank = F.array_position(F.array(*[F.lit(s) for s in config.SEVERITIES]), F.col("severity")).cast("int")
    verdict = lambda texts: F.element_at(F.array(*[F.lit(t) for t in texts]), rank)
    moved = F.concat(
        F.when(delta > 0, "inflates").otherwise("deflates"), F.lit(" mean by "), fixed2(F.abs(delta)),
        F.lit(" ("), fixed2(F.col("mean_original")), F.lit(" vs "), fixed2(F.col("mean_variants")), F.lit("): "),
        verdict(ORDINAL_VERDICTS),
    )
    choices = F.concat(F.lit("distance "), fixed2(F.col("score")), F.lit(": "), verdict(CHOICE_VERDICTS))
    return F.when(ordinal, F.coalesce(moved, F.lit(""))).otherwise(choices)
