"""Planting known defects into question tables and recorded responses.

`questions`: survey_id, question_id (string), position, type, text. Each injector
takes all surveys at once and returns the whole edited table. The question to
edit is the ordinal one with the smallest keyed hash, found by an aggregate, so
no survey is ever sorted or gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.hashing import draw_bits, gaussian, pick, uniform
from sondage.operators.ordered import over_order

REWRITES = ["leading_wording", "double_barreled", "loaded_language", "redundant_pair"]
VARIANTS = [(c, s) for c in config.DEFECT_CLASSES for s in config.DEFECT_SEVERITIES]


def _draw(seed: int, defect: str, severity: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(defect), F.lit(severity), *[p.cast("string") for p in parts]))


def _target(seed: int, defect: str, severity: str) -> Column:
    """Aggregate: the chosen ordinal question of a survey with its position."""
    ordinal = F.col("type").isin(config.ORDINAL_TYPES)
    entry = F.struct(
        _draw(seed, defect, severity, F.col("survey_id"), F.col("question_id")).alias("h"), "question_id", "position"
    )
    return F.min(F.when(ordinal, entry))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"\?+$", "")


def _lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def leading_text(text: Column, severity: str, seed: int) -> Column:
    prefix = pick(config.LEADING_PREFIXES[severity], seed, "prefix", severity, F.col("survey_id"))
    return F.concat(prefix, _lower_first(_bare(text)), F.lit("?"))


def barreled_text(text: Column, severity: str, seed: int) -> Column:
    extra = pick(config.EXTRA_FACETS[severity], seed, "facet", severity, F.col("survey_id"))
    return F.concat(_bare(text), F.lit(" and "), extra, F.lit("?"))


def loaded_text(text: Column, severity: str, seed: int) -> Column:
    phrase = pick(config.LOADED_PHRASES[severity], seed, "phrase", severity, F.col("survey_id"))
    return F.concat(_bare(text), phrase, F.lit("?"))


def redundant_text(text: Column, severity: str, seed: int) -> Column:
    """Synonym swap where one applies, else a connecting prefix."""
    swaps = [
        F.when(
            F.contains(F.lower(text), F.lit(a)),
            F.replace(F.replace(text, F.lit(a), F.lit(b)), F.lit(a.capitalize()), F.lit(b.capitalize())),
        )
        for a, b in config.SYNONYMS[severity]
    ]
    usable = F.filter(F.array(*swaps), lambda x: x.isNotNull())
    size = F.size(usable)
    place = F.pmod(draw_bits(seed, "synonym", severity, F.col("survey_id")), F.greatest(size, F.lit(1)))
    prefixed = F.concat(F.lit(config.CLONE_PREFIX[severity]), _lower_first(text))
    return F.when(size > 0, F.get(usable, place.cast("int"))).otherwise(prefixed)


def fatigue_items(severity: str, seed: int) -> Column:
    """Array of distinct attributes for a survey, in keyed-hash order."""
    attributes = F.array(*[F.lit(a) for a in config.FATIGUE_ATTRIBUTES])
    keyed = F.transform(
        attributes,
        lambda a: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(severity), F.col("survey_id").cast("string"), a)).alias("h"), a.alias("a")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, config.FATIGUE_SIZE[severity]), lambda x: x["a"])


def survey_targets(questions: DataFrame, variants: list[tuple[str, str]], seed: int) -> DataFrame:
    """One row per survey: its size, and the target of every rewriting variant."""
    targets = [_target(seed, d, s).alias(f"{d}__{s}") for d, s in variants if d in REWRITES]
    return questions.groupBy("survey_id").agg((F.max("position") + 1).alias("n_questions"), *targets)


_TARGET = "struct<h:string,question_id:string,position:int>"


def _variant_list(variants: list[tuple[str, str]]) -> Column:
    """The variants as an array, each with its target question in this survey."""
    target = lambda d, s: F.col(f"{d}__{s}") if d in REWRITES else F.lit(None)
    return F.array(*[
        F.struct(F.lit(d).alias("defect_class"), F.lit(s).alias("severity"), target(d, s).cast(_TARGET).alias("target"))
        for d, s in variants
    ])


def _case(variants: list[tuple[str, str]], defects: dict, otherwise: Column, seed: int) -> Column:
    """The text each variant gives a hit question; only a row's own branch is evaluated."""
    out = F.when(F.lit(False), otherwise)
    for d, s in variants:
        if d in defects:
            chosen = (F.col("defect_class") == d) & (F.col("severity") == s)
            out = out.when(chosen, defects[d](F.col("text"), s, seed))
    return out.otherwise(otherwise)


def plant(questions: DataFrame, variants: list[tuple[str, str]], seed: int) -> DataFrame:
    """Every survey under every variant, with `planted` marking the affected questions.

    Targets are one row per survey before the join, and variants multiply only
    after it, so the shuffle carries each question once.
    """
    targets = survey_targets(questions, variants, seed)
    rows = (
        questions.join(targets, "survey_id")
        .withColumn("v", F.explode(_variant_list(variants)))
        .select("survey_id", "question_id", "position", "type", "text", "v.*")
        .withColumn("planted", F.coalesce(F.col("question_id") == F.col("target.question_id"), F.lit(False)))
    )
    rewrites = {"leading_wording": leading_text, "double_barreled": barreled_text, "loaded_language": loaded_text}
    cloned = (F.col("defect_class") == "redundant_pair") & F.col("planted")
    later = ((F.col("defect_class") == "redundant_pair") & (F.col("position") > F.col("target.position"))).cast("int")
    row = lambda qid, place, text: F.struct(
        qid.alias("question_id"), place.cast("int").alias("position"), text.alias("text")
    )
    text = F.when(F.col("planted"), _case(variants, rewrites, F.col("text"), seed)).otherwise(F.col("text"))
    own = row(F.col("question_id"), F.col("position") + F.coalesce(later, F.lit(0)), text)
    if any(d == "redundant_pair" for d, _ in variants):
        twin = row(
            F.concat(F.col("question_id"), F.lit("_redundant")), F.col("position") + 1,
            _case(variants, {"redundant_pair": redundant_text}, F.col("text"), seed),
        )
        edited = F.when(cloned, F.array(own, twin)).otherwise(F.array(own))
    else:
        edited = F.array(own)
    out = rows.withColumn("e", F.explode(edited)).select(
        "survey_id", "defect_class", "severity", "e.question_id", "e.position", "type", "e.text", "planted"
    )
    for d, s in variants:
        if d == "fatigue_block":
            block = _appended(targets, s, seed)
            out = out.unionByName(block.withColumn("defect_class", F.lit(d)).withColumn("severity", F.lit(s)))
    return out


def _appended(targets: DataFrame, severity: str, seed: int) -> DataFrame:
    """The rating block added behind a survey's own questions."""
    rows = targets.select("survey_id", "n_questions", F.posexplode(fatigue_items(severity, seed)).alias("i", "attribute"))
    text = F.concat(F.lit("On a scale of 1 to 5, how would you rate the brand on "), F.col("attribute"), F.lit("?"))
    return rows.select(
        "survey_id", F.concat(F.lit("FAT_"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("question_id"),
        (F.col("n_questions") + F.col("i")).cast("int").alias("position"), F.lit("likert_5").alias("type"),
        text.alias("text"), F.lit(True).alias("planted"),
    )


def inject(questions: DataFrame, defect: str, severity: str, seed: int = config.SEED) -> DataFrame:
    """Edited question table under one defect; a survey without an ordinal question is unchanged."""
    return plant(questions, [(defect, severity)], seed).drop("defect_class", "severity")


def inject_quota(surveys: DataFrame, severity: str) -> DataFrame:
    """The infeasible cell added to every survey's quotas."""
    cell = config.INFEASIBLE_CELLS[severity]
    entries = F.create_map(*[F.lit(x) for k, v in cell.items() for x in (k, v)])
    return surveys.select("survey_id", entries.alias("cell"), F.lit(config.INFEASIBLE_TARGET_N).alias("target_n"))


def fan_out(questions: DataFrame, seed: int = config.SEED) -> DataFrame:
    """Every survey clean and under all defects and severities: nineteen variants in one pass."""
    return plant(questions, [("clean", "none"), *VARIANTS], seed)


def variant_names(surveys: DataFrame) -> DataFrame:
    """Every survey of `surveys` with the names of its nineteen variants, in the order of `fan_out`."""
    names = [F.struct(F.lit(d).alias("defect_class"), F.lit(s).alias("severity")) for d, s in [("clean", "none"), *VARIANTS]]
    return surveys.select("survey_id", F.explode(F.array(*names)).alias("v")).select("survey_id", "v.*")


def fan_out_notes(questions: DataFrame, seed: int = config.SEED) -> DataFrame:
    """Per survey and variant: the affected question, or why nothing was planted."""
    targets = survey_targets(questions, VARIANTS, seed)
    entries = []
    for defect, severity in VARIANTS:
        affected = F.col(f"{defect}__{severity}.question_id") if defect in REWRITES else F.lit(None).cast("string")
        note = F.when(affected.isNull(), "no eligible ordinal question") if defect in REWRITES else F.lit(None).cast("string")
        entries.append(
            F.struct(F.lit(defect).alias("defect_class"), F.lit(severity).alias("severity"), affected.alias("affected"), note.alias("note"))
        )
    return targets.select("survey_id", F.explode(F.array(*entries)).alias("v")).select("survey_id", "v.*")


def clean_corpus(spark: SparkSession, ids: DataFrame, seed: int = 7) -> DataFrame:
    """Well-formed surveys, one per row of `ids` (column idx), six questions each."""
    names = list(config.CORPUS_SUBJECTS)
    place = (F.col("idx") % len(names) + 1).cast("int")
    category = F.element_at(F.array(*[F.lit(n) for n in names]), place)
    subject = F.element_at(F.array(*[F.lit(s) for s in config.CORPUS_SUBJECTS.values()]), place)
    spoken = F.replace(category, F.lit("_"), F.lit(" "))
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(q).alias("question_id"), F.lit(t).alias("type"),
                 F.replace(F.replace(F.lit(text), F.lit("{subject}"), subject), F.lit("{category}"), spoken).alias("text"))
        for i, (q, t, text) in enumerate(config.CORPUS_QUESTIONS)
    ])
    digits = F.col("idx").cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))  # lpad alone cuts longer numbers
    number = lambda options, purpose: pick([str(o) for o in options], seed, purpose, F.col("idx")).cast("int")
    return ids.select(
        F.concat(F.lit("clean-"), padded, F.lit("-"), category).alias("survey_id"),
        number(config.CORPUS_AGE_MIN, "age_min").alias("age_min"), number(config.CORPUS_AGE_MAX, "age_max").alias("age_max"),
        number(config.CORPUS_INCOME_MIN, "income_min").alias("income_min"), F.explode(entries).alias("q"),
    ).select("survey_id", "age_min", "age_max", "income_min", "q.*")


# --- signatures planted into recorded responses -----------------------------
def clip_scale(x: Column, lo: Column, hi: Column) -> Column:
    """Nearest scale point, halves to even, kept on the scale."""
    return F.greatest(lo, F.least(hi, F.bround(x, 0)))


def to_middle(value: Column, lo: Column, hi: Column) -> Column:
    """A recorded answer drawn in to the middle of its scale."""
    mid = (lo + hi) / 2
    return clip_scale(mid + config.MIDDLE_SHARE * (value - mid), lo, hi)


def exchanged(rows: DataFrame, seed: int = config.SEED) -> DataFrame:
    """Each answer gives way to that of the respondent before it in an order by hash, within run, question and wording; the
    first one keeps its own. The answers stay what they were, but tell nothing about who gave them."""
    key = [F.col(c) for c in ("run_id", "persona_id", "question_id", "paraphrase_idx")]
    placed = over_order(
        rows.withColumn("_rank", uniform(seed, "dilute", *key)), ["run_id", "question_id", "paraphrase_idx"], ["_rank", "persona_id"],
        lambda w: {"_other": F.lag("value").over(w)}, before=1)
    return placed.withColumn("value", F.coalesce("_other", "value")).select(*rows.columns)


def perturb(responses: DataFrame, defect: str, lo: Column, hi: Column, seed: int = config.SEED) -> DataFrame:
    """Rewrite recorded answers of affected questions so that they show a defect's signature.

    shift: the original wording drifts to the top of the scale; dilute: respondents exchange their answers; concentrate:
    answers are drawn in to the middle. All come from recorded answers, none is made up.
    `responses` carries an `affected` column; other rows pass through.
    """
    value, hit = F.col("value"), F.coalesce(F.col("affected"), F.lit(False)) & F.col("value").isNotNull()
    if defect == "dilute":
        return responses.where(~hit).unionByName(exchanged(responses.where(hit), seed))
    up = F.when(F.col("paraphrase_idx") == 0, clip_scale(value + config.SHIFT_FRACTION * (hi - (lo + hi) / 2), lo, hi)).otherwise(value)
    new = {"shift": up, "concentrate": to_middle(value, lo, hi)}[defect]
    return responses.withColumn("value", F.when(hit, new).otherwise(value).cast("double"))


def perturb_correlate(responses: DataFrame, source: str, target: str, seed: int = config.SEED) -> DataFrame:
    """Make `target`'s baseline answers follow `source`'s at the planted correlation."""
    c = config.TARGET_CORRELATION
    base = responses.where((F.col("paraphrase_idx") == 0) & F.col("value").isNotNull())
    lead = base.where(F.col("question_id") == source).select("run_id", "persona_id", F.col("value").alias("_a"))
    both = lead.join(base.where(F.col("question_id") == target).select("run_id", "persona_id"), ["run_id", "persona_id"])
    mean = both.groupBy("run_id").agg(F.avg("_a").alias("_mean"))
    noise = config.CORRELATION_NOISE * gaussian(seed, "noise", F.col("run_id"), F.col("persona_id"))
    planted = c * (F.col("_a") - F.col("_mean")) + F.col("_mean") + (1 - c * c) ** 0.5 * noise
    new = both.join(mean, "run_id").select(
        "run_id", "persona_id", F.lit(target).alias("question_id"), F.lit(0).alias("paraphrase_idx"),
        clip_scale(planted, F.lit(1.0), F.lit(5.0)).alias("_new"),
    )
    keys = ["run_id", "persona_id", "question_id", "paraphrase_idx"]
    return responses.join(new, keys, "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")
