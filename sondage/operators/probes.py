"""Work lists: who is asked which wording, what is still open, and answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage import config

KEY = ["run_id", "persona_id", "question_id", "paraphrase_idx"]


def probe_plan(
    panel: DataFrame, questions: DataFrame, baseline_n: int = config.BASELINE_N, subpanel_n: int = config.SUBPANEL_N,
    k: int = config.K_VARIANTS, salts: int = config.JOIN_SALTS,
) -> DataFrame:
    """Every question for the first `baseline_n` personas, its k variants for the first `subpanel_n`.

    `panel`: run_id, rank, persona_id. The panel side holds at most baseline_n
    rows per run; it is copied per salt so that a run with very many questions
    spreads over tasks.
    """
    asked = panel.where(F.col("rank") <= baseline_n).select(
        "run_id", "persona_id", "rank", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    spread = questions.select("run_id", "question_id").withColumn(
        "_salt", F.pmod(F.xxhash64("question_id"), F.lit(salts)).cast("int")
    )
    wordings = F.when(F.col("rank") <= subpanel_n, F.sequence(F.lit(0), F.lit(k))).otherwise(F.array(F.lit(0)))
    return spread.join(asked, ["run_id", "_salt"]).select(
        "run_id", "persona_id", "question_id", F.explode(wordings).alias("paraphrase_idx")
    )


def remaining(plan: DataFrame, recorded: DataFrame) -> DataFrame:
    """Planned cells without a recorded answer: resuming a run is this join."""
    return plan.join(recorded.select(*KEY), KEY, "left_anti")


def answer_problem(kind: Column, n_options: Column, payload: Column) -> Column:
    """Why a recorded payload breaks its question's answer domain, NULL when it fits."""
    raw = F.get_json_object(payload, "$.response_value")
    confidence = F.get_json_object(payload, "$.confidence").try_cast("double")
    whole = F.when(raw.rlike("^-?[0-9]+$"), raw.try_cast("bigint"))
    top = F.greatest(F.lit(0), F.coalesce(n_options, F.lit(0)) - 1)
    inside = None
    for name, (lo, hi) in config.SCALE_BOUNDS.items():
        test = F.coalesce(whole.between(lo, hi), F.lit(False))
        inside = F.when(kind == name, test) if inside is None else inside.when(kind == name, test)
    listed = F.from_json(F.when(raw.startswith("["), raw), "array<int>")
    chosen = F.coalesce(
        F.forall(listed, lambda x: F.coalesce(x.between(0, top), F.lit(False)))
        & (F.size(F.array_distinct(listed)) == F.size(listed)),
        F.lit(False),
    )
    inside = (
        inside.when(kind == "single_choice", F.coalesce(whole.between(0, top), F.lit(False)))
        .when(kind == "multi_choice", chosen)
        .otherwise(raw.isNotNull())
    )
    return (
        F.when(raw.isNull(), "response_value missing")
        .when(confidence.isNull(), "confidence missing")
        .when(~confidence.between(0, 1), "confidence out of range")
        .when(~inside, "response_value out of domain")
    )


def check_answers(rows: DataFrame) -> DataFrame:
    """Adds `problem`; input has type, n_options and payload."""
    return rows.withColumn("problem", answer_problem(F.col("type"), F.col("n_options"), F.col("payload")))


def render_question(kind: Column, text: Column, options: Column) -> Column:
    """Text as presented: the wording, then its scale hint or numbered options."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(i.cast("string"), F.lit(". "), o)), "\n")
    hint = None
    for name, words in config.SCALE_HINTS.items():
        hint = F.when(kind == name, words) if hint is None else hint.when(kind == name, words)
    listed = kind.isin("single_choice", "multi_choice") & (F.coalesce(F.size(options), F.lit(0)) > 0)
    hint = hint.when(listed, F.concat(F.lit("Choose by index:\n"), lines))
    return F.concat_ws("\n\n", text, hint)
