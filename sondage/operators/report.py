"""Report composition and the choice of runs to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.scalars import lookup, severity_name, severity_rank
from sondage.operators.ordered import largest_group, with_place
from sondage.session import cut_lineage

DISCLAIMER = (
    "Probes stress-test the instrument and do not predict population answers. "
    "Discrimination is relative within the survey, not an absolute score."
)


def question_severity(questions: DataFrame, shift: DataFrame, irt: DataFrame) -> DataFrame:
    """Worst severity of every question over the flags it has."""
    key = ["run_id", "question_id"]
    table = questions.join(shift.select(*key, F.col("severity").alias("shift_severity")), key, "left").join(
        irt.select(*key, F.col("severity").alias("irt_severity")), key, "left"
    )
    worst = F.greatest(severity_rank(F.col("shift_severity")), severity_rank(F.col("irt_severity")))
    return table.select(
        *key, "position", "type", "shift_severity", "irt_severity", severity_name(worst).alias("severity")
    )


def report_exposure(severities: DataFrame) -> DataFrame:
    high, medium = F.count_if(F.col("severity") == "high"), F.count_if(F.col("severity") == "medium")
    return severities.groupBy("run_id").agg(
        high.alias("high_severity_questions"), medium.alias("medium_severity_questions"),
        (high + medium).alias("flagged_question_count"),
    )


def _listed(flags: DataFrame, name: str, sheet_rows: int, order: list[str] | None = None) -> DataFrame:
    """A run's findings in order as arrays of at most `sheet_rows`, a row per run and sheet."""
    columns = [c for c in flags.columns if c != "run_id"]
    flags = cut_lineage(flags)
    if largest_group(flags, ["run_id"]) <= sheet_rows:
        placed = flags.withColumn("sheet", F.lit(0))
    else:
        placed = with_place(flags, ["run_id"], order or columns).withColumn("sheet", F.floor(F.col("_place") / sheet_rows).cast("int"))
    return placed.groupBy("run_id", "sheet").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def report_cards(
    questions: DataFrame, shift: DataFrame, irt: DataFrame, redundancy: DataFrame, screener: DataFrame, quota: DataFrame,
    examples: DataFrame | None = None, f1_overall: float | None = None, sheet_rows: int = config.REPORT_SHEET_ROWS,
) -> DataFrame:
    """JSON reports (run_id, sheet, report): a run's questions in order with their flags, then survey-level findings.

    A document lists at most `sheet_rows` findings of a kind. A run with more has further sheets, numbered from 0, that go
    on where the lists of the sheet before end; the counts of the whole run are on the first.
    """
    key = ["run_id", "question_id"]
    severities = question_severity(questions, shift, irt)
    if "text" in questions.columns:
        severities = severities.join(questions.select(*key, F.col("text").alias("question_text")), key)
    else:
        severities = severities.withColumn("question_text", F.lit(None).cast("string"))
    if examples is not None:
        listed = F.array_sort(F.collect_list(F.struct("paraphrase_idx", "text", "mean_response", "n")))
        shift = shift.join(examples.groupBy(*key).agg(listed.alias("examples")), key, "left")
    nested = lambda df, name: df.select(*key, F.struct(*[c for c in df.columns if c not in key]).alias(name))
    rows = (
        severities.join(nested(shift, "paraphrase_shift"), key, "left").join(nested(irt, "irt"), key, "left")
    ).select("run_id", "position", "question_id", "question_text", "type", "severity", "paraphrase_shift", "irt")
    card = _listed(rows, "per_question", sheet_rows, ["position", "question_id"])
    lists = {"redundancy_pairs": redundancy, "screener_issues": screener, "quota_feasibility": quota}
    for name, flags in lists.items():
        card = card.join(_listed(flags, name, sheet_rows), ["run_id", "sheet"], "full")
    exposure = report_exposure(severities)
    counts = [c for c in exposure.columns if c != "run_id"]
    card = card.join(exposure.select("run_id", F.struct(*counts).alias("_counts")), "run_id")
    card = card.withColumn("estimated_panel_exposure", F.when(F.col("sheet") == 0, F.col("_counts")))
    if "survey_id" in questions.columns:
        card = card.join(questions.groupBy("run_id").agg(F.min("survey_id").alias("survey_id")), "run_id")
    else:
        card = card.withColumn("survey_id", F.col("run_id"))
    body = F.struct(
        "run_id", "survey_id", "sheet", *[F.coalesce(F.col(n), F.array()).alias(n) for n in ("per_question", *lists)],
        "estimated_panel_exposure",
        F.lit(f1_overall).cast("double").alias("calibration_f1"), F.lit(DISCLAIMER).alias("framing_disclaimer"),
    )
    return card.select("run_id", "sheet", F.to_json(body).alias("report"))


def report_findings(shift: DataFrame, redundancy: DataFrame, screener: DataFrame, quota: DataFrame, irt: DataFrame | None = None) -> DataFrame:
    """Everything a report says, a row per finding: run_id, survey_id (of survey-level findings), kind, subject, severity
    and summary. For runs whose findings are too many for one document."""
    row = lambda df, kind, subject, survey=None: df.select(
        "run_id", (F.lit(None) if survey is None else F.col(survey)).cast("string").alias("survey_id"), F.lit(kind).alias("kind"),
        subject.cast("string").alias("subject"), "severity", "summary",
    )
    both = F.concat_ws("|", "q_id_a", "q_id_b")
    parts = [
        row(shift, "paraphrase_shift", F.col("question_id")), row(redundancy, "redundant_pair", both),
        row(screener, "screener", F.concat_ws("|", "flag", "subject", "detail"), "survey_id"),
        row(quota, "quota", F.col("cell_id"), "audience_id"),
    ]
    if irt is not None:
        parts.append(row(irt, "discrimination", F.col("question_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_runs(runs: DataFrame, n: int = config.HISTORY_LENGTH) -> DataFrame:
    """The n most recently completed runs: a top-n, not a sort of the history."""
    return runs.where("completed_at IS NOT NULL").orderBy(F.desc("completed_at"), F.desc("run_id")).limit(n)


def _descending(ts: Column) -> Column:
    return -F.unix_micros(F.to_timestamp(ts))


def best_run_per_survey(runs: DataFrame) -> DataFrame:
    """Most useful run: status priority, then latest completion (open ones first), then latest start."""
    order = {s: i for i, s in enumerate(config.STATUS_PRIORITY)}
    rank = F.coalesce(lookup(F.col("status"), order), F.lit(len(order)))
    best = F.min(
        F.struct(
            rank.alias("a"), F.col("completed_at").isNotNull().alias("b"),
            F.coalesce(_descending(F.col("completed_at")), F.lit(0)).alias("c"),
            _descending(F.col("created_at")).alias("d"), "run_id", "status",
        )
    )
    return runs.groupBy("survey_id").agg(best.alias("x")).select("survey_id", "x.run_id", "x.status")


def run_choices(runs: DataFrame) -> DataFrame:
    """Per survey: the oldest (canonical) run, the latest completed and the latest in flight."""
    status = F.col("status")
    oldest = F.min(F.struct("created_at", "run_id"))
    done = F.max(F.when(status == "completed", F.struct("completed_at", "run_id")))
    moving = F.max(F.when(~status.isin(config.TERMINAL_STATUSES), F.struct("created_at", "run_id")))
    return runs.groupBy("survey_id").agg(
        oldest["run_id"].alias("canonical_run"), done["run_id"].alias("completed_run"), moving["run_id"].alias("in_flight_run")
    )


def seed_status(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many runs were seeded and whether all of them completed."""
    counts = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeded"), F.count_if(F.col("status") == "completed").alias("completed")
    )
    return counts.withColumn("all_completed", (F.col("seeded") > 0) & (F.col("completed") >= F.col("seeded")))
