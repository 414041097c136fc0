"""Planted defects, scoring, reports and the loop from planting to recall."""

import json

import pytest
from pyspark.sql import functions as F

from sondage import config
from sondage.functions.hashing import uniform
from sondage.operators import evaluate, inject, redundancy, report, shift

QUESTIONS = "survey_id string, question_id string, position int, type string, text string"


@pytest.fixture(scope="module")
def corpus(spark):
    ids = spark.range(12).select(F.col("id").alias("idx"))
    return inject.clean_corpus(spark, ids).select("survey_id", "question_id", "position", "type", "text").cache()


def test_corpus(spark, corpus):
    assert corpus.count() == 72 and corpus.select("survey_id").distinct().count() == 12
    first = corpus.where("survey_id = 'clean-000-mobile_carrier' AND position = 3").first()
    assert first["text"] == "What matters most when choosing a mobile carrier?"


@pytest.mark.parametrize("severity", config.DEFECT_SEVERITIES)
@pytest.mark.parametrize("defect", config.DEFECT_CLASSES)
def test_every_defect_changes_every_survey(spark, corpus, defect, severity):
    out = inject.inject(corpus, defect, severity)
    again = inject.inject(corpus.repartition(9), defect, severity)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    rows = out.collect()
    planted = [r for r in rows if r["planted"]]
    extra = {"redundant_pair": 12, "fatigue_block": 12 * config.FATIGUE_SIZE[severity]}.get(defect, 0)
    assert len(rows) == 72 + extra
    assert len(planted) == {"redundant_pair": 24, "fatigue_block": extra, "infeasible_screener": 0}.get(defect, 12)
    for survey in {r["survey_id"] for r in rows}:
        places = sorted(r["position"] for r in rows if r["survey_id"] == survey)
        assert places == list(range(len(places)))
    texts = [r["text"] for r in planted]
    if defect == "leading_wording":
        assert all(any(t.startswith(p) for p in config.LEADING_PREFIXES[severity]) and t.endswith("?") and "??" not in t for t in texts)
    if defect == "double_barreled":
        assert all(any(t.endswith(f" and {f}?") for f in config.EXTRA_FACETS[severity]) for t in texts)
    if defect == "fatigue_block":
        assert len({(r["survey_id"], r["text"]) for r in planted}) == extra


def test_no_ordinal_question_passes_through(spark):
    rows = spark.createDataFrame([("s", "a", 0, "open_end", "Why?")], QUESTIONS)
    for defect in inject.REWRITES:
        assert [r["text"] for r in inject.inject(rows, defect, "obvious").collect()] == ["Why?"]
    notes = inject.fan_out_notes(rows).where("note IS NOT NULL")
    assert notes.count() == 12


def test_synonyms_and_prefixes(spark):
    rows = spark.createDataFrame([("s", "a", 0, "nps", "Satisfied or satisfied?"), ("t", "a", 0, "nps", "How good?")], QUESTIONS)
    out = {r["survey_id"]: r["text"] for r in inject.inject(rows, "redundant_pair", "moderate").where("question_id = 'a_redundant'").collect()}
    assert out == {"s": "Happy or happy?", "t": "In other words, how good?"}


def test_fan_out_has_nineteen_variants(spark, corpus):
    out = inject.fan_out(corpus)
    assert out.select("survey_id", "defect_class", "severity").distinct().count() == 12 * 19
    single = inject.inject(corpus, "redundant_pair", "subtle")
    same = out.where("defect_class = 'redundant_pair' AND severity = 'subtle'").select(single.columns)
    assert same.exceptAll(single).count() == 0 and single.exceptAll(same).count() == 0


def recorded(spark, surveys, questions, people=60, k=5):
    """Answers spread over a five-point scale by the keyed hash, the same law for every wording."""
    base = spark.range(people).select(F.concat(F.lit("p"), F.col("id")).alias("persona_id"))
    ids = spark.createDataFrame([(s, q) for s in surveys for q in questions], "run_id string, question_id string")
    rows = base.join(F.broadcast(ids)).withColumn("paraphrase_idx", F.explode(F.sequence(F.lit(0), F.lit(k))))
    level = uniform("t", *[F.col(c) for c in ("run_id", "persona_id", "question_id", "paraphrase_idx")])
    return rows.withColumn("value", F.floor(level * 5) + F.lit(1.0))


def test_planted_leading_questions_are_found(spark):
    surveys, questions = [f"s{i}" for i in range(10)], ["Q1", "Q2", "Q3"]
    rows = recorded(spark, surveys, questions).withColumn("affected", F.col("question_id") == "Q2")
    planted = inject.perturb(rows, "shift", F.lit(1.0), F.lit(5.0)).drop("affected")
    asked = spark.createDataFrame([(s, q, "likert_5", 0) for s in surveys for q in questions], "run_id string, question_id string, type string, n_options int")
    flags = shift.shift_flags(planted, asked)
    hit = flags.where("severity IN ('medium', 'high')")
    outcomes = (
        spark.createDataFrame([(s, "leading_wording", "obvious") for s in surveys], "run_id string, expected_class string, severity string")
        .join(hit.where("question_id = 'Q2'").select("run_id", F.lit("leading_wording").alias("c")), "run_id", "left")
        .select("expected_class", "severity", F.when(F.col("c").isNotNull(), F.array("c")).otherwise(F.array().cast("array<string>")).alias("observed"))
    )
    cell = evaluate.scores(evaluate.tally(outcomes)).first()
    assert cell["recall"] > 0.9


def test_planted_correlation_is_found(spark):
    rows = recorded(spark, ["s"], ["Q1", "Q2", "Q3"], people=300, k=0)
    asked = spark.createDataFrame([("s", q, i, "likert_5") for i, q in enumerate(["Q1", "Q2", "Q3"])], "run_id string, question_id string, position int, type string")
    find = lambda r: redundancy.redundancy_flags(redundancy.redundancy_pairs(redundancy.baseline_items(r, asked)), asked).collect()
    assert find(rows) == []
    flags = find(inject.perturb_correlate(rows, "Q1", "Q2"))
    assert [(r["q_id_a"], r["q_id_b"], r["severity"]) for r in flags] == [("Q1", "Q2", "high")]


def test_perturbed_answers_stay_on_the_scale(spark):
    rows = recorded(spark, ["s"], ["Q"], people=200).withColumn("affected", F.lit(True))
    for defect in ("shift", "dilute", "concentrate"):
        values = {r["value"] for r in inject.perturb(rows, defect, F.lit(1.0), F.lit(5.0)).select("value").distinct().collect()}
        assert values <= {1.0, 2.0, 3.0, 4.0, 5.0}


def test_exchanged_answers_are_the_recorded_ones(spark):
    rows = recorded(spark, ["s"], ["Q", "R"], people=150).withColumn("affected", F.col("question_id") == "Q").persist()
    # a row without value and one of unknown state pass through
    odd = rows.limit(2).select("run_id", F.concat(F.lit("x"), F.monotonically_increasing_id()).alias("persona_id"), "question_id", "paraphrase_idx",
                               F.when(F.monotonically_increasing_id() > 0, 3.0).alias("value"), F.lit(None).cast("boolean").alias("affected"))
    both = rows.unionByName(odd)
    key = lambda r: (r["run_id"], r["persona_id"], r["question_id"], r["paraphrase_idx"])
    before = {key(r): r["value"] for r in both.collect()}
    after = {key(r): r["value"] for r in inject.perturb(both, "dilute", F.lit(1.0), F.lit(5.0)).collect()}
    assert before.keys() == after.keys()
    assert all(after[k] == before[k] for k in before if k[2] == "R" or k[1].startswith("x"))
    moved = sum(after[k] != before[k] for k in before if k[2] == "Q")
    assert moved > 0.3 * sum(k[2] == "Q" for k in before)
    for wording in {k[3] for k in before}:
        count = lambda found: sorted(v for k, v in found.items() if k[2:] == ("Q", wording) and v is not None)
        old, new = count(before), count(after)
        # each recorded answer is handed on once; only the last one's gives way to the first one's
        assert len(old) == len(new) and sum(a != b for a, b in zip(old, new)) <= max(old) - min(old)


def test_tally_counts_duplicates_and_defaults(spark):
    rows = [
        (None, None, ["leading_wording", "leading_wording"]), ("leading_wording", None, ["leading_wording", "leading_wording", "double_barreled"]),
        ("fatigue_block", "obvious", []), ("redundant_pair", "subtle", ["double_barreled", "double_barreled"]),
    ]
    outcomes = spark.createDataFrame(rows, "expected_class string, severity string, observed array<string>")
    counts = evaluate.tally(outcomes)
    got = {(r["defect_class"], r["severity"]): (r["tp"], r["fp"], r["fn"]) for r in counts.collect()}
    assert got == {
        ("leading_wording", "subtle"): (0, 2, 0), ("leading_wording", "moderate"): (1, 0, 0), ("double_barreled", "moderate"): (0, 1, 0),
        ("fatigue_block", "obvious"): (0, 0, 1), ("redundant_pair", "subtle"): (0, 0, 1), ("double_barreled", "subtle"): (0, 2, 0),
    }
    scored = {(r["level"], r["defect_class"], r["severity"]): r for r in evaluate.calibration_f1(spark, counts).collect()}
    assert len(scored) == 18 + 6 + 1
    leading = scored["class", "leading_wording", "ALL"]
    assert (leading["precision"], leading["recall"], leading["f1"]) == (pytest.approx(1 / 3), 1.0, pytest.approx(0.5))
    assert scored["overall", "ALL", "ALL"]["f1"] == pytest.approx(0.5 / 6)


def test_regression_gate(spark):
    history = spark.createDataFrame([("a", 1, 0.80), ("b", 2, 0.79), ("c", 3, 0.70)], "revision string, completed_at int, f1_overall double")
    for chunk in (1, 100):
        out = evaluate.f1_regression(history, max_group=chunk).orderBy("completed_at").collect()
        assert [r["regressed"] for r in out] == [False, False, True]


def test_report_card_takes_the_worst_severity(spark):
    asked = spark.createDataFrame([("r", "a", 1, "nps"), ("r", "b", 0, "nps"), ("r", "c", 2, "open_end")], "run_id string, question_id string, position int, type string")
    flag = lambda *rows: spark.createDataFrame([("r", *x) for x in rows], "run_id string, question_id string, severity string")
    shifted, irt = flag(("a", "low"), ("b", "medium")), flag(("a", "high"),)
    none = spark.createDataFrame([], "run_id string, severity string")
    found = spark.createDataFrame([("r", "loop", "high")], "run_id string, flag string, severity string")
    card = json.loads(report.report_cards(asked, shifted, irt, none, found, none).first()["report"])
    assert [(q["question_id"], q["severity"]) for q in card["per_question"]] == [("b", "medium"), ("a", "high"), ("c", "none")]
    assert card["estimated_panel_exposure"] == {"high_severity_questions": 1, "medium_severity_questions": 1, "flagged_question_count": 2}
    assert card["redundancy_pairs"] == [] and card["screener_issues"] == [{"flag": "loop", "severity": "high"}]


def test_report_of_many_findings_goes_on_over_sheets(spark):
    asked = spark.createDataFrame([("r", f"q{i}", i, "nps") for i in range(5)] + [("s", "q0", 0, "nps")], "run_id string, question_id string, position int, type string")
    flags = spark.createDataFrame([("r", "q4", "high")], "run_id string, question_id string, severity string")
    found = spark.createDataFrame([("r", f"{i:02d}", "high") for i in range(11)] + [("s", "99", "low")], "run_id string, subject string, severity string")
    none = found.limit(0)
    cards = report.report_cards(asked, flags, flags, none, found, none, sheet_rows=4).orderBy("run_id", "sheet").collect()
    assert [(c["run_id"], c["sheet"]) for c in cards] == [("r", 0), ("r", 1), ("r", 2), ("s", 0)]
    r = [json.loads(c["report"]) for c in cards[:3]]
    assert [[x["subject"] for x in c["screener_issues"]] for c in r] == [["00", "01", "02", "03"], ["04", "05", "06", "07"], ["08", "09", "10"]]
    assert [[q["question_id"] for q in c["per_question"]] for c in r] == [["q0", "q1", "q2", "q3"], ["q4"], []]
    assert [c.get("estimated_panel_exposure", {}).get("flagged_question_count") for c in r] == [1, None, None]


def test_corpus_ids_keep_all_digits(spark):
    ids = spark.createDataFrame([(7,), (999,), (1000,), (12345,)], "idx long")
    named = {r["survey_id"].split("-")[1] for r in inject.clean_corpus(spark, ids).select("survey_id").collect()}
    assert named == {"007", "999", "1000", "12345"}


def test_seed_status_needs_at_least_one_run(spark):
    runs = spark.createDataFrame([("a", "completed"), ("b", "failed")], "run_id string, status string")
    row = report.seed_status(runs).first()
    assert (row["seeded"], row["completed"], row["all_completed"]) == (2, 1, False)
    assert report.seed_status(runs.where("run_id = 'x'")).first()["all_completed"] is False
