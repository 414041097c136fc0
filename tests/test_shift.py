"""Wording shift: small hand-made panels, brute force and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage.operators import responses as resp
from sondage.operators import shift

SCHEMA = "run_id string, persona_id string, question_id string, paraphrase_idx int, value double"


def table(spark, rows):
    return spark.createDataFrame([("r", f"p{p}", q, k, v) for p, q, k, v in rows], SCHEMA)


def questions(spark, *rows):
    return spark.createDataFrame(
        [("r", *row) for row in rows], "run_id string, question_id string, type string, n_options int"
    )


def one(spark, rows, kind="likert_5", n_options=0):
    flags = shift.shift_flags(table(spark, rows), questions(spark, ("q", kind, n_options)))
    return flags.first().asDict()


def area(a, b):
    """Mean gap of sorted samples, or of the two quantile functions when sizes differ."""
    size = math.lcm(len(a), len(b))
    a, b = np.sort(np.repeat(a, size // len(a))), np.sort(np.repeat(b, size // len(b)))
    return float(np.abs(a - b).mean())


def test_last_write_wins(spark):
    rows = spark.createDataFrame(
        [("r", "p", "q", 0, 1.0, 5, 1), ("r", "p", "q", 0, 2.0, 7, 1), ("r", "p", "q", 0, 3.0, 7, 2)],
        SCHEMA + ", ts int, seq int",
    )
    out = resp.latest_responses(rows).collect()
    assert [r["value"] for r in out] == [3.0]


def test_matched_panel_is_the_intersection(spark):
    seen = {0: [1, 2, 3], 1: [2, 3], 2: [3, 4]}
    rows = [(p, "q", k, 1.0) for k, people in seen.items() for p in people]
    assert [r["persona_id"] for r in resp.matched_panel(table(spark, rows)).collect()] == ["p3"]


def test_missing_value_still_counts_as_present(spark):
    rows = [(p, "q", k, None if (p, k) == (1, 1) else 3.0) for p in range(6) for k in (0, 1)]
    flag = one(spark, rows)
    assert flag["n_personas"] == 6 and flag["metric"] == "wasserstein"
    means = {r["paraphrase_idx"]: r["n"] for r in shift.shift_examples(resp.matched_histogram(table(spark, rows))).collect()}
    assert means == {0: 6, 1: 5}


def test_constant_answers_do_not_shift(spark):
    flag = one(spark, [(p, "q", k, 3.0) for p in range(20) for k in range(4)])
    assert (flag["score"], flag["cohens_d"], flag["severity"]) == (0.0, None, "none")


def test_opposite_ends_are_high(spark):
    rng = random.Random(1)
    rows = [(p, "q", k, float(rng.choice([1, 2, 3] if k == 0 else [3, 4, 5]))) for p in range(80) for k in range(3)]
    flag = one(spark, rows)
    assert flag["score"] > 1.0 and flag["cohens_d"] < -0.5 and flag["severity"] == "high"
    assert flag["summary"].startswith("deflates mean by")


def test_choice_shift_is_never_high(spark):
    rows = [(p, "q", k, 0.0 if k == 0 else 2.0) for p in range(40) for k in range(2)]
    flag = one(spark, rows, "single_choice", 3)
    assert flag["metric"] == "jensen_shannon"
    assert flag["score"] == pytest.approx(math.sqrt(math.log(2)))
    assert flag["severity"] == "medium"


def test_options_out_of_range_are_ignored(spark):
    rows = [(p, "q", k, 9.0 if k == 0 else 1.0) for p in range(10) for k in range(2)]
    flag = one(spark, rows, "single_choice", 3)
    assert (flag["metric"], flag["note"]) == ("skipped", "no options or no original responses")


@pytest.mark.parametrize("people,metric", [(4, "skipped"), (5, "wasserstein")])
def test_five_matched_respondents_are_needed(spark, people, metric):
    assert one(spark, [(p, "q", k, float(p % 3)) for p in range(people) for k in range(2)])["metric"] == metric


def test_skips_and_notes(spark):
    assert one(spark, [(1, "q", 0, 1.0)], "open_end")["n_personas"] == 0
    assert one(spark, [(p, "q", 1, 1.0) for p in range(9)])["note"] == "no original responses available"
    assert "not implemented" in one(spark, [(p, "q", 0, 1.0) for p in range(9)], "multi_choice")["note"]
    absent = shift.shift_flags(table(spark, [(1, "x", 0, 1.0)]), questions(spark, ("q", "nps", 0))).first()
    assert absent["note"].startswith("insufficient")


def test_ties_go_to_the_lowest_variant(spark):
    rows = [(p, "q", k, float(3 + (0, 1, -1, 1)[k] * (1 + p % 2))) for p in range(10) for k in range(4)]
    worst = shift.worst_variant(shift.ordinal_shift(resp.matched_histogram(table(spark, rows)))).first()
    assert worst["worst_idx"] == 1 and worst["cohens_d"] < 0


def test_distance_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for q in range(12):
        n = int(rng.integers(6, 40))
        drawn = {k: rng.integers(0, 11, n).astype(float) for k in range(4)}
        for k, values in drawn.items():
            missing = rng.random(n) < 0.1
            rows += [(p, f"q{q}", k, None if missing[p] else float(v)) for p, v in enumerate(values)]
            drawn[k] = values[~missing]
        for k in (1, 2, 3):
            a, b = drawn[0], drawn[k]
            pooled = (a.var(ddof=1) + b.var(ddof=1)) / 2
            want[(f"q{q}", k)] = area(a, b), (a.mean() - b.mean()) / math.sqrt(pooled)
    got = shift.ordinal_shift(resp.matched_histogram(table(spark, rows).repartition(7))).collect()
    assert len(got) == len(want)
    for r in got:
        w, d = want[(r["question_id"], r["paraphrase_idx"])]
        assert r["wasserstein"] == pytest.approx(w, abs=1e-9) and r["cohens_d"] == pytest.approx(d, abs=1e-9)


def test_shifting_by_a_constant_gives_that_distance(spark):
    rng = random.Random(2)
    base = {p: float(rng.randint(0, 7)) for p in range(30)}
    rows = [(p, "q", k, v + 2 * (k == 1)) for p, v in base.items() for k in range(3)]
    got = {r["paraphrase_idx"]: r["wasserstein"] for r in shift.ordinal_shift(resp.matched_histogram(table(spark, rows))).collect()}
    assert got == {1: pytest.approx(2.0), 2: 0.0}


def test_choice_distances_stay_in_range(spark):
    rng = random.Random(5)
    rows = [(p, f"q{q}", k, float(rng.randint(-1, 5))) for q in range(6) for p in range(25) for k in range(4)]
    asked = questions(spark, *[(f"q{q}", "single_choice", 5) for q in range(6)])
    out = shift.choice_distances(resp.matched_histogram(table(spark, rows)), asked)
    low, high, tv_low, tv_high = out.agg(F.min("js"), F.max("js"), F.min("tv"), F.max("tv")).first()
    assert 0 <= low and high <= math.sqrt(math.log(2)) and 0 <= tv_low and tv_high <= 1


def test_jaccard_counts_empty_selections_as_equal(spark):
    rows = [("r", f"p{p}", "q", k, v) for p, pair in enumerate([([], []), ([0, 1], [1, 2])]) for k, v in enumerate(pair)]
    sets = spark.createDataFrame(rows, SCHEMA.replace("value double", "value array<int>"))
    assert shift.jaccard_shift(sets).first()["jaccard"] == pytest.approx((0 + 2 / 3) / 2)
