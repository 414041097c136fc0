"""Redundancy and discrimination against NumPy and planted parameters."""

import numpy as np
import pandas as pd
import pytest

from sondage.operators import irt, kernels, redundancy


def average_ranks(x):
    return pd.Series(x).rank(method="average").to_numpy()


def items_frame(spark, matrix, run="r"):
    rows = [
        (run, f"p{i}", j, float(x)) for i, row in enumerate(matrix) for j, x in enumerate(row) if not np.isnan(x)
    ]
    return spark.createDataFrame(rows, "run_id string, persona_id string, position int, value double")


def brute_pairs(matrix, min_pairs=20):
    out = {}
    for a in range(matrix.shape[1]):
        for b in range(a + 1, matrix.shape[1]):
            both = ~np.isnan(matrix[:, a]) & ~np.isnan(matrix[:, b])
            x, y = matrix[both, a], matrix[both, b]
            if both.sum() >= min_pairs and x.std() > 0 and y.std() > 0:
                out[a, b] = np.corrcoef(x, y)[0, 1], np.corrcoef(average_ranks(x), average_ranks(y))[0, 1], int(both.sum())
    return out


@pytest.mark.parametrize("levels", [5, 100_000])
def test_pairs_equal_numpy_with_missing_answers(spark, levels):
    rng = np.random.default_rng(levels)
    matrix = rng.integers(0, levels, (120, 6)).astype(float)
    matrix[:, 3] = matrix[:, 0] + rng.integers(0, 2, 120)
    matrix[rng.random(matrix.shape) < 0.2] = np.nan
    matrix[:, 5] = 2.0
    want = brute_pairs(matrix)
    got = redundancy.redundancy_pairs(items_frame(spark, matrix)).collect()
    assert {(r["pos_a"], r["pos_b"]) for r in got} == set(want)
    for r in got:
        p, s, n = want[r["pos_a"], r["pos_b"]]
        assert (r["pearson"], r["spearman"], r["n_personas"]) == (pytest.approx(p), pytest.approx(s), n)


def test_too_few_common_respondents_give_no_pair(spark):
    matrix = np.random.default_rng(0).integers(1, 6, (19, 3)).astype(float)
    assert redundancy.redundancy_pairs(items_frame(spark, matrix)).count() == 0


def test_gram_blocks_add_up(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"run_id": "r", "pos": [[0, 1, 2]] * 3000, "value": rng.normal(size=(3000, 3)).tolist()})
    out = pd.concat(kernels.pair_cells(iter([pdf])))
    assert out["n"].sum() == 3000 * 3


def test_severities_and_direction(spark):
    pairs = spark.createDataFrame(
        [("r", 0, 1, 30, 0.85, 0.8), ("r", 0, 2, 30, -0.7, -0.7), ("r", 1, 2, 30, 0.69, 0.9)],
        "run_id string, pos_a int, pos_b int, n_personas bigint, pearson double, spearman double",
    )
    asked = spark.createDataFrame([("r", i, f"Q{i}") for i in range(3)], "run_id string, position int, question_id string")
    flags = {(r["q_id_a"], r["q_id_b"]): r for r in redundancy.redundancy_flags(pairs, asked).collect()}
    assert {k: r["severity"] for k, r in flags.items()} == {("Q0", "Q1"): "high", ("Q0", "Q2"): "medium"}
    assert "the same" in flags["Q0", "Q1"]["summary"] and "-0.70" in flags["Q0", "Q2"]["summary"]


def test_dichotomise_is_strictly_above_an_exact_median(spark):
    rows = [("r", f"p{i}", "a", float(v)) for i, v in enumerate([1, 2, 3, 4])] + [("r", "p9", "a", None)]
    items = spark.createDataFrame(rows, "run_id string, persona_id string, item string, value double")
    got = {r["persona_id"]: r["y"] for r in irt.dichotomize(items).collect()}
    assert got == {"p0": 0, "p1": 0, "p2": 1, "p3": 1}


def planted(spark, a, n=1500, seed=4, run="r", missing=0.0):
    rng = np.random.default_rng(seed)
    theta = rng.normal(size=n)
    b = rng.normal(scale=0.5, size=len(a))
    p = 1 / (1 + np.exp(-np.asarray(a) * (theta[:, None] - b)))
    y = (rng.random(p.shape) < p).astype(int)
    keep = rng.random(p.shape) >= missing
    rows = [(run, f"p{i}", f"i{j}", int(y[i, j])) for i in range(n) for j in range(len(a)) if keep[i, j]]
    return spark.createDataFrame(rows, "run_id string, persona_id string, item string, y int")


def rank_agreement(a, fit):
    found = [fit[f"i{j}"] for j in range(len(a))]
    return np.corrcoef(average_ranks(a), average_ranks(found))[0, 1]


def test_fit_recovers_planted_order(spark):
    a = [0.2, 0.4, 0.6, 0.9, 1.2, 1.5, 1.8, 2.0]
    binary = planted(spark, a, missing=0.05).unionByName(planted(spark, [1.0, 1.0], n=20, run="tiny"))
    local = irt.fit_discrimination(binary).collect()
    assert {r["run_id"] for r in local} == {"r"} and all(r["converged"] for r in local)
    by_item = {r["item"]: r["a"] for r in local}
    assert rank_agreement(a, by_item) >= 0.9


def test_a_run_gets_one_answer_whatever_its_neighbours_and_slices(spark):
    quick, slow = planted(spark, [0.5, 1.0, 1.5, 2.0], n=300, run="quick"), planted(spark, [0.2, 3.5, 0.3, 3.0], n=900, seed=9, run="slow")
    fit = lambda df, **more: {(r["run_id"], r["item"]): (r["a"], r["b"], r["iterations"]) for r in irt.fit_discrimination(df, **more).collect()}
    alone = fit(quick) | fit(slow.repartition(7))
    assert len({i for *_, i in alone.values()}) > 1
    for together in (fit(quick.unionByName(slow)), fit(quick.unionByName(slow).repartition(5), task_patterns=7)):
        assert together.keys() == alone.keys()
        for k, (a, b, n) in together.items():
            assert (a, b, n) == (pytest.approx(alone[k][0], abs=1e-6), pytest.approx(alone[k][1], abs=1e-6), alone[k][2])


def test_unsettled_fit_falls_back_to_variance(spark):
    rows = [("r", f"p{i}", j, int(i == 0 if j == "same" else i % 2)) for i in range(40) for j in ("same", "mixed")]
    binary = spark.createDataFrame(rows, "run_id string, persona_id string, item string, y int")
    flags = {r["question_id"]: r for r in irt.irt_flags(irt.fit_discrimination(binary, max_iterations=1)).collect()}
    assert {r["interpretation"] for r in flags.values()} == {"experimental"}
    assert (flags["same"]["severity"], flags["mixed"]["severity"]) == ("high", "none")
    assert flags["same"]["discrimination"] == pytest.approx(np.var([1] + [0] * 39, ddof=1))


def test_degenerate_items_stay_inside_the_bounds(spark):
    rows = [("r", f"p{i}", j, int({"zero": 0, "one": 1}.get(j, i % 2))) for i in range(60) for j in ("zero", "one", "x", "y")]
    binary = spark.createDataFrame(rows, "run_id string, persona_id string, item string, y int")
    for r in irt.fit_discrimination(binary).collect():
        assert 0.05 <= r["a"] <= 4.0 and -5 <= r["b"] <= 5
