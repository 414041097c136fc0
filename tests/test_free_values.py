import random

import numpy as np
import pytest

from sondage.operators import free_values
from sondage.operators.free_values import value_distances


def area(a, b):
    values = np.unique(np.concatenate([a, b]))
    share = lambda x: np.searchsorted(np.sort(x), values, side="right") / len(x)
    return float((np.abs(share(a) - share(b))[:-1] * np.diff(values)).sum())


@pytest.mark.parametrize("partitions", ["1", "23"])
def test_distances_of_any_values_and_partitions(spark, partitions):
    rng = random.Random(4)
    rows = [(q, k, round(rng.gauss(k, 2 + (q == "b")), rng.choice([0, 6])), rng.randint(1, 3)) for q in "ab" for k in range(4) for _ in range(200)]
    rows += [("only base", 0, 1.0, 2), ("no base", 2, 1.0, 1), ("a", 1, None, 5), ("same", 0, 7.0, 3), ("same", 1, 7.0, 1), ("far", 0, 0.0, 1), ("far", 1, 1e9, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {(r["q"], r["variant"]): r for r in value_distances(spark.createDataFrame(rows, "q string, variant int, value double, n long"), ["q"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    held = {}
    for q, k, value, n in rows:
        if value is not None:
            held.setdefault((q, k), []).extend([value] * n)
    assert set(got) == {(q, k) for q, k in held if k and (q, 0) in held}
    for (q, k), r in got.items():
        assert r["wasserstein"] == pytest.approx(area(held[q, k], held[q, 0]))
        assert (r["n"], r["n_base"]) == (len(held[q, k]), len(held[q, 0]))


def test_no_values_and_no_list_of_values(spark):
    empty = spark.createDataFrame([], "q string, variant int, value double, n long")
    out = value_distances(empty, ["q"])
    assert out.count() == 0 and "collect_list" not in out._jdf.queryExecution().toString()


def test_ranges_follow_the_rows(spark):
    """No task orders many more rows than asked for, whatever the session's number of partitions."""
    rows = spark.range(4000).selectExpr("'q' AS q", "int(id % 4) AS variant", "double(id * 7919 % 4001) AS value", "1L AS n")
    seen = []
    whole, free_values.cut_lineage = free_values.cut_lineage, lambda df: seen.append(whole(df)) or seen[-1]
    try:
        got = {r["variant"]: (r["n"], r["n_base"]) for r in value_distances(rows, ["q"], part_rows=500).collect()}
    finally:
        free_values.cut_lineage = whole
    assert got == {k: (1000, 1000) for k in (1, 2, 3)}
    assert seen[0].count() == free_values.most_paired(rows, ["q"]) == 6000 and max(r["count"] for r in seen[0].groupBy("_part").count().collect()) < 1000
