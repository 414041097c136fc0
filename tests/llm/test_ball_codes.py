import math

import numpy as np
from tables import plain

from sondage.llm import ball_codes
from sondage.llm.ball_codes import compress_vectors, make_balls, nearest, reassign

KIND = "vec_id long, embedding array<float>, label int, row string, codes string, error int"


def rows(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, k % 3 or None, "x", "y", k) for k, (i, v) in enumerate(zip(ids, vectors))], KIND).repartition(3)


def brute(vectors, parts, entries, rounds):
    """Every part against every entry, in plain whole numbers."""
    whole = [[math.floor(1024 * float(np.float32(x))) for x in v] for v in vectors]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        codes = [[min(range(len(b)), key=lambda e: (far(v, b[e]), e)) for v in c] for c, b in zip(cut, books)]
        if k == rounds:
            return list(zip(*codes)), [sum(far(cut[p][i], books[p][codes[p][i]]) for p in range(parts)) for i in range(len(whole))], books
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v for v, c in zip(cut[p], codes[p]) if c == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]


def check(spark, vectors, entries=8, rounds=4):
    coded, books = compress_vectors(rows(spark, vectors), entries=entries, rounds=rounds)
    codes, errors, expected = brute(vectors, 4, entries, rounds)
    assert books.tolist() == expected
    assert plain(coded.select("row.vec_id", "codes", "error")) == [(i, list(c), e) for i, (c, e) in enumerate(zip(codes, errors))]


def test_against_every_entry(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=(12, 16)).repeat(25, axis=0) + rng.normal(size=(300, 16)) * 0.05
    check(spark, near.tolist(), entries=16)
    check(spark, rng.integers(-2, 3, size=(200, 8)).astype(float).tolist())  # full of ties


def test_equal_vectors_few_rows_and_large_numbers(spark):
    check(spark, [[0.5, -0.5, 0.25, 1.0]] * 40 + [[0.5, -0.5, 0.25, 2.0]])
    check(spark, [[1.0, 2.0, 3.0, -4.0]], entries=256)
    check(spark, [[150_000.0 * s, -1.5, float(s), 2.0 * k] for k in range(20) for s in (1, -1)])
    check(spark, np.random.default_rng(1).normal(size=(30, 8)).tolist(), rounds=0)


def test_unusable_vectors_ids_and_empty_tables(spark):
    good, ids = [[0.1 * k, 0.2, -0.3, k % 4 / 4] for k in range(12)], [7, 7, 3, None, 5, 1, 2, None, 9, 8, 4, 6]
    bad = [None, [], [1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [1e9, 0.0, 0.0, 0.0]]
    coded, books = compress_vectors(rows(spark, good + bad, ids + [20] * len(bad)), entries=4)
    order = sorted(range(12), key=lambda k: (ids[k] is None, ids[k] or 0, good[k]))
    codes, errors, expected = brute([good[k] for k in order], 4, 4, 4)
    assert books.tolist() == expected
    wanted = sorted((str(ids[k]), list(c), e) for k, c, e in zip(order, codes, errors))
    assert sorted((str(r["vec_id"]), r["codes"], r["error"]) for r in coded.select("row.vec_id", "codes", "error").collect()) == wanted
    coded, books = compress_vectors(rows(spark, bad[:1]))
    assert coded.count() == 0 and books.size == 0
    assert coded.select("row.*").columns == ["vec_id", "embedding", "label", "row", "codes", "error"]


def test_rings_give_what_a_full_search_gives():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, size=(4000, 5))
    before = x[:40].copy()
    code = nearest(x, before)
    far = np.array([((x[code == e] - before[e]) ** 2).sum(axis=1).max(initial=-1) for e in range(40)])
    after = before.copy()
    after[:6] += rng.integers(-40, 40, size=(6, 5))
    balls = make_balls(after, before, far)
    assert (reassign(x, code, balls) == nearest(x, after)).all()
    still = make_balls(before, before, far)
    assert still.quiet.all() and (reassign(x, code, still) == code).all()
    assert ball_codes.component_limit(16, 4) > 2**27
