import pytest
from tables import CLASHES, documents, empty, messy

from sondage.llm import near_join
from sondage.llm import shingles as sh
from sondage.llm.components import components
from sondage.llm.near_join import keep_one_of_each, near_groups


def brute(rows, words=5, percent=80):
    """n_shingles and component of each row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    up[top(a)] = top(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(k)] = min(doc_id, least.get(top(k), doc_id))
    return sorted(((r[0], len(sets[k]), least.get(top(k)) if sets[k] else r[0]) for k, r in enumerate(rows)), key=str)


def got(docs, **more):
    return sorted((tuple(r) for r in near_groups(docs, **more).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_given_documents(spark):
    docs = documents(spark)
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_messy_rows_and_empty_table(spark):
    docs = messy(spark)
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(empty(spark)) == []


@pytest.fixture(scope="module")
def families(spark):
    """Near copies in chains and stars around the threshold, all with one common passage."""
    import random

    draw, rows = random.Random(3), []
    shared = [f"common{k}" for k in range(12)]
    for family in range(6):
        base = [f"f{family}w{draw.randrange(400)}" for _ in range(60)] + shared
        for k in range(14):
            copy = list(base)
            for _ in range(draw.randrange(4)):
                copy[draw.randrange(len(copy))] = f"edit{draw.randrange(9)}"
            if k % 5 == 4:
                base = copy
            rows.append((len(rows), " ".join(copy)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_families_in_slices_and_small_flushes(spark, families, monkeypatch):
    rows, docs = families
    want = brute(rows)
    assert len({c for *_, c in want}) < len(rows)
    assert got(docs) == want
    monkeypatch.setattr(near_join, "SLICE", 4)
    monkeypatch.setattr(near_join, "FLUSH", 100)
    monkeypatch.setattr(near_join, "BUCKET_BYTES", 500)
    assert got(docs) == want
    assert got(docs, words=2, percent=60) == brute(rows, 2, 60)


def test_one_of_each_group_stays_with_all_columns(spark):
    docs = messy(spark)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and set(CLASHES) < set(kept.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 9 in ids and 10 not in ids and 11 in ids and 12 not in ids and ids.count(None) == 1 and ids.count(1) + ids.count(2) == 1 + (2 in ids and 1 in ids) and {4, 5, 6} < set(ids)
    assert keep_one_of_each(empty(spark)).count() == 0


def test_exactly_one_row_stays_without_ids_and_with_repeated_ones(spark):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(None, body, 1), (None, body, 1), (None, body + " end", 2), (7, "a b c d e f g h", 3), (7, "a b c d e f g h", 4), (7, "a b c d e f g h", 4),
            (8, body.replace("w", "v"), 5), (8, body.replace("w", "v") + " end", 6), (9, " ", 7), (9, " ", 7), (None, None, 8)]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:1]) for r in kept) == [("7", "a"), ("8", "v"), ("9", " "), ("9", " "), ("None", ""), ("None", "w")]


def test_divide_skip_equals_counting():
    import random

    draw = random.Random(1)
    rows = []
    for _ in range(80):
        base = draw.choice([range(0, 40), range(20, 60), range(100, 130)])
        rows.append((draw.sample(list(base), draw.randrange(20, 30)), 0))
    rows = [(r, len(r) + draw.randrange(3)) for r, _ in rows]
    index = sh.Index(rows)
    for r, n in rows:
        want = {k for k, (s, m) in enumerate(rows) if sh.similar(len(set(s) & set(r)), n, m, 60)}
        assert {k for k, _ in index.search(r, n, 60)} == want
        assert all(c == len(set(rows[k][0]) & set(r)) for k, c in index.search(r, n, 60))


def test_components_of_paths_stars_and_nothing(spark):
    import hashlib

    name = lambda x: hashlib.md5(str(x).encode()).digest()
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    root = {bytes(r["node"]): bytes(r["root"]) for r in components(df).collect()}
    assert len({root[name(k)] for k in range(41)}) == 1 and len({root[name(k)] for k in range(100, 130)}) == 1
    assert len(set(root.values())) == 3 and name(300) not in root
    assert components(df.limit(0)).count() == 0
