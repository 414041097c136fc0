import re

import pytest
from tables import CLASHES, documents, empty, messy

from sondage.llm.decontaminate import drop_contaminated, find_occurrences
from sondage.llm.wu_manber import Matcher, build, merge, words_of

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, items, window=13):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, who = set(), set()
    for item_id, body in items:
        own = WORDS.findall((body or "").translate({c: c + 32 for c in range(65, 91)}))
        size = min(window, len(own))
        wanted = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1 if own else 0):
            if tuple(words[k : k + size]) in wanted:
                hit |= set(range(k, k + size))
                who.add("" if item_id is None else str(item_id))
    return len(words), len(hit), sorted(who)


def compare(docs, benchmark, **more):
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    for r in find_occurrences(docs, benchmark, keep=["doc_id", "text"], **more).collect():
        found = (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["item_ids"])
        assert found == brute(r["row"]["text"], items, more.get("window", 13)), r["row"]["doc_id"]


def test_given_tables(spark):
    compare(documents(spark), documents(spark, name="benchmark"))


@pytest.fixture(scope="module")
def odd_benchmark(spark):
    return spark.createDataFrame(
        [(1, "QUICK brown fox"), (2, "one"), (3, None), (4, ""), (None, "lazy dog"), (10, " ".join(f"passage{k}" for k in range(20, 45))),
         (2, "one"), (9, "É é"), (11, "quick brown fox jumps over the lazy dog and runs far away now"), (12, "the the")], "item_id long, text string")


def test_messy_rows_in_one_pass_and_in_many(spark, odd_benchmark):
    compare(messy(spark), odd_benchmark)
    compare(messy(spark), odd_benchmark, block_bytes=1)
    compare(messy(spark), odd_benchmark, window=2)


def test_empty_sides(spark, odd_benchmark):
    assert find_occurrences(empty(spark), odd_benchmark).count() == 0
    rows = find_occurrences(messy(spark), odd_benchmark.limit(0)).collect()
    assert rows and all(r["spans"] == [] and r["item_ids"] == [] and r["n_words"] is not None for r in rows)


def test_dropping_keeps_all_columns(spark, odd_benchmark):
    docs = messy(spark)
    kept = drop_contaminated(docs, odd_benchmark)
    assert kept.columns == docs.columns and set(CLASHES) < set(kept.columns)
    items = [(r["item_id"], r["text"]) for r in odd_benchmark.collect()]
    clean = [r for r in docs.collect() if (b := brute(r["text"], items))[1] == 0 or 20 * b[1] < b[0]]
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean))


def test_matcher_finds_overlapping_windows():
    m = Matcher(3)
    for w in ((b"a", b"b", b"a"), (b"b", b"a", b"b")):
        m.add(w, str(w[0]))
    assert [s for s, _ in m.search([b"a", b"b", b"a", b"b", b"a"])] == [0, 1, 2]
    assert merge([(4, 6), (0, 2), (1, 3)]) == [(0, 3), (4, 6)]
    assert build([("x", None), ("y", b"")], 13) == [] and words_of(None) == []
