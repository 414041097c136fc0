import hashlib
import zlib

from pyspark.sql import functions as F
from tables import documents, empty, messy, plain

from sondage.llm.exact import exact_groups
from sondage.llm.sharding import shard_by_size

LOWER = {c: c + 32 for c in range(65, 91)}


def expected_groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups_match_brute_force(spark):
    for docs in (documents(spark), messy(spark)):
        want = expected_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert sorted((tuple(r) for r in exact_groups(docs).collect()), key=str) == want
        short = exact_groups(docs, pattern=r"(?s).{4,19}?[aeiou]\s|(?s).{1,20}")
        assert sorted((tuple(r) for r in short.collect()), key=str) == want


def test_unverified_digests_are_told_apart(spark):
    docs = messy(spark)
    weak = exact_groups(docs, pattern=r"(?s).{1,8}", digest=lambda c: F.length(c).cast("long"))
    assert sorted((tuple(r) for r in weak.collect()), key=str) == expected_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_shards_match_brute_force(spark):
    for docs in (documents(spark), messy(spark)):
        rows = sorted(((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in docs.collect()),
                      key=lambda r: (r[0] is not None, r))
        total, at, want, slots = sum(r[2] for r in rows), 0, [], {}
        for doc_id, crc, size in rows:
            shard = at * 40 // total
            want.append((doc_id, size, crc, shard, slots.get(shard, 0)))
            slots[shard] = slots.get(shard, 0) + 1
            at += size
        assert sorted((tuple(r) for r in shard_by_size(docs).collect()), key=str) == sorted(want, key=str)


def test_shards_are_balanced(spark):
    sizes = shard_by_size(documents(spark, "sf0.01")).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    assert len(sizes) == 40
    mean = sum(r["b"] for r in sizes) / 40
    assert all(abs(r["b"] - mean) <= max(r["m"], max(x["m"] for x in sizes)) for r in sizes)


def test_empty_tables(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert plain(shard_by_size(empty(spark))) == []
