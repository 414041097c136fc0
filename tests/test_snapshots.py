"""Versions of stored tables: readers and writers at work at the same time."""

import pytest

from sondage.sources import snapshots, storage, tables

KIND = "run_id string, persona_id string, question_id string, paraphrase_idx int, value double, ts bigint, seq bigint"


def table(spark, **parts):
    return spark.createDataFrame([(p, v) for p, values in parts.items() for v in values], "part string, value int")


def rows(df):
    return sorted(map(tuple, df.select("part", "value").collect()))


def put(spark, path, **parts):
    return snapshots.commit(spark, path, lambda version: table(spark, **parts), ["part"])


def test_readers_keep_their_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert snapshots.read(spark, path) is None and snapshots.current(spark, path) is None
    assert put(spark, path, a=[1, 2], b=[3]) == 0
    before = snapshots.read(spark, path)
    assert put(spark, path, b=[4], c=[5]) == 1
    assert rows(before) == rows(snapshots.read(spark, path, 0)) == [("a", 1), ("a", 2), ("b", 3)]
    assert rows(snapshots.read(spark, path)) == [("a", 1), ("a", 2), ("b", 4), ("c", 5)]


def test_what_a_stopped_writer_leaves_is_not_read(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    put(spark, path, a=[1])

    def broken(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(storage, "rename_new", broken)
        with pytest.raises(RuntimeError):
            put(spark, path, a=[2], b=[3])
    assert len(storage.names(spark, f"{path}/data")) == 2
    assert rows(snapshots.read(spark, path)) == [("a", 1)]
    assert put(spark, path, b=[4]) == 1 and rows(snapshots.read(spark, path)) == [("a", 1), ("b", 4)]


def test_a_writer_that_was_overtaken(spark, tmp_path):
    """In other partitions the rows stay as they are made; in the same ones they are made again from what the other left."""
    path = f"{tmp_path}/t"
    put(spark, path, a=[1], b=[1])
    seen = []

    def adding(part, overtaken_by):
        def make(version):
            if not seen:
                put(spark, path, **overtaken_by)
            seen.append(version)
            old = [r["value"] for r in snapshots.read(spark, path, version).where(f"part = '{part}'").collect()]
            return table(spark, **{part: [v + 10 for v in old]})
        return make

    assert snapshots.commit(spark, path, adding("a", {"b": [2]}), ["part"]) == 2 and seen == [0]
    assert rows(snapshots.read(spark, path)) == [("a", 11), ("b", 2)]
    seen.clear()
    assert snapshots.commit(spark, path, adding("a", {"a": [5]}), ["part"]) == 4 and seen == [2, 3]
    assert rows(snapshots.read(spark, path)) == [("a", 15), ("b", 2)]


def test_a_writer_that_always_loses_says_so(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    put(spark, path, a=[1])
    monkeypatch.setattr(storage, "rename_new", lambda *_: False)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, lambda version: table(spark, a=[2]), ["part"], attempts=2)
    assert rows(snapshots.read(spark, path)) == [("a", 1)] and storage.names(spark, f"{path}/staged") == []


def test_space_comes_back_and_kept_versions_stay(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, a=[1], b=[1], c=[1], d=[1])
    for k in range(2, 5):
        put(spark, path, a=[k], b=[k])
    assert snapshots.compact(spark, path, ["part"]) == 4  # half of the first commit is dead
    want = [("a", 4), ("b", 4), ("c", 1), ("d", 1)]
    assert rows(snapshots.read(spark, path)) == want and snapshots.compact(spark, path, ["part"]) is None
    assert snapshots.expire(spark, path, 2) == [0, 1, 2]
    assert rows(snapshots.read(spark, path)) == rows(snapshots.read(spark, path, 3)) == want
    assert snapshots.expire(spark, path, 1) == [3] and len(storage.names(spark, f"{path}/data")) == 2
    assert rows(snapshots.read(spark, path)) == want and snapshots.expire(spark, path, 1) == []


def test_values_keep_their_types_and_nulls_are_refused(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, **{"007": [1], "2024-01-01": [2]})
    assert rows(snapshots.read(spark, path)) == [("007", 1), ("2024-01-01", 2)]
    with pytest.raises(ValueError):
        snapshots.commit(spark, path, lambda version: spark.createDataFrame([(None, 1)], "part string, value int"), ["part"])
    assert put(spark, f"{tmp_path}/none") == 0 and snapshots.read(spark, f"{tmp_path}/none") is None


def test_two_upserts_of_one_run_lose_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/responses"
    batch = lambda who, value, ts: spark.createDataFrame([("r", who, "q", 0, value, ts, ts)], KIND)
    tables.upsert_responses(spark, path, batch("p1", 1.0, 1), buckets=1)
    before = tables.read_responses(spark, path)
    real, once = storage.rename_new, []

    def overtaken(*args):
        if not once:
            once.append(True)
            tables.upsert_responses(spark, path, batch("p2", 2.0, 2))
        return real(*args)

    monkeypatch.setattr(storage, "rename_new", overtaken)
    tables.upsert_responses(spark, path, batch("p1", 3.0, 3))
    got = lambda df: sorted((r["persona_id"], r["value"]) for r in df.collect())
    assert got(before) == [("p1", 1.0)] and got(tables.read_responses(spark, path)) == [("p1", 3.0), ("p2", 2.0)]
    tables.tidy_responses(spark, path, keep=1)
    assert got(tables.read_responses(spark, path)) == [("p1", 3.0), ("p2", 2.0)] and len(storage.names(spark, f"{path}/data")) == 1
