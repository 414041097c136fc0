"""The histogram that a stream keeps: equal to a batch at any time, without reading the answers."""

import random

import pytest
from test_logs import feed

from sondage.operators.responses import answer_cells, latest_responses, matched_histogram
from sondage.operators.shift import shift_flags
from sondage.sources import statistics, storage
from sondage.streaming import ingest

KIND = "run_id string, persona_id string, question_id string, paraphrase_idx int, value double, ts bigint, seq bigint"


def answers(spark, n=700, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(["r", "s"]), f"p{rng.randint(0, 9)}", rng.choice("ab"), rng.randint(0, 2), rng.choice([None, 1.0, 2.0, 3.0, 4.0]), i * 7919 % n, i)
            for i in range(n)]
    return spark.createDataFrame(rows, KIND)


def same(a, b):
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    return rows(a) == rows(b)


def test_stream_keeps_the_histogram(spark, tmp_path):
    df = answers(spark)
    stream = feed(spark, df, f"{tmp_path}/in", 7, ["seq"])
    ingest.keep_statistics(stream, f"{tmp_path}/kept", f"{tmp_path}/cp", buckets=2, compact_after=2).awaitTermination()
    latest = latest_responses(df)
    assert same(statistics.read_cells(spark, f"{tmp_path}/kept"), answer_cells(latest))
    assert same(statistics.stored_histogram(spark, f"{tmp_path}/kept"), matched_histogram(latest))
    names = storage.names(spark, f"{tmp_path}/kept/cells")
    assert sum(n.startswith("base=") for n in names) == 2 and "batch=0" not in names
    asked = spark.createDataFrame([("r", "a", "likert_5", 0), ("s", "b", "single_choice", 6)], "run_id string, question_id string, type string, n_options int")
    flags = ingest.kept_flags(spark, f"{tmp_path}/kept", asked)
    assert flags.inputFiles() and all("/cells/" in f for f in flags.inputFiles())
    assert same(flags, shift_flags(latest, asked))


@pytest.mark.parametrize("stopped", ["before", "between", "after"])
def test_a_stopped_batch_is_finished_and_not_counted_twice(spark, tmp_path, monkeypatch, stopped):
    df = answers(spark, 200).persist()
    first, second = df.where("seq % 3 > 0"), df.where("seq % 3 = 0")
    path = f"{tmp_path}/kept"
    statistics.apply_batch(spark, path, first, 0, 2)
    real = statistics.upsert_responses

    def broken(*a, **k):
        raise RuntimeError("stopped")

    if stopped == "before":
        monkeypatch.setattr(statistics, "cell_changes", broken)
    elif stopped == "between":
        monkeypatch.setattr(statistics, "upsert_responses", broken)
    else:
        monkeypatch.setattr(statistics, "upsert_responses", lambda *a, **k: (real(*a, **k), broken()))
    with pytest.raises(RuntimeError):
        statistics.apply_batch(spark, path, second, 1, 2)
    monkeypatch.undo()
    statistics.apply_batch(spark, path, second, 1, 2)
    statistics.apply_batch(spark, path, second, 1, 2)
    assert same(statistics.read_cells(spark, path), answer_cells(latest_responses(df)))


def test_a_changed_answer_moves_and_an_older_one_does_not(spark, tmp_path):
    path = f"{tmp_path}/kept"
    one = lambda value, ts: spark.createDataFrame([("r", "p", "a", 0, value, ts, ts)], KIND)
    for k, (value, ts) in enumerate([(1.0, 5), (2.0, 9), (3.0, 7), (None, 10)]):
        statistics.apply_batch(spark, path, one(value, ts), k, 2)
    assert [tuple(r) for r in statistics.read_cells(spark, path).select("value", "n").collect()] == [(None, 1)]
    changes = [spark.read.parquet(f"{path}/cells/batch={k}").select("value", "n").collect() for k in range(4)]
    assert [sorted((r["n"], r["value"]) for r in c) for c in changes[:3]] == [[(1, 1.0)], [(-1, 1.0), (1, 2.0)], []]
