import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import documents, empty, messy

from sondage.llm import language_model, ngram_blocks
from sondage.llm.language_model import fit_and_score


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def fold(doc_id):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def brute(rows):
    """Counts and scores with dictionaries; the weights from exact frequencies instead of the grid."""
    parts = {True: [Counter() for _ in range(3)], False: [Counter() for _ in range(3)]}
    for doc_id, text in rows:
        if fold(doc_id) != 2:
            t = tokens(text)
            for counter, items in zip(parts[fold(doc_id) == 3], (t, ["S", *t[:-1]], zip(["S", *t[:-1]], t))):
                counter.update(items)
    kept, held = parts[False], parts[True]
    everything = [a + b for a, b in zip(kept, held)]
    n, v, n_kept = sum(everything[0].values()), len(everything[0]), max(1, sum(kept[0].values()))
    cells = [(kept[1][a], kept[2][a, b] / max(1, kept[1][a]), kept[0][b] / n_kept, c) for (a, b), c in held[2].items()]
    bucket = lambda c: 0 if c == 0 else c.bit_length()
    weights = ngram_blocks.learn_weights(*[np.array(x) for x in zip(*[(bucket(c), f2, f1, m) for c, f2, f1, m in cells])], 1 / (v + 1))
    out = []
    for doc_id, text in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for a, b in zip(["S", *t[:-1]], t):
            w = weights[bucket(everything[1][a])]
            base += math.log10((everything[0][b] + 1) / (n + v + 1))
            score += math.log10(w[0] * everything[2][a, b] / max(1, everything[1][a]) + w[1] * everything[0][b] / n + w[2] / (v + 1))
        out.append((doc_id, len(t), sum(everything[0][x] > 0 for x in t), n, base, score))
    return sorted(out, key=str)


def score(docs):
    k = F.crc32(F.col("doc_id").cast("string")) % 7
    return fit_and_score(docs, F.coalesce(k != 2, F.lit(True)), k == 3)


def compare(docs, tolerance):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted((tuple(r) for r in score(docs).collect()), key=str)
    order = lambda rows: sorted(rows, key=lambda r: (str(r[0]), r[1:4], round(r[4], 6)))
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=tolerance)


def test_given_documents(spark):
    compare(documents(spark), 0.01)


def test_messy_rows_in_small_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 200)
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 3_000)
    compare(messy(spark), 0.03)


def test_empty_table_and_no_training(spark):
    assert score(empty(spark)).count() == 0
    rows = fit_and_score(messy(spark), F.lit(False), F.lit(False)).collect()
    assert rows and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_the_model_beats_its_base_on_unseen_text(spark):
    held = score(documents(spark, "sf0.01")).where(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    mean = held.agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert mean[0] > mean[1] + 0.3


def test_probabilities_add_up_to_one():
    weights = ngram_blocks.learn_weights(np.array([1, 1, 2]), np.array([0.5, 0.0, 0.2]), np.array([0.1, 0.2, 0.3]), np.array([5, 3, 2]), 0.01)
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0 and (weights[1:] > 0).all()
    places = ngram_blocks.grid(np.array([0.0, 1.0, 0.5, 1e-9]))
    assert np.allclose(ngram_blocks.ungrid(places), [0, 1, 0.5, 1e-9], rtol=0.03)
    assert ngram_blocks.context_bucket(np.array([0, 1, 2, 3, 4])).tolist() == [0, 1, 2, 2, 3]
