import random

import pytest
from pyspark.sql import functions as F
from tables import CLASHES, documents, empty, messy

from sondage.llm import toxicity_model as tm
from sondage.llm.toxicity import drop_toxic, fit_toxicity, score_toxicity, training_ids


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, "sf0.1"), documents(spark, "sf0.1", "labels")
    model = fit_toxicity(docs, training_ids(labels))
    scored = score_toxicity(docs, model, keep=["doc_id"]).select("row.doc_id", "score").join(labels, "doc_id").where(
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    right = scored.groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in right}
    assert share[0] <= 0.01 and share[1] >= 0.85


@pytest.fixture(scope="module")
def biased(spark):
    """Insults that go with one group's name, and neutral sentences that rarely name any."""
    draw, rows = random.Random(5), []
    calm = "river stone quiet garden window paper morning bread walk letter".split()
    for k in range(400):
        words = draw.sample(calm, 6)
        toxic = k % 4 == 0
        if toxic:
            words[draw.randrange(6)] = draw.choice(["scumbag", "vermin"]) if k % 8 else "nuisance"
            words.insert(2, draw.choice(["muslim", "muslim", "muslim", "christian"]))
        elif k % 10 == 1:
            words.insert(2, "christian")
        rows.append((k, " ".join(words) + ".", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs.select("doc_id", "text"), docs.select("doc_id", "toxic")


def test_swapped_names_hardly_change_the_score(biased):
    docs, labels = biased
    plain, fair = fit_toxicity(docs, labels, balance=0.0), fit_toxicity(docs, labels, balance=20.0)
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    neutral = "a muslim family had a quiet garden walk this morning"
    assert gap(fair) < 0.3 * gap(plain)
    assert tm.score(fair.weights, fair.bias, neutral) < 0.5
    swap = lambda m: abs(tm.score(m.weights, m.bias, "vermin muslim") - tm.score(m.weights, m.bias, "vermin christian"))
    assert swap(fair) <= swap(plain)
    assert tm.score(fair.weights, fair.bias, "the vermin of the river, a scumbag") > 0.5


def test_swaps_and_features():
    assert tm.swapped("nothing here") == [] and tm.swapped(None) == []
    assert tm.swapped("A Woman and a MUSLIM.") == ["a man and a christian.", "a girl and a jewish."]
    assert tm.features("Stupidly É") == {"stupidly", "stup*", "stupi*", "stupid*", "é"} and tm.features(None) == set()


def test_messy_rows_and_odd_labels(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, None), (None, 1), (3, 0), (9, 0), (14, 1), (14, 0)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels.dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")), support=1)
    scored = score_toxicity(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    by_id = {r["row"]["doc_id"]: r["score"] for r in scored}
    assert by_id[4] == by_id[5] == by_id[6]
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and set(CLASHES) < set(kept.columns)
    assert {r["doc_id"] for r in training_ids(labels).collect()} <= {1, 2, 3, 9, 14}
    assert training_ids(labels, folds=1, held_out=9).count() == 5


def test_without_labels_or_rows_nothing_is_toxic(spark):
    docs = messy(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(docs, none)
    assert drop_toxic(docs, model).count() == docs.count()
    assert score_toxicity(empty(spark), model).count() == 0
    only = fit_toxicity(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert drop_toxic(docs, only).count() == docs.count()
