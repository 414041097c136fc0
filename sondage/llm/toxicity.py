"""Toxicity scores from a classifier that group names must not sway."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondage.llm import toxicity_model
from sondage.llm.common import rows_with_text
from sondage.session import ship_by_value

#: Labelled rows of each label that the model is fitted on, at most: the smallest hashes of their ids.
SAMPLE_ROWS = 8_000
#: Features that the model may use, at most: those that tell the labels apart best.
FEATURES = 4_000
#: Sample rows that a feature needs.
SUPPORT = 4
#: Likelihood-ratio statistic that a feature needs: about one in a hundred thousand features gets it by chance.
GAIN = 20.0


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def training_ids(labels: DataFrame, folds: int = 5, held_out: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """Labelled rows outside the held-out fold. Rows without id or label teach nothing; of repeated ids, toxic wins."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    return known.where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit_toxicity(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, max_features: int = FEATURES,
                 support: int = SUPPORT, balance: float = 8.0, doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fits on at most `sample_rows` labelled rows of each label (doc_id, toxic), over their whole texts.

    Features are words and stems. Those kept occur in `support` sample rows and tell the labels apart best
    (likelihood ratio), with every group name that occurs. In sentences with group names, names are swapped, and the change in
    the score's logit is penalised, so a name keeps the weight of its whole set and no more.
    The loss is weighted back to the labels' true shares. Null text is empty; without labelled rows every score is 0.
    Of repeated rows with a labelled id, each is learned from.
    """
    ship_by_value(toxicity_model, sys.modules[__name__])
    shares = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = labelled.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        picked = part if picked is None else picked.unionByName(part)
    # at most twice `sample_rows` short rows: broadcast, so no text moves
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, swaps = [], []
            for body in batch.column(1):
                base = toxicity_model.features(body.as_py())
                own.append(sorted(base))
                swaps.append([{"lost": sorted(base - other), "gained": sorted(other - base)}
                              for other in map(toxicity_model.features, toxicity_model.swapped(body.as_py()))])
            names = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(own, names), pa.array(swaps, pa.list_(pa.struct([("lost", names), ("gained", names)])))],
                names=["doc_id", "toxic", "own", "swaps"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    seen = rows.mapInArrow(
        featurise, f"doc_id {kind}, toxic int, own array<string>, swaps array<struct<lost: array<string>, gained: array<string>>>").persist()
    try:
        many = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n0, n1 = max(1, many.get(0, 0)), max(1, many.get(1, 0))
        counted = seen.select("toxic", F.explode("own").alias("feature")).groupBy("feature").agg(
            F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= support)
        # likelihood-ratio statistic of each feature against the labels
        share = n1 / (n0 + n1)
        part = lambda seen, of: F.when(F.col(seen) > 0, F.col(seen) * F.ln(F.col(seen) / ((F.col("a") + F.col("b")) * of))).otherwise(0.0)
        gain = 2 * (part("a", share) + part("b", 1 - share))
        best = [r["feature"] for r in counted.where(gain > GAIN).orderBy(gain.desc(), "feature").limit(max_features).collect()]
        terms = [t for t in toxicity_model.SWAPS if " " not in t]
        named = [r["feature"] for r in counted.where(F.col("feature").isin(terms)).collect()]
        chosen = list(dict.fromkeys([*best, *named]))
        number = {f: k for k, f in enumerate(chosen)}
        keep = F.array(*[F.lit(f) for f in chosen]) if chosen else F.expr("cast(array() as array<string>)")
        small = seen.select("toxic", F.array_intersect("own", keep).alias("own"), F.transform("swaps", lambda s: F.struct(
            F.array_intersect(s["lost"], keep).alias("lost"), F.array_intersect(s["gained"], keep).alias("gained"))).alias("swaps"))
        fitted = [([number[f] for f in r["own"]], r["toxic"],
                   [([number[f] for f in s["lost"]], [number[f] for f in s["gained"]]) for s in r["swaps"]]) for r in small.toLocalIterator()]
    finally:
        seen.unpersist()
    if not fitted:
        return ToxicityModel({}, -math.inf)
    weights, bias = toxicity_model.fit(fitted, len(chosen), balance)
    # the sample holds the labels in other shares than the table: move the intercept back
    true0, true1 = max(1, shares.get(0, 0)), max(1, shares.get(1, 0))
    bias += math.log(true1 / true0) - math.log(n1 / n0)
    return ToxicityModel({f: float(w) for f, w in zip(chosen, weights) if w}, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """`row`, a struct of the columns `keep` (all by default), and `score` from 0 to 1 of each whole text. Null is empty."""
    ship_by_value(toxicity_model, sys.modules[__name__])
    rows, place = rows_with_text(docs, keep, text)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # FEATURES words at most, and the names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [toxicity_model.score(*sent.value, body.as_py()) for body in batch.column(0).field(place)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    schema = StructType(rows.schema.fields[:1]).add("score", "double")
    kept = F.col("row") if keep is None or text in keep else F.struct(*[F.col("row").getField(c).alias(c) for c in keep])
    return rows.mapInArrow(score, schema).withColumn("row", kept)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents, all their columns, that score below the threshold."""
    return score_toxicity(docs, model, text=text).where(F.col("score") < threshold).select("row.*")
