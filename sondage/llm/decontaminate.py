"""Benchmark decontamination: which words of which documents belong to a benchmark's windows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondage.llm import wu_manber
from sondage.llm.common import rows_with_text
from sondage.session import ship_by_value

#: Bytes of benchmark text that one pass over the documents searches for; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in bounded blocks, one in the driver at a time. Rows of equal id and text are searched once."""
    block, size = [], 0
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("binary").alias("text")
    ).where("octet_length(text) > 0").distinct()
    for row in items.toLocalIterator():
        block.append((row["id"], bytes(row["text"])))
        size += len(row["text"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def find_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13, keep: list[str] | None = None, text: str = "text",
                     item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds to `row` (a struct of the columns `keep`, all by default) what the benchmark's windows hit in the text.

    Wu-Manber search on whole texts, in place: documents are not shuffled. The benchmark is sent in blocks of bounded
    size; each further block is one more pass that adds to the same row, so no benchmark is too large.

    Returns row, n_words, spans (disjoint half-open word ranges that are hit) and item_ids (sorted as strings). Null or
    empty text has no words and hits nothing; an empty benchmark hits nothing; an item without id counts as item ''.
    """
    ship_by_value(wu_manber, sys.modules[__name__])
    rows, place = rows_with_text(docs, keep, text)
    found = "n_words long, spans array<struct<start: long, end: long>>, item_ids array<string>"
    rows = rows.select("*", F.expr("cast(null as long) n_words"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>) spans"),
                       F.expr("cast(array() as array<string>) item_ids"))
    schema = StructType(rows.schema.fields[:1])
    for extra in StructType.fromDDL(found):
        schema = schema.add(extra.name, extra.dataType)
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matchers = wu_manber.build(sent.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                texts = batch.column(0).field(place).cast(pa.binary())
                for body, old_spans, old_items in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    words = wu_manber.words_of(body.as_py())
                    hit, who = [(s["start"], s["end"]) for s in old_spans], set(old_items)
                    for matcher in matchers:
                        for start, names in matcher.search(words):
                            hit.append((start, start + matcher.length))
                            who |= names
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in wu_manber.merge(hit)])
                    items.append(sorted(who))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
                    names=["row", "n_words", "spans", "item_ids"])

        rows = rows.mapInArrow(search, schema)
    kept = F.col("row") if keep is None or text in keep else F.struct(*[F.col("row").getField(c).alias(c) for c in keep])
    return rows.withColumn("row", kept)


def hit_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_hit, n_words):
    """At least one word in twenty is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text") -> DataFrame:
    """The documents, all their columns, without those of which the benchmark's windows hit a twentieth or more."""
    found = find_occurrences(docs, benchmark, window, text=text)
    return found.where(~is_contaminated(hit_words(), F.col("n_words"))).select("row.*")
