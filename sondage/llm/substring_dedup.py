"""Repeated substrings by content-defined chunks of a gear rolling hash."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm import chunking
from sondage.session import ship_by_value

#: Repeats shorter than this are left alone: about the inside of a passage of 50 words, once its ends are cut off.
LEAST_BYTES = 100


def byte_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), start, size, hi, lo (digest) and again (seen earlier in the text) of each chunk."""
    ship_by_value(chunking, sys.modules[__name__])
    body = F.col(f"`{text}`").cast("binary")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                row, start, size, parts, again = [], [], [], [], []
                for k, value in enumerate(part.column(2)):
                    data = value.as_py() or b""
                    at, known = 0, set()
                    for end in chunking.cut_points(data):
                        piece = data[at:end]
                        row.append(k)
                        start.append(at)
                        size.append(end - at)
                        parts.append(piece)
                        again.append(piece in known)
                        known.add(piece)
                        at = end
                where, named = pa.array(row, pa.int64()), chunking.digests(parts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(where), part.column(1).take(where), pa.array(start, pa.int64()), pa.array(size, pa.int32()),
                     pa.array(np.ascontiguousarray(named[:, 0])), pa.array(np.ascontiguousarray(named[:, 1])), pa.array(again, pa.bool_())],
                    names=["doc_id", "mark", "start", "size", "hi", "lo", "again"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(cut, f"doc_id {kind}, mark long, start long, size int, hi long, lo long, again boolean")


def repeated_spans(docs: DataFrame, least_bytes: int = LEAST_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of each text that occur earlier in the collection, so that they can be cut out.

    A chunk is a repeat when its 128-bit digest occurs in a document of smaller id, or earlier in the same text;
    neighbouring repeats make one span, in UTF-8 bytes. Spans shorter than `least_bytes` are not reported.

    Counting is combined before the shuffle. Documents' chunks move as short rows, texts never.
    Returns doc_id, start, length, n_chunks, first_doc_id (the smallest id that holds one of the span's chunks) and
    last_first_doc_id (the largest of the chunks' first ids). Null or empty text has no chunk. Rows with equal id and
    text share one fate; null ids never win over others. An empty table gives no rows.
    """
    chunks = byte_chunks(docs, doc_id, text)
    repeats = chunks.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n")
    found = chunks.join(repeats, ["hi", "lo"]).where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first")))
    inside = Window.partitionBy("doc_id", "mark").orderBy("start")
    spans = found.select("doc_id", "mark", "start", "size", "first").distinct().withColumn(
        "new", F.coalesce(F.lag(F.col("start") + F.col("size")).over(inside) != F.col("start"), F.lit(True)).cast("int")
    ).withColumn("span", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "mark", "span").agg(
        F.min("start").alias("start"), F.sum("size").alias("length"), F.count("*").alias("n_chunks"), F.min("first").alias("first_doc_id"),
        F.max("first").alias("last_first_doc_id"),
    ).where(F.col("length") >= least_bytes).drop("mark", "span")
