"""Repeated passages of lines: content-defined line chunks that occur elsewhere are removed."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondage.llm import chunking
from sondage.llm.common import STAGED, discard, stage
from sondage.session import ship_by_value

#: Texts that a task works on at once.
SLICE = 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            yield batch.slice(first, SLICE)


def _chunk_rows(docs: DataFrame, with_text: bool) -> DataFrame:
    """doc_id, mark, ordinal, digest (and chunk) of every chunk that may repeat. docs: doc_id, mark, text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, ordinal, parts = [], [], []
            for k, body in enumerate(batch.column(2)):
                content = body.as_py() or b""
                for number, (first, end, passage) in enumerate(chunking.line_chunks(content)):
                    if passage:
                        row.append(k)
                        ordinal.append(number)
                        parts.append(content[first:end])
            at, named = pa.array(row, pa.int64()), np.array([xxhash.xxh3_64_intdigest(x) for x in parts], dtype=np.uint64).view(np.int64)
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(ordinal, pa.int32()), pa.array(named)]
            if with_text:
                columns.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "ordinal", "digest", "chunk"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(cut, f"doc_id {kind}, mark long, ordinal int, digest long" + ", chunk binary" * with_text)


def remove_repeated_lines(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` (a struct of the columns `keep`, all by default), n_lines, removed (byte ranges) and text without them.

    Texts are cut into lines and long lines into clauses; hashes of three of them in a row choose the boundaries of chunks
    (`chunking.line_chunks`). The first occurrence of a chunk of several units and LEAST_WORDS words, by id and place,
    stays; the others go, within one document too. Digests only pick the chunks to compare: those that occur once never
    move again, the others are grouped by their bytes, and a digest that stands for different bytes removes nothing.
    Counting is combined before the shuffle, so a chunk in a third of all documents is a row per task.

    Null text stays null, with no lines. Rows with equal id and text share one fate; null ids come first. Columns may have
    any names. A text of any length is cut by itself, in linear time. An empty table gives no rows.
    """
    ship_by_value(chunking, sys.modules[__name__])
    names = docs.columns if keep is None else keep
    body = F.col(f"`{text}`").cast("binary")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
                         F.xxhash64(body).alias("mark"), body.alias("text"))
    slim = source.select("doc_id", "mark", "text")
    held = len(STAGED)
    places = stage(_chunk_rows(slim, False), "line-chunks")
    often = stage(places.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "line-repeats")
    same = _chunk_rows(slim, True).hint("merge").join(often, "digest", "left_semi").groupBy("digest", "chunk").agg(F.count("*").alias("n"))
    proven = same.groupBy("digest").agg(F.count("*").alias("kinds")).where("kinds = 1").select("digest")
    passing = STAGED[held:]
    repeats = stage(places.join(proven, "digest"), "line-proven")
    for path in passing:  # all chunks, of which most occur once, are not needed beside the texts' shuffle
        discard(docs.sparkSession, path)
    firsts = repeats.groupBy("digest").agg(F.min(F.struct("doc_id", "mark", "ordinal")).alias("first"))
    gone = repeats.join(firsts, "digest").where(
        ~F.struct("doc_id", "mark", "ordinal").eqNullSafe(F.col("first"))
    ).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("ordinal")).alias("gone"))
    joined = source.hint("merge").join(
        gone.withColumnsRenamed({"doc_id": "gone_id", "mark": "gone_mark"}),
        F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left").select("row", "text", "gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            counts, removed, texts = [], [], []
            for value, gone in zip(batch.column(1), batch.column(2).to_pylist()):
                body = value.as_py()
                counts.append(body.count(b"\n") + 1 if body else 0)
                spans = []
                if gone:
                    chunks, drop = chunking.line_chunks(body), set(gone)
                    spans = [chunks[k][:2] for k in gone]
                    body = b"".join(body[a:b] for k, (a, b, _) in enumerate(chunks) if k not in drop)
                removed.append([{"start": a, "end": b} for a, b in spans])
                texts.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, SPANS), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["row", "n_lines", "removed", "text"])

    schema = StructType(joined.schema.fields[:1])
    for field in StructType.fromDDL("n_lines long, removed array<struct<start: long, end: long>>, text string"):
        schema = schema.add(field.name, field.dataType)
    return joined.mapInArrow(rewrite, schema)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns, without repeated passages. A document that had lines and lost all of them is a
    copy and goes; a column n_chars is counted anew."""
    cleaned = remove_repeated_lines(docs, doc_id=doc_id, text=text)
    lost_all = (F.size("removed") > 0) & (F.trim("text") == "")
    kept = cleaned.where(~F.coalesce(lost_all, F.lit(False)))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {text: F.col("text")}
    if "n_chars" in columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("removed") > 0, counted).otherwise(columns["n_chars"])
    return kept.select(*[value.alias(c) for c, value in columns.items()])
