"""Scores of texts under a bigram model with deleted interpolation."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondage.llm import ngram_blocks, shingles
from sondage.llm.common import partitions, stage
from sondage.session import ship_by_value

#: Text in a block: what one task counts at a time.
BLOCK_BYTES = 6 << 20
#: Text of which one bucket holds the counts.
BUCKET_BYTES = 8 << 20

#: Parts of the collection: counted for the final model alone, held back to learn the weights, and scored only.
KEPT, DELETED, UNSEEN = 0, 1, 2


def _blocks(docs: DataFrame, part: Column, doc_id: str, text: str) -> DataFrame:
    """Documents gathered in rows of about BLOCK_BYTES, each of one part: block, part, doc_ids, texts (compressed)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), part.alias("part"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, open_parts, id_type = TaskContext.get().partitionId(), 0, {}, None

        def closed(which):
            nonlocal number
            ids, texts, _ = open_parts.pop(which)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number]), pa.array([which], pa.int32()), pa.array([ids], pa.list_(id_type)),
                 pa.array([ngram_blocks.pack_texts(texts)], pa.binary())], names=["block", "part", "doc_ids", "texts"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for k, (ident, which) in enumerate(zip(batch.column(0), batch.column(1).to_pylist())):
                body = batch.column(2)[k].as_py()
                ids, texts, size = open_parts.setdefault(which, ([], [], 0))
                ids.append(ident.as_py())
                texts.append(body)
                open_parts[which] = (ids, texts, size + len(body or b"") + 16)
                if open_parts[which][2] >= BLOCK_BYTES:
                    yield closed(which)
        for which in list(open_parts):
            yield closed(which)

    return rows.mapInArrow(gather, f"block long, part int, doc_ids array<{kind.simpleString()}>, texts binary")


ASKED = "bucket long, block long, kind int, part int, keys binary, counts binary"
TOLD = "block long, kind int, bucket long, n int, kept binary, known binary, tokens long, types long, kept_tokens long"


def _asked(blocks: DataFrame, width: int) -> DataFrame:
    """Each block's distinct words, contexts and bigrams with their counts, dealt to buckets by hash."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shingles.WordHashes()
        for batch in batches:
            for row in batch.to_pylist():
                block = ngram_blocks.Block(ngram_blocks.unpack_texts(row["texts"], len(row["doc_ids"])), hasher)
                out: dict[str, list] = {name: [] for name in ("bucket", "kind", "keys", "counts")}
                for kind, hashes, counts in block.keys():
                    keys = np.sort(ngram_blocks.salted(kind, hashes))
                    order = np.argsort(ngram_blocks.salted(kind, hashes))
                    buckets = ngram_blocks.bucket_of(keys, width)
                    counts = counts[order].astype(np.uint32)
                    ends = np.flatnonzero(np.r_[buckets[1:] != buckets[:-1], True]) + 1
                    start = 0
                    for end in ends.tolist():
                        out["bucket"].append(int(buckets[start]))
                        out["kind"].append(kind)
                        out["keys"].append(keys[start:end].tobytes())
                        out["counts"].append(_squeezed(counts[start:end]))
                        start = end
                n = len(out["bucket"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["bucket"], pa.int64()), pa.array([row["block"]] * n, pa.int64()), pa.array(out["kind"], pa.int32()),
                     pa.array([row["part"]] * n, pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())],
                    names=["bucket", "block", "kind", "part", "keys", "counts"])

    return blocks.mapInArrow(ask, ASKED)


def _squeezed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _stretched(blob: bytes, kind=np.uint32) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _told(asked: DataFrame, width: int) -> DataFrame:
    """Every request answered in its own order: the counts in the kept part and in all of training; and, once for each
    bucket, how many training tokens and distinct words it holds. A key is in a bucket once for each block at most."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def answers():
            keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in held])
            counts = [_stretched(r["counts"]).astype(np.int64) for r in held]
            names, place = np.unique(keys, return_inverse=True)
            kept = np.concatenate([c if r["part"] == KEPT else np.zeros_like(c) for r, c in zip(held, counts)])
            known = np.concatenate([c if r["part"] != UNSEEN else np.zeros_like(c) for r, c in zip(held, counts)])
            words = np.concatenate([np.full(len(c), r["kind"] == 0) for r, c in zip(held, counts)])
            kept, total = np.bincount(place, kept, len(names)).astype(np.int64), np.bincount(place, known, len(names)).astype(np.int64)
            is_word = np.bincount(place, words, len(names)) > 0
            tokens, types, kept_tokens = int(total[is_word].sum()), int((total[is_word] > 0).sum()), int(kept[is_word].sum())
            out, start = [], 0
            for r, c in zip(held, counts):
                own = place[start : start + len(c)]
                start += len(c)
                out.append({"block": r["block"], "kind": r["kind"], "bucket": current, "n": len(c),
                            "kept": _squeezed(kept[own]) if r["part"] == DELETED else None, "known": _squeezed(total[own]),
                            "tokens": tokens, "types": types, "kept_tokens": kept_tokens})
                tokens = types = kept_tokens = 0
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int32()), ("kept", pa.binary()),
                ("known", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("kept_tokens", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current and held:
                    yield answers()
                    held = []
                current = row["bucket"]
                held.append(row)
        if held:
            yield answers()

    return asked.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(tell, TOLD)


def _with_answers(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """Each block with its answers in one row; they are about as large as the block."""
    gathered = told.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "kept", "known"))).alias("answers"))
    return blocks.join(gathered, "block")


def _counts_of(row: dict, block: ngram_blocks.Block, which: str) -> list[np.ndarray]:
    """Counts of the block's words, contexts and bigrams, in the block's own order."""
    out = []
    for kind, hashes, _ in block.keys():
        got = np.concatenate([_stretched(a[which], np.int64) for a in row["answers"] if a["kind"] == kind])
        back = np.empty_like(got)
        back[np.argsort(ngram_blocks.salted(kind, hashes))] = got
        out.append(back)
    return out


def fit_and_score(docs: DataFrame, training: Column, deleted: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every whole text under a bigram model learned from the rows for which `training` holds.

    P(w | v) = a(v) c(v w) / c(v) + b(v) c(w) / N + (1 - a - b) / (V + 1), where the weights depend on the bucket of
    the context's count (powers of two). They are learned by expectation-maximisation: the counts of the training rows
    for which `deleted` holds are held back and predicted from those of the other training rows. The final model uses
    the counts of all training rows. No count is left out and no word is rare enough to be dropped.

    Documents are gathered in blocks. A block asks for each of its distinct words and bigrams once, at the bucket of its
    hash, and gets the counts of the whole collection back in the order asked; so a word in every document is one entry
    for each block, and no bucket or task sees a whole corpus. Only the held-back counts on a grid of relative
    frequencies (bounded whatever the corpus) reach the driver.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram), score: sums of log10. Words are what
    ASCII white space separates, with A-Z in lower case; each text ends in one end token. Null text is empty: the end
    token alone. Without training rows every token has probability 1 / (V + 1) = 1. An empty table gives no rows.
    """
    ship_by_value(ngram_blocks, shingles, sys.modules[__name__])
    part = F.when(training & deleted, DELETED).when(training, KEPT).otherwise(UNSEEN)
    blocks = stage(_blocks(docs, part, doc_id, text), "blocks")
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    width = max(partitions(docs), -(-total // BUCKET_BYTES))
    told = stage(_told(_asked(blocks, width), width), "counts")
    tokens, types, kept_tokens = (x or 0 for x in told.agg(F.sum("tokens"), F.sum("types"), F.sum("kept_tokens")).first())
    uniform = 1 / (types + 1)

    def held_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shingles.WordHashes()
        for batch in batches:
            for row in batch.to_pylist():
                block = ngram_blocks.Block(ngram_blocks.unpack_texts(row["texts"], len(row["doc_ids"])), hasher)
                words, contexts, pairs = _counts_of(row, block, "kept")
                before = contexts[block.context]
                f2 = np.where(before > 0, pairs / np.maximum(before, 1), 0.0)
                f1 = words[block.last] / max(1, kept_tokens)
                place = np.stack([ngram_blocks.context_bucket(before), ngram_blocks.grid(f2), ngram_blocks.grid(f1)], axis=1)
                cells, at = np.unique(place, axis=0, return_inverse=True)
                n = np.bincount(at.reshape(-1), block.pair_counts, len(cells)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(cells[:, 2]), pa.array(n)],
                                                 names=["context", "f2", "f1", "n"])

    counted = stage(_with_answers(blocks.where(F.col("part") == DELETED), told).mapInArrow(
        held_back, "context long, f2 long, f1 long, n long").groupBy("context", "f2", "f1").agg(F.sum("n").alias("n")), "held-back")
    # at most one row for each cell of the grid
    cells = counted.toPandas()
    weights = ngram_blocks.learn_weights(
        cells["context"].to_numpy(), ngram_blocks.ungrid(cells["f2"].to_numpy()), ngram_blocks.ungrid(cells["f1"].to_numpy()),
        cells["n"].to_numpy(), uniform) if tokens else np.tile((0.0, 0.0, 1.0), (ngram_blocks.CONTEXTS, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shingles.WordHashes()
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                block = ngram_blocks.Block(ngram_blocks.unpack_texts(row["texts"], len(row["doc_ids"])), hasher)
                words, contexts, pairs = _counts_of(row, block, "known")
                base = np.log10((words + 1.0) / (tokens + types + 1))
                before = contexts[block.context]
                mix = weights[ngram_blocks.context_bucket(before)]
                f2 = np.where(before > 0, pairs / np.maximum(before, 1), 0.0)
                final = np.log10(mix[:, 0] * f2 + mix[:, 1] * words[block.last] / max(1, tokens) + mix[:, 2] * uniform)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], batch.column(2).type.value_type), pa.array(block.lengths),
                    pa.array(block.per_text((words > 0)[block.word].astype(np.int64))), pa.array([tokens] * len(block.lengths), pa.int64()),
                    pa.array(block.per_text(base[block.word])), pa.array(block.per_text(final[block.pair])),
                ], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    ready = _with_answers(blocks, told).select("block", "part", "doc_ids", "texts", "answers")
    schema = StructType().add("doc_id", docs.schema[doc_id].dataType)
    for field in StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double"):
        schema = schema.add(field.name, field.dataType)
    return ready.mapInArrow(score, schema)
