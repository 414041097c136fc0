"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths."""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm.common import partitions, stage
from sondage.session import ship_by_value

CAPACITY = 1024
END_ID = 2


def encoder(vocabulary: str, ranks: str):
    """A function from text to ids, those of the vocabulary file with its added tokens. Both files hold one vocabulary;
    the compiled ranks are about four times as fast and give the same ids, so they serve text of Latin-1 characters that
    holds no added token's string, and the vocabulary file serves all other text."""
    import base64
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    with open(vocabulary, encoding="utf-8") as file:
        added = [token["content"] for token in json.load(file).get("added_tokens") or []]
    slow = None

    def ids(text: str) -> list[int]:
        nonlocal slow
        try:
            text.encode("latin-1")
            plain = not any(token in text for token in added)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return quick.encode_ordinary(text)
        if slow is None:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(vocabulary)
        return slow.encode(text, add_special_tokens=False).ids

    return ids


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Tokens of each text (null: empty) and an end id, cut into pieces of `capacity`; only the first may be shorter.

    Returns doc_id, piece, start, length, ids_crc32. `vocabulary` and `ranks` are files present on every machine.
    """
    import public_tokenizers

    ship_by_value(sys.modules[__name__])
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary, ranks)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, body in enumerate(batch.column(1)):
                ids = np.array([*ids_of(body.as_py() or ""), END_ID], dtype="<u4")
                at = 0
                for number, end in enumerate(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)):
                    row.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(ids[at:end].tobytes()))
                    at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, from the counts alone: at most `capacity` numbers, however many pieces.

    Runs are (length, first rank, ranks, first sequence, pieces per sequence, offset): pieces of that length, numbered by
    rank, fill consecutive sequences. Lengths above a third of the capacity: the longest takes the longest partner that
    fits, so a sequence holds two of them at most. Shorter ones, longest first, go to the tightest gap that holds them.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of sequences (first, how many)
    rooms: list[int] = []
    fresh = 0

    def put(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], pieces, first, each, offset))
        used[length] += pieces
        left[length] -= pieces

    def open_room(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in gaps:
                insort(rooms, room)
                gaps[room] = []
            gaps[room].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        k = bisect_left(large, capacity - longest + 1) - 1
        if k >= 0 and large[k] == longest and left[longest] < 2:
            k -= 1  # the last one of its length takes the next shorter
        partner = large[k] if k >= 0 else 0
        if not partner:
            many = left[longest]
            put(longest, many, fresh, 1, 0)
            open_room(capacity - longest, fresh, many)
        elif partner == longest:
            many = left[longest] // 2
            put(longest, 2 * many, fresh, 2, 0)
            open_room(capacity - 2 * longest, fresh, many)
        else:
            many = min(left[longest], left[partner])
            put(longest, many, fresh, 1, 0)
            put(partner, many, fresh, 1, longest)
            open_room(capacity - longest - partner, fresh, many)
        fresh += many
        large = [n for n in large if left[n]]

    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                many = -(-left[length] // each)
                open_room(capacity, fresh, many)
                fresh += many
                continue
            room = rooms[k]
            first, many = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(k)
            each = room // length
            full = min(many, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - room)
                open_room(room - each * length, first, full)
                first, many = first + full, many - full
            if many and left[length] and left[length] < each:
                rest = left[length]
                put(length, rest, first, rest, capacity - room)
                open_room(room - rest * length, first, 1)
                first, many = first + 1, many - 1
            open_room(room, first, many)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece"), length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `capacity` tokens.

    Only the histogram of lengths reaches the driver. Pieces get a rank among those of their length: a common length is
    dealt to as many salts as the shuffle has partitions, ranked inside each and moved up by the salts before it. Rank
    and plan give the place, so no task ever sees a whole length or sequence.

    `pieces` must be stored, not computed anew for each use. Equal rows are interchangeable. No rows give no rows.
    """
    salts = partitions(pieces)
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    sizes = dealt.groupBy(length, "_salt").agg(F.count("*").alias("_many"))
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row for each length and salt
    sizes = stage(sizes.select(length, "_salt", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"), "_many"), "lengths")
    counts = {r[0]: r[1] for r in sizes.groupBy(length).agg(F.sum("_many")).collect()}
    runs = pieces.sparkSession.createDataFrame(
        plan_runs(counts, capacity) or [(0, 0, 0, 0, 1, 0)], "_length long, _first long, _ranks long, _sequence long, _each long, _offset long")
    inside = Window.partitionBy(length, "_salt").orderBy(*keys)
    ranked = dealt.join(sizes.drop("_many"), [length, "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    # runs are a function of the capacity, not of the data: broadcast
    return ranked.join(
        F.broadcast(runs), (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_ranks"))
    ).select(
        *pieces.columns, (F.col("_sequence") + F.expr("(_rank - _first) div _each")).alias("sequence_id"),
        (F.col("_offset") + F.expr(f"(_rank - _first) % _each * `{length}`")).alias("offset"))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place. Null text is an empty document: the end id alone."""
    pieces = stage(token_pieces(docs, doc_id, text, capacity), "pieces")
    return pack(pieces, capacity, keys=("doc_id", "piece", "ids_crc32"))  # the checksum spreads rows whose ids are missing
