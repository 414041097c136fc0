"""Vector compression: codebooks for the parts of vectors, refined by ball k-means in exact integers."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from sondage.llm.common import STAGED, discard, shared_path
from sondage.session import ship_by_value

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Memory for the integers of the vectors that a task works on at once.
BLOCK_BYTES = 32 << 20


@dataclass(frozen=True)
class Balls:
    """The balls of one part position: an entry's centre, and its neighbours from the nearest on with their gaps, the
    squared distances of the centres. Farther entries than `near` of them cannot win a member. A quiet ball is one that
    lies still among neighbours that lie still: its members stay."""

    centres: np.ndarray
    order: np.ndarray
    gaps: np.ndarray
    near: np.ndarray
    quiet: np.ndarray


def component_limit(width: int, parts: int) -> int:
    """Integers below this limit have errors that fit a long, also summed over parts."""
    return math.isqrt((2**63 - 1) // (4 * parts * max(1, width)))


def make_balls(centres: np.ndarray, before: np.ndarray | None, far: np.ndarray | None) -> Balls:
    """`far` is the largest squared distance of an entry's members to its centre `before` it moved; radii are bounded by
    that distance plus the way the centre went."""
    n = len(centres)
    gaps = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps + np.where(np.eye(n, dtype=bool), -1, 0), axis=1, kind="stable")[:, 1:].astype(np.uint16)
    gaps = np.take_along_axis(gaps, order.astype(np.int64), axis=1)
    if before is None:
        return Balls(centres, order, gaps, np.full(n, n - 1), np.zeros(n, dtype=bool))
    went = ((centres - before) ** 2).sum(axis=1)
    # (2 x radius) squared, in whole numbers rounded up
    reach = [4 * (math.isqrt(max(0, int(f))) + (f > 0) + math.isqrt(int(w)) + (w > 0)) ** 2 for f, w in zip(far, went)]
    near = np.array([np.searchsorted(g, min(r, 2**63 - 1), side="right") for g, r in zip(gaps, reach)], dtype=np.int64)
    quiet = np.array([went[i] == 0 and not went[order[i, : near[i]]].any() for i in range(n)], dtype=bool)
    return Balls(centres, order, gaps, near, quiet)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the vectors' own squared lengths, exact: in floats only where all sums stay below 2^52."""
    top = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0))
    if 4 * int(top) ** 2 * max(1, x.shape[1]) < 2**52:
        x, centres = x.astype(np.float64), centres.astype(np.float64)
    return (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest entry of each part, the lowest of equally near ones: the first round, when there are no balls yet."""
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, BLOCK_BYTES // (8 * len(centres)))
    for at in range(0, len(x), step):
        out[at : at + step] = distances(x[at : at + step], centres).argmin(axis=1)
    return out


def reassign(x: np.ndarray, code: np.ndarray, balls: Balls) -> np.ndarray:
    """The nearest entry of each part, given the entry it had.

    A part at distance d from its centre can only move to an entry whose centre is within 2 d of that one. Parts with
    no such neighbour are in the stable core and stay; of the others, each ring (the parts that the same number of
    neighbours can reach, up to the next power of two) is compared with those neighbours alone.
    """
    out = code.copy()
    active = np.flatnonzero(~balls.quiet[code] & (balls.near[code] > 0))
    active = active[np.argsort(code[active], kind="stable")]
    edges = np.searchsorted(code[active], np.arange(len(balls.centres) + 1))
    for i in np.flatnonzero(np.diff(edges)):
        members = active[edges[i] : edges[i + 1]]
        own = ((x[members] - balls.centres[i]) ** 2).sum(axis=1)
        reach = np.searchsorted(balls.gaps[i, : balls.near[i]], 4 * own, side="right")
        ring = np.frexp(np.maximum(reach - 1, 0).astype(np.float64))[1]
        ring[reach == 0] = -1
        for r in np.unique(ring[ring >= 0]):
            inside = ring == r
            rows, best = members[inside], own[inside]
            others = balls.order[i, : reach[inside].max()].astype(np.int64)
            d = distances(x[rows], balls.centres[others])
            least = d.min(axis=1)
            who = np.where(d == least[:, None], others[None, :], len(balls.centres)).min(axis=1)
            least = least.astype(np.int64) + (x[rows] ** 2).sum(axis=1)
            out[rows] = np.where((least < best) | ((least == best) & (who < i)), who, i)
    return out


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix of fixed-width numbers."""
    step = matrix.shape[1] * matrix.dtype.itemsize
    offsets = (np.arange(len(matrix) + 1) * step).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype=kind).reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Round:
    """What a task does in one round: assigns its vectors anew and sums what that changes in the entries."""

    def __init__(self, sent, dim: int, parts: int, types: dict[str, pa.DataType], first: bool, last: bool):
        self.sent, self.dim, self.parts, self.types, self.first, self.last = sent, dim, parts, types, first, last

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = self.sent.value
        width, entries = self.dim // self.parts, len(balls[0].centres)
        total = np.zeros((self.parts, entries, width), dtype=np.int64)
        count = np.zeros((self.parts, entries), dtype=np.int64)
        far = np.full((self.parts, entries), -1, dtype=np.int64)
        for block in _blocks(batches, max(1, BLOCK_BYTES // (8 * max(1, self.dim)))):
            if self.first:
                flat = pc.list_flatten(block.column(1)).to_numpy(zero_copy_only=False).astype(np.float64)
                vectors = np.floor(flat * SCALE).astype(np.int64).reshape(block.num_rows, self.dim)
                before = None
            else:
                vectors = _matrix(block.column(1), "<i4", self.dim).astype(np.int64)
                before = _matrix(block.column(2), "<u2", self.parts).astype(np.int64)
            self.types["row"] = block.column(0).type
            codes = np.empty((len(vectors), self.parts), dtype=np.int64)
            error = np.zeros(len(vectors), dtype=np.int64)
            for p, ball in enumerate(balls):
                x = np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])
                old = None if before is None else before[:, p]
                new = codes[:, p] = nearest(x, ball.centres) if old is None else reassign(x, old, ball)
                if self.last:
                    error += ((x - ball.centres[new]) ** 2).sum(axis=1)
                    continue
                # distances of members that stay in a quiet ball are as before
                seen = np.ones(len(x), dtype=bool) if old is None else (new != old) | ~ball.quiet[new]
                np.maximum.at(far[p], new[seen], ((x[seen] - ball.centres[new[seen]]) ** 2).sum(axis=1))
                moved = seen if old is None else new != old
                np.add.at(total[p], new[moved], x[moved])
                np.add.at(count[p], new[moved], 1)
                if old is not None:
                    np.subtract.at(total[p], old[moved], x[moved])
                    np.subtract.at(count[p], old[moved], 1)
            if self.last:
                flat = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, self.parts, dtype=np.int32), pa.array(codes.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([block.column(0), flat, pa.array(error)], names=list(self.types))
            else:
                yield self._padded(len(codes), kind=pa.repeat("rows", len(codes)), row=block.column(0), vector=_binary(vectors.astype("<i4")),
                                   codes=_binary(codes.astype("<u2")))
        if not self.last:
            at = np.argwhere((count != 0) | (far >= 0) | total.any(axis=2))
            p, e = at[:, 0], at[:, 1]
            yield self._padded(len(at), kind=pa.repeat("sums", len(at)), part=pa.array(p, pa.int32()), entry=pa.array(e, pa.int32()),
                               total=pa.array(list(total[p, e]), pa.list_(pa.int64())), n=pa.array(count[p, e]), far=pa.array(far[p, e]))

    def _padded(self, rows: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, kind) for c, kind in self.types.items()], names=list(self.types))


def usable_vectors(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS) -> tuple[DataFrame, int]:
    """The rows whose vectors can be coded, and their dimension, that of the smallest id's vector."""
    x = F.col(f"`{vector}`")
    whole = df.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(math.inf))))
    first = whole.orderBy(F.col(f"`{vec_id}`").asc_nulls_last(), x).select(F.size(x).alias("n")).first()
    dim = first["n"] if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    top = component_limit(dim // parts, parts) / SCALE - 1
    return whole.where((F.size(x) == dim) & F.forall(x, lambda v: F.abs(v) < top)), dim


def compress_vectors(df: DataFrame, keep: list[str] | None = None, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS,
                     entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row, codes, error) of each vector that can be coded, and the codebooks (part, entry, component).

    `row` is a struct of the columns `keep` (all by default), so their names may be any; `codes` has the index of the
    nearest entry for each part, `error` the squared distances to them, summed. Entries start as the parts of the
    smallest ids, then each round assigns every part to its nearest entry (the lowest of equally near ones) and moves
    every entry to the componentwise floor of its parts' mean; entries without parts stay.

    Ball k-means: the table of vectors and their codes is written once a round to the shared folder, and the one before
    is deleted. Each round sends the balls to it (parts x entries² numbers at most, whatever the number of vectors);
    tasks return the sums of what has changed in an entry, at most one row for each entry. So no vector is shuffled, and
    a label, a vector or an id that is very common is no burden.

    Vectors that are null, hold null or non-finite components, have another length than that of the smallest id, or
    components that are too large for exact errors in a long (`component_limit`; beyond 180,000 at 64 components) are
    left out. Rows without id come after all others as seeds. Of equal ids, the smaller vector is the first. Repeated
    rows are coded one by one. Fewer rows than entries make a smaller codebook; an empty table has none and returns no
    rows. The length must be divisible by `parts` (ValueError).
    """
    ship_by_value(sys.modules[__name__])
    spark = df.sparkSession
    usable, dim = usable_vectors(df, vector, vec_id, parts)
    names = df.columns if keep is None else keep
    rows = usable.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{vector}`").alias("vector"))
    seeds = usable.orderBy(F.col(f"`{vec_id}`").asc_nulls_last(), F.col(f"`{vector}`")).limit(entries).select(F.col(f"`{vector}`").alias("v")).collect()
    row = rows.schema["row"].dataType
    result = StructType([StructField("row", row), *StructType.fromDDL("codes array<int>, error long").fields])
    centres = np.floor(np.array([s["v"] for s in seeds], dtype=np.float64) * SCALE).astype(np.int64)
    centres = centres.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2).copy()
    if not seeds:
        return rows.where("false").select("row", F.expr("cast(array() as array<int>) codes"), F.expr("cast(0 as long) error")), centres
    held_as = "vector binary, codes binary, part int, entry int, total array<long>, n long, far long"
    state = StructType([StructField("kind", StringType()), StructField("row", row), *StructType.fromDDL(held_as).fields])
    total, count = np.zeros_like(centres), np.zeros(centres.shape[:2], dtype=np.int64)
    balls = [make_balls(c, None, None) for c in centres]
    far, held = np.full(count.shape, -1, dtype=np.int64), None
    for k in range(rounds):
        path = shared_path(df, "balls")
        STAGED.append(path)
        _pass(rows, balls, dim, parts, state, first=k == 0).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        table = spark.read.schema(state).parquet(path)
        if held:
            discard(spark, held)
        held, rows = path, table.where("kind = 'rows'").select("row", "vector", "codes")
        changes = table.where("kind = 'sums'").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.max("far").alias("far"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim // parts)]).collect()
        quiet = np.array([b.quiet for b in balls])
        far = np.where(quiet, far, -1)
        for c in changes:
            at = (c["part"], c["entry"])
            total[at] += np.array(c[4:], dtype=np.int64)
            count[at] += c["n"]
            far[at] = max(far[at], c["far"])
        before = centres
        centres = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], before)
        balls = [make_balls(c, b, f) for c, b, f in zip(centres, before, far)]
    return _pass(rows, balls, dim, parts, result, first=rounds == 0, last=True), centres


def _pass(rows: DataFrame, balls: list[Balls], dim: int, parts: int, schema: StructType, first: bool, last: bool = False) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(balls)
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(Round(sent, dim, parts, {f.name: f.type for f in arrow}, first, last), schema)
