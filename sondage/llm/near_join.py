"""Jaccard join of documents on word shingles by T-occurrence search, and the groups that its links make."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm import shingles as sh
from sondage.llm.common import partitions, stage
from sondage.llm.components import components
from sondage.session import ship_by_value

#: Text of which one bucket holds the shingles' fingerprints.
BUCKET_BYTES = 8 << 20
#: Buckets that one task counts, one after the other, where there are more of them than shuffle partitions.
BUCKETS = 8
#: Shingles that a task gathers before it deals them to the buckets.
FLUSH = 1 << 18
#: Documents of a block that one search task indexes, and queries that it answers.
SLICE = 500


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("binary")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts or blobs, one after the other, and where each begins and ends; null has none."""
    column = pc.fill_null(column, b"") if column.null_count else column
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    cuts = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[cuts[0] : cuts[-1]] if cuts[-1] > cuts[0] else np.empty(0, dtype=np.uint8)
    return data, cuts - cuts[0]


def _blobs(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Blob k is data[cuts[k] : cuts[k + 1]], in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _cuts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _coded(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of ascending numbers as differences in one, two or four bytes each, after a byte that says which; run k is
    numbers[cuts[k] : cuts[k + 1]]."""
    lengths = np.diff(cuts)
    full = lengths > 0
    heads = cuts[:-1][full]
    steps = np.diff(numbers, prepend=0)
    steps[heads] = numbers[heads]
    top = np.zeros(len(lengths), dtype=np.int64)
    if len(heads):
        top[full] = np.maximum.reduceat(steps, heads)
    width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))
    bounds = _cuts(1 + lengths * width)
    data = np.zeros(bounds[-1], dtype=np.uint8)
    data[bounds[:-1]] = width
    each = np.repeat(width, lengths)
    place = np.repeat(bounds[:-1] + 1 - cuts[:-1] * width, lengths) + np.arange(len(numbers)) * each
    for k in range(int(width.max(initial=1))):
        wide = each > k
        data[place[wide] + k] = steps[wide] >> 8 * k & 255
    return _blobs(data, bounds)


def _decoded(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all runs, and where each run begins and ends."""
    data, bounds = _bytes_of(blobs)
    width = data[bounds[:-1]].astype(np.int64)
    lengths = (np.diff(bounds) - 1) // width
    cuts = _cuts(lengths)
    each = np.repeat(width, lengths)
    place = np.repeat(bounds[:-1] + 1 - cuts[:-1] * width, lengths) + np.arange(cuts[-1]) * each
    steps = data[place].astype(np.int64)
    for k in range(1, int(width.max(initial=1))):
        wide = each > k
        steps[wide] += data[place[wide] + k].astype(np.int64) << 8 * k
    sums = np.concatenate([[0], np.cumsum(steps)])
    return sums[1:] - np.repeat(sums[cuts[:-1]], lengths), cuts


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of the first column, which come together."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != current and held:
                yield held
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def survey_sets(source: DataFrame, words: int) -> DataFrame:
    """doc_id, mark, name (of the shingle set), n (its size) and shared of each document: how many of its shingles occur in
    other documents too. The sum of `shared` over a name is never too small.

    A task gathers documents up to FLUSH shingles (a flush) and numbers them. Their shingles go to buckets by hash, as
    32-bit fingerprints with the document's number in the flush, ordered by it and delta-coded: about five bytes each,
    however many buckets there are. A shingle that a flush has met in two documents is known to be shared and is sent
    once, without a number, so a bucket gets no more than one entry for each flush and shingle, however common that is. Buckets send counts back
    to the flush, where its documents wait.
    """
    total_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(partitions(source), -(-total_bytes // BUCKET_BYTES))
    tasks = max(partitions(source), -(-width // BUCKETS))
    kind = source.schema["doc_id"].dataType.simpleString()
    plain = ["doc_id", "mark", "name", "n", "shared", "number"]
    plain_kind = f"doc_id {kind}, mark long, name binary, n long, shared long, number long"

    def entries(sets: list[np.ndarray], direct: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Buckets, fingerprints and coded numbers; fingerprints beyond the numbers are known to be shared, which `direct` counts."""
        values = np.concatenate(sets)
        who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values)
        values, who = values[order], who[order]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        many = np.diff(np.r_[starts, len(values)])
        direct += np.bincount(who[np.repeat(many > 1, many)], minlength=len(sets))
        values, who = values[starts], np.where(many > 1, len(sets), who[starts])
        bucket = ((values >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket * (len(sets) + 1) + who)
        prints, who, bucket = values.astype("<u4")[order], who[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        named = who < len(sets)
        return (bucket[starts], _blobs(prints.view(np.uint8), 4 * np.r_[starts, len(prints)]),
                _coded(who[named], _cuts(np.add.reduceat(named, starts, dtype=np.int64))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ids, marks, names, sizes, sets, size = sh.WordTable(), [], [], [], [], [], 0
        home = TaskContext.get().partitionId() << 32

        def flush():
            direct = np.zeros(len(sets), dtype=np.int64)
            none = pa.nulls(0, pa.binary())
            buckets, prints, who = entries(sets, direct) if size else (np.empty(0, dtype=np.int64), none, none)
            n, m = len(buckets), len(sets)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([buckets, (home + np.arange(m)) % width])), pa.array(np.full(n + m, home)),
                *[pa.concat_arrays([c, pa.nulls(m, pa.binary())]) for c in (prints, who)],
                pa.concat_arrays([pa.nulls(n, ids[0].type), *ids]), pa.concat_arrays([pa.nulls(n, pa.int64()), *marks]),
                *[pa.concat_arrays([pa.nulls(n, c.type), c]) for c in (
                    pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(direct), pa.array(np.arange(m)))],
            ], names=["bucket", "home", "prints", "who", *plain])

        def rows(column, start, end):
            """A copy, which does not keep the texts of its batch in memory."""
            return column.take(pa.array(np.arange(start, end)))

        for batch in batches:
            first = 0
            for k, hashes in enumerate(table.of(*_bytes_of(batch.column(2)))):
                found = sh.shingle_set(hashes, words)
                sets.append(found)
                names.append(sh.name_of(found))
                sizes.append(len(found))
                size += len(found)
                if size >= FLUSH or len(sets) >= FLUSH:
                    ids.append(rows(batch.column(0), first, k + 1))
                    marks.append(rows(batch.column(1), first, k + 1))
                    first = k + 1
                    yield from flush()
                    home += 1
                    ids, marks, names, sizes, sets, size = [], [], [], [], [], 0
            ids.append(rows(batch.column(0), first, batch.num_rows))
            marks.append(rows(batch.column(1), first, batch.num_rows))
        if sets:
            yield from flush()

    def answer(held: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each flush with entries that are shared in this bucket: its documents' coded numbers and how many they have."""
        data, cuts = _bytes_of(held.column(2))
        values, starts = data.view("<u4"), cuts[:-1] // 4
        numbers, own_cuts = _decoded(held.column(3))
        own = np.diff(own_cuts)
        last = np.zeros(len(own), dtype=np.int64)
        last[own > 0] = numbers[own_cuts[1:][own > 0] - 1] + 1
        bases = _cuts(last)
        asked = np.full(len(values), -1, dtype=np.int64)
        asked[np.repeat(starts - own_cuts[:-1], own) + np.arange(len(numbers))] = numbers + np.repeat(bases[:-1], own)
        order = np.argsort(values)
        values, asked = values[order], asked[order]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        weight = np.add.reduceat(np.where(asked < 0, 2, 1), starts)
        shared = np.repeat(weight > 1, np.diff(np.r_[starts, len(values)]))
        hits = np.bincount(asked[shared & (asked >= 0)], minlength=bases[-1])
        found = np.flatnonzero(hits)
        cuts = np.searchsorted(found, bases)
        lengths = np.diff(cuts)
        some = lengths > 0
        cuts = _cuts(lengths[some])
        return (held.column(1).to_numpy()[some], _coded(found - np.repeat(bases[:-1], lengths), cuts),
                _blobs(hits[found].astype("<u4").view(np.uint8), 4 * cuts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["home", "found", "many", *plain]
        for parts in _by_key(batches):
            for part in parts:
                waiting = part.filter(pc.is_valid(part.column(6)))
                if m := waiting.num_rows:
                    yield pa.RecordBatch.from_arrays([waiting.column(1), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), *waiting.select(plain).columns], names=names)
            held = [part.filter(pc.is_valid(part.column(2))) for part in parts]
            if any(part.num_rows for part in held):
                homes, found, many = answer(_joined(held))
                if m := len(homes):
                    yield pa.RecordBatch.from_arrays([pa.array(homes), found, many, *[pa.nulls(m, held[0].schema.field(c).type) for c in plain]], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_key(batches):
            rows = _joined([part.filter(pc.is_valid(part.column(5))).select(plain) for part in parts])
            sent = [part.filter(pc.is_valid(part.column(1))) for part in parts]
            numbers, shared = rows.column(5).to_numpy(), rows.column(4).to_numpy()
            if any(part.num_rows for part in sent):
                sent = _joined(sent)
                found, _ = _decoded(sent.column(1))
                many = _bytes_of(sent.column(2))[0].view("<u4")
                shared = shared + np.bincount(found, many, minlength=int(numbers.max()) + 1).astype(np.int64)[numbers]
            yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(shared)], names=plain[:5])

    dealt = source.mapInArrow(deal, f"bucket long, home long, prints binary, who binary, {plain_kind}").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(count, f"home long, found binary, many binary, {plain_kind}").repartition(tasks, "home").sortWithinPartitions("home")
    return counts.mapInArrow(total, f"doc_id {kind}, mark long, name binary, n long, shared long")


def _sets(source: DataFrame, words: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sh.WordTable()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                sets = [sh.shingle_set(hashes, words) for hashes in table.of(*_bytes_of(batch.column(2).slice(first, 500)))]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                shingles = pa.ListArray.from_arrays(pa.array(_cuts(sizes).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(sh.name_of, sets)), pa.binary()), pa.array(sizes), shingles], names=["name", "n", "shingles"])

    return source.mapInArrow(make, "name binary, n long, shingles array<long>")


def _linked(common, a, b, percent: int):
    return common * 100 >= (a + b - common) * percent


def _search_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar within each block. blocks: block, name, n, weight, shingles (rarest first).

    The most central document of a block is compared with all others first, in place. Those not linked to it are the
    queries: each is searched for among all documents of its block by DivideSkip. A large block is cut into slices of
    documents and of queries, and each pair of slices is a task of its own.
    """
    pivots = blocks.groupBy("block").agg(
        F.max(F.struct("weight", "name")).alias("top"), F.count("*").alias("many")).select("block", F.col("top.name").alias("pivot"), "many")
    heads = blocks.join(pivots, "block").where("name = pivot").select("block", "pivot", "many", F.col("n").alias("pivot_n"), F.col("shingles").alias("pivot_shingles"))
    compared = stage(blocks.join(heads, "block").select(
        "block", "name", "n", "shingles", "pivot", "many",
        _linked(F.size(F.array_intersect("shingles", "pivot_shingles")), F.col("n"), F.col("pivot_n"), percent).alias("linked")), "compared")
    stars = compared.where("linked and name <> pivot").select(F.col("name").alias("a"), F.col("pivot").alias("b"))
    asking = compared.where("not linked").groupBy("block").agg(F.count("*").alias("queries"))
    cut = compared.join(asking, "block").select(
        "*", F.expr(f"cast(ceil(many / {SLICE}) as int)").alias("slices"), F.expr(f"cast(ceil(queries / {SLICE}) as int)").alias("rounds"))
    indexed = cut.where("name <> pivot").select(
        "block", "name", "n", "shingles", "linked", F.lit(False).alias("query"), F.expr("cast(pmod(xxhash64(name), slices) as int)").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"))
    queries = cut.where("not linked").select(
        "block", "name", "n", "shingles", "linked", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        F.expr("cast(pmod(xxhash64(name, 1), rounds) as int)").alias("round"))

    def search(table: pa.Table) -> pa.Table:
        names, sizes = table.column("name").to_pylist(), table.column("n").to_pylist()
        shingles = table.column("shingles").combine_chunks()
        values, cuts = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        sets = [values[a:b] for a, b in zip(cuts, cuts[1:])]
        query, linked = (table.column(c).to_numpy() for c in ("query", "linked"))
        docs, ask = np.flatnonzero(~query).tolist(), np.flatnonzero(query).tolist()
        number = {names[row]: k for k, row in enumerate(docs)}
        for row in ask:
            number.setdefault(names[row], len(number))
        groups, links = sh.Groups(len(number)), []
        near = [k for k, row in enumerate(docs) if linked[row]]
        for k in near[1:]:
            groups.join(near[0], k)
        index = sh.Index([(sets[row], sizes[row]) for row in docs])
        for row in ask:
            if groups.many == 1:
                break
            own = number[names[row]]
            for other, _ in index.search(sets[row], sizes[row], percent):
                if groups.join(own, other):
                    links.append((names[row], names[docs[other]]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    found = indexed.unionByName(queries).groupBy("block", "slice", "round").applyInArrow(search, "a binary, b binary")
    return stars.unionByName(found)


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents that links connect: two link when their shingle sets overlap by `percent` of their union.

    1. Equal sets fall together by name, so that exact copies, however many, are one set from here on.
    2. A set can have a partner only if `percent` of its shingles occur elsewhere (survey_sets); most sets end here.
    3. Of the rest, a partner shares one of the rarest shingles: all but the T - 1 most common ones, T the least overlap.
       Sets that such shingles connect, directly or not, form a block, so no link leaves a block.
    4. In each block: T-occurrence search (see _search_blocks), exact on the full sets; links within what is already
       connected are not listed, which loses no connection.

    Returns doc_id, mark (hash of the text), n_shingles and component_id (smallest doc_id of the group), a row per input
    row; head_mark is the mark of the row that would stay alone, by id (nulls last) and mark. Text without words is in no group but its own. Null ids never name a group that has others. Rows with equal ids
    are rows of their own, connected if their texts are. An empty table gives no rows.
    """
    ship_by_value(sh, sys.modules[__name__])
    source = _source(docs, doc_id, text)
    surveyed = stage(survey_sets(source, words), "surveyed")
    rows = surveyed.select("doc_id", "mark", "name", F.col("n").alias("n_shingles"))
    sets = surveyed.groupBy("name").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), F.min("doc_id").alias("rep")).where("n > 0")
    hopeful = stage(sets.where(F.col("shared") * 100 >= F.col("n") * percent).select("name", "rep"), "hopeful")
    # one text for each set: the row of its smallest id
    texts = source.join(hopeful.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    full = stage(_sets(texts, words).join(hopeful.select("name"), "name", "left_semi").dropDuplicates(["name"]), "sets")
    flat = full.select("name", "n", F.explode("shingles").alias("shingle"))
    df = flat.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = flat.join(df, "shingle").groupBy("name", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("common"), F.sum("df").alias("sum_df"))
    shared = stage(shared.where(F.size("common") * 100 >= F.col("n") * percent).select(
        "name", "n", (F.col("sum_df") / F.col("n")).alias("weight"), F.col("common.shingle").alias("shingles"),
        F.expr(f"size(common) - cast(ceil(n * {percent} / 100) as int) + 1").alias("rare")), "shared")
    posted = shared.select("name", F.explode(F.slice("shingles", F.lit(1), F.col("rare"))).alias("shingle"))
    least = posted.groupBy("shingle").agg(F.min("name").alias("b"), F.max("name").alias("c")).where("b <> c").select("shingle", "b")
    tied = posted.join(least, "shingle").select(F.col("name").alias("a"), "b")
    blocks = shared.join(components(tied).select(F.col("node").alias("name"), F.col("root").alias("block")), "name").select(
        "block", "name", "n", "weight", "shingles")
    roots = components(_search_blocks(stage(blocks, "blocks"), percent))
    grouped = rows.where("n_shingles > 0").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    named = grouped.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))["mark"].alias("head_mark"))
    return grouped.join(named, "root").select("doc_id", "mark", "n_shingles", "component_id", "head_mark").unionByName(
        rows.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.col("mark").alias("head_mark")))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their columns, of each group of near duplicates exactly one row: that of the smallest id, rows
    without id last, of equal ids that of the smallest hash of the text, of equal rows that of the smallest hash of all
    columns. Rows without words are in no group and all stay."""
    grouped = near_groups(docs, words, percent, doc_id, text).where("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("head_mark"))
    fates = stage(grouped.groupBy("doc_id", "mark").agg(F.max(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1").select(
        F.col("doc_id").alias("fate_id"), F.col("mark").alias("fate_mark"), "stays"), "fates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
                       F.xxhash64(F.col(f"`{text}`").cast("binary")).alias("mark"))
    met = lambda how, these: rows.join(these, F.col("doc_id").eqNullSafe(F.col("fate_id")) & (F.col("mark") == F.col("fate_mark")), how)
    # of equal rows that stay one is chosen; copies are thinned out in the task that reads them
    chosen = met("left_semi", fates.where("stays")).groupBy("doc_id", "mark").agg(
        F.min_by("row", F.xxhash64(*[F.col("row").getField(c) for c in docs.columns])).alias("row"))
    return met("left_anti", fates).select("row.*").unionByName(chosen.select("row.*"))
