"""WARC archives with an index first: write, index, select, read coalesced byte ranges."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm import warc_records
from sondage.llm.common import STAGED, shared_path, stage
from sondage.session import ship_by_value

INDEX = ("archive string, offset long, length long, url string, digest string, page_id string, record_type string, "
         "refers_to string, payload_bytes long")


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
                   archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes a gzip-per-record WARC record for every row and returns the index: one row per record with its archive,
    offset, length, URL and digest.

    Of rows with equal payload, the one with the smallest id is the response and the others are revisits that refer to
    it. Payloads are compared by SHA-256 and length, counted before the shuffle, and each page moves once.
    An archive has a name of its own for each attempt at a task, and only complete archives are in the index, which is
    written last: what a lost executor leaves behind is never read.

    Null html is an empty payload. A null url writes no target. Null ids never win over others; rows that repeat the
    winning id are all responses. An empty table gives an empty index. Other columns are ignored.
    """
    ship_by_value(warc_records, sys.modules[__name__])
    if folder is None:
        STAGED.append(folder := shared_path(pages, "warc"))
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    winners = rows.groupBy("sha", "size").agg(F.min("page_id").alias("winner"))
    ready = rows.join(winners, ["sha", "size"]).select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload",
        F.when(F.col("page_id").eqNullSafe(F.col("winner")), None).otherwise(F.col("winner")).cast("string").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = warc_records.filesystem(folder)
        fs.create_dir(root, recursive=True)
        sink, name, at, done = None, "", 0, []

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pylist(done, schema=ARROW_INDEX)

        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name, at, done = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                kind = "response" if row["refers_to"] is None else "revisit"
                digest = warc_records.digest_of(row["payload"])
                member = warc_records.record(kind, row["page_id"], row["url"], row["payload"], digest, row["refers_to"])
                sink.write(member)
                done.append({"archive": f"{folder}/{name}", "offset": at, "length": len(member), "url": row["url"], "digest": digest,
                             "page_id": row["page_id"], "record_type": kind, "refers_to": row["refers_to"],
                             "payload_bytes": len(row["payload"])})
                at += len(member)
                if at >= archive_bytes:
                    yield closed()
                    sink = None
        if sink is not None:
            yield closed()

    return stage(ready.mapInArrow(write, INDEX), "warc-index")


ARROW_INDEX = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (part.split() for part in INDEX.split(", "))])


def byte_ranges(selected: DataFrame, range_bytes: int = 8 << 20, gap_bytes: int = 64 << 10) -> DataFrame:
    """Index rows gathered to reads: neighbours in an archive share one read while the gap between them is small, and
    no read spans a multiple of `range_bytes` but for its last record."""
    ordered = Window.partitionBy("archive").orderBy("offset", "length")
    last = F.lag(F.struct((F.col("offset") + F.col("length")).alias("end"), F.expr(f"offset div {range_bytes}").alias("block"))).over(ordered)
    new = last.isNull() | (F.col("offset") - last["end"] > gap_bytes) | (F.expr(f"offset div {range_bytes}") != last["block"])
    marked = selected.withColumn("new", new.cast("int")).withColumn("range", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("archive", "range").agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def read_records(selected: DataFrame, range_bytes: int = 8 << 20, gap_bytes: int = 64 << 10, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of the given index rows, read with one seek per range and checked against their digests.

    The ranges are dealt to as many tasks as their archives' bytes need, and no fewer than the cluster has cores: the index rows
    that name them are too small to tell. Adding up their lengths is a job over the index.

    Returns page_id, url, record_type, refers_to, payload_digest, payload_bytes (of the full payload, also for a revisit)
    and payload (null for a revisit), as the archive has them. No rows give no rows.
    """
    ship_by_value(warc_records, sys.modules[__name__])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] not in handles:
                    for old in handles.values():
                        old.close()
                    fs, path = warc_records.filesystem(row["archive"])
                    handles = {row["archive"]: fs.open_input_file(path)}
                data = handles[row["archive"]].read_at(row["end"] - row["first"], row["first"])
                out = []
                for place in row["records"]:
                    start = place["offset"] - row["first"]
                    got = warc_records.parse(data[start : start + place["length"]])
                    out.append({
                        "page_id": warc_records.page_of(got["WARC-Record-ID"]), "url": got.get("WARC-Target-URI"),
                        "record_type": got["WARC-Type"], "refers_to": warc_records.page_of(got.get("WARC-Refers-To")),
                        "payload_digest": got["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": int(got["WARC-Payload-Length"]),
                        "payload": got["payload"]})
                yield pa.RecordBatch.from_pylist(out, schema=ARROW_RECORD)

    ranges = byte_ranges(selected, range_bytes, gap_bytes)
    wanted = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-wanted // task_bytes))
    spread = ranges.repartition(tasks, "archive", "range").sortWithinPartitions("archive", "range")
    return spread.mapInArrow(read, RECORD)


RECORD = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
ARROW_RECORD = pa.schema([
    (name, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (part.split() for part in RECORD.split(", "))])
