import base64
import gzip
import hashlib

from pyspark.sql import functions as F
from tables import empty

from sondage.llm import warc_records
from sondage.llm.warc import byte_ranges, read_records, write_archives

ROWS = [
    (1, "http://a.example/1", "<p>same</p>"), (2, "http://a.example/2", "<p>same</p>"), (3, None, ""), (4, "http://b.example/ \r\nx", None),
    (5, "http://c.example/é", "é" * 70_000), (6, "http://c.example/6", "WARC/1.1\r\n\r\n\r\n"), (2, "http://a.example/2", "<p>same</p>"),
    (None, "http://d.example", "nobody"), (None, "http://d.example", "nobody"), (7, "http://a.example/1", "x\x00y"),
]


def pages(spark):
    return spark.createDataFrame([(*r, "other") for r in ROWS], "page_id long, url string, html string, payload string").repartition(3)


def test_round_trip(spark):
    index = write_archives(pages(spark))
    first = {}
    for page, _, html in ROWS:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, _, html in ROWS:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        winner = first.get(html or "")
        revisit = winner is not None and winner != page
        want.append((page, len(body), digest, "revisit" if revisit else "response", winner if revisit else None, None if revisit else body))
    got = [(None if r["page_id"] is None else int(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
            None if r["refers_to"] is None else int(r["refers_to"]), None if r["payload"] is None else bytes(r["payload"]))
           for r in read_records(index).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_an_id_that_spells_none(spark):
    rows = spark.createDataFrame([("None", "a"), (None, "b"), ("<urn:nopage>", "c")], "page_id string, html string").selectExpr("*", "'u' as url")
    assert {(r["page_id"], bytes(r["payload"])) for r in read_records(write_archives(rows)).collect()} == {
        ("None", b"a"), (None, b"b"), ("<urn:nopage>", b"c")}


def test_reads_spread_by_the_bytes_of_archives(spark):
    index = write_archives(pages(spark))
    total = sum(r["length"] for r in index.collect())
    assert read_records(index).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert read_records(index, task_bytes=50).rdd.getNumPartitions() == -(-total // 50)


def test_selected_records_take_few_reads(spark):
    index = write_archives(pages(spark).coalesce(1))
    assert index.select("archive").distinct().count() == 1
    assert byte_ranges(index).count() == 1
    assert byte_ranges(index, gap_bytes=-1).count() == len(ROWS)
    chosen = index.where("url = 'http://a.example/1'")
    assert {r["page_id"] for r in read_records(chosen).collect()} == {"1", "7"}
    assert byte_ranges(index, range_bytes=100).count() > 1
    assert read_records(index, range_bytes=100).count() == len(ROWS)


def test_archives_are_plain_gzip_members(spark):
    index = write_archives(pages(spark), archive_bytes=1)
    assert index.select("archive").distinct().count() == len(ROWS)
    row = index.where("page_id = '5'").first()
    fs, path = warc_records.filesystem(row["archive"])
    raw = gzip.decompress(fs.open_input_file(path).read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")


def test_empty_table_and_damage(spark):
    index = write_archives(empty(spark).select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html")))
    assert index.count() == 0 and read_records(index).count() == 0
    member = warc_records.record("response", "1", None, b"abc", warc_records.digest_of(b"abd"), None)
    try:
        warc_records.parse(member)
    except ValueError as e:
        assert "digest" in str(e)
    else:
        raise AssertionError("a wrong digest must be noticed")
