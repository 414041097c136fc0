import pytest
from pyspark.sql import functions as F
from tables import CLASHES, messy, plain

import corpus_pipeline
from sondage.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_runs_and_agrees_with_its_sql(spark):
    from compare import compare

    for name, fn in QUERIES.items():
        if name in CHECKS:
            _, problems = compare(spark, SF, fn, CHECKS[name])
            assert not problems, (name, problems)
        else:
            assert fn(spark, SF).count() > 0, name


def test_stages_keep_columns_and_rows_that_are_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, SF)
        assert kept.columns == docs.columns and kept.schema["text"].dataType == docs.schema["text"].dataType
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after.keys() <= before.keys() and len(after) >= 0.8 * len(before)
        if name != "line_dedup":
            assert all(before[k] == t for k, t in after.items())
        docs = spark.createDataFrame(kept.collect(), kept.schema)
        before = after
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before.keys()
    assert packed.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_run_is_the_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]


@pytest.mark.parametrize("step", range(5))
def test_stages_take_messy_and_empty_tables(spark, step):
    name, fn = corpus_pipeline.STAGES[step]
    docs = messy(spark)
    out = fn(spark, docs, SF)
    if step < 4:
        assert out.columns == docs.columns and set(CLASHES) < set(out.columns)
    assert out.count() > 0
    assert fn(spark, docs.limit(0), SF).count() == 0


def test_copies_and_near_copies_leave_one(spark):
    body = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(5, body), (3, body), (9, body + " end"), (1, "unlike the others")], "doc_id long, text string")
    assert plain(corpus_pipeline.near_duplicates(spark, docs, SF), "doc_id") == [(1,), (3,)]
    assert corpus_pipeline.near_duplicates(spark, docs, SF).where(F.col("text").isNull()).count() == 0
