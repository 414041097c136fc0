"""Named queries that write a table to a fresh folder and read it back through its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage.plans import probe_queries as pq
from sondage.plans import report_queries as rq
from sondage.plans import views as v
from sondage.plans.registry import CHECKS, query, with_views
from sondage.plans.stream_queries import fresh_folder
from sondage.session import cut_lineage
from sondage.sources import population as microdata
from sondage.sources import tables

V = v.VIEWS


@query("csv_population", """
SELECT c_custkey % 95 AS AGEP, 1 + c_custkey % 2 AS SEX, 1 + c_custkey % 24 AS SCHL,
       CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey * 8)::FLOAT END AS PINCP, c_nationkey AS ST,
       1 + c_custkey % 9 AS RAC1P, 1 + c_custkey % 5 AS MAR, 10 + c_custkey % 97 AS PWGTP
FROM customer WHERE c_custkey % 41 <> 0 AND c_custkey % 43 <> 0 AND c_custkey % 95 BETWEEN 18 AND 80""")
def csv_population(spark, sf_dir):
    """Microdata as CSV with more columns than needed, scanned, cleaned, stored and read."""
    folder, key = fresh_folder(spark), F.col("c_custkey")
    v.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("SERIALNO"), F.when(key % 41 != 0, key % 95).alias("AGEP"), (1 + key % 2).alias("SEX"),
        (1 + key % 24).alias("SCHL"), F.when(key % 17 != 0, key * 8).alias("PINCP"), F.col("c_nationkey").alias("ST"),
        F.col("c_mktsegment").alias("NOTE"), (1 + key % 9).alias("RAC1P"), (1 + key % 5).alias("MAR"),
        F.when(key % 43 != 0, 10 + key % 97).alias("PWGTP"),
    ).write.option("header", True).csv(f"{folder}/raw")
    clean = microdata.clean_population(microdata.read_microdata_csv(spark, f"{folder}/raw"))
    microdata.write_population(clean, f"{folder}/population")
    return microdata.read_population(spark, f"{folder}/population")


@query("upsert_sink", with_views(V, ["raw_responses", "responses"], "SELECT * FROM responses"))
def upsert_sink(spark, sf_dir):
    """Recorded answers in two batches, the later rows first, then the first batch once more."""
    folder = fresh_folder(spark)
    rows = v.raw_responses(spark, sf_dir)
    late = F.col("seq") % 2 == 1
    for batch in (rows.where(late), rows.where(~late), rows.where(late)):
        tables.upsert_responses(spark, f"{folder}/responses", batch, buckets=4)
    return tables.read_responses(spark, f"{folder}/responses").select("run_id", "persona_id", "question_id", "paraphrase_idx", "value")


@query("cache_sink", CHECKS["cache_insert_new"])
def cache_sink(spark, sf_dir):
    """Texts already cached, then all of them: the cache takes only what it lacks."""
    folder = fresh_folder(spark)
    texts = pq.gate.with_hash(pq.part_texts(spark, sf_dir)).select(
        "question_hash", F.col("question_id").alias("owner"), F.col("question_id").alias("seq"))
    held = pq.part_cache(spark, sf_dir).withColumn("seq", F.col("owner"))
    for rows in (held, texts, texts):
        tables.append_absent(spark, f"{folder}/cache", rows, "question_hash", "seq")
    return spark.read.parquet(f"{folder}/cache")


@query("report_sink", rq.skip.recursive(rq.SEVERITY, "SELECT run_id, question_id, severity FROM severities"))
def report_sink(spark, sf_dir):
    """Reports of both runs, one of them replaced, read back as rows per question."""
    folder = fresh_folder(spark)
    cards = cut_lineage(rq.severities(spark, sf_dir)).groupBy("run_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("question_id", "severity")))).alias("report"))
    tables.write_reports(cards.withColumn("report", F.lit("[]")), f"{folder}/reports")
    tables.write_reports(cards, f"{folder}/reports")
    tables.write_reports(cards.where("run_id = 'r1'"), f"{folder}/reports")
    stored = tables.read_reports(spark, f"{folder}/reports")
    return stored.select("run_id", F.explode(F.from_json("report", "array<struct<question_id: string, severity: string>>")).alias("q")).select(
        "run_id", "q.question_id", "q.severity")
