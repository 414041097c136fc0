import os
import time

import pyarrow as pa
from pyspark.sql import functions as F
from tables import messy

from sondage.llm.common import STAGED, ascii_lower, release, stage
from sondage.llm.line_dedup import remove_repeated_lines


def test_staged_tables_go_when_released(spark):
    release(spark)
    kept = stage(messy(spark), "trial")
    assert kept.count() == messy(spark).count() and len(STAGED) == 1
    path = STAGED[0].removeprefix("file:")
    assert os.path.isdir(path)
    assert release(spark) == 1 and not os.path.exists(path) and release(spark) == 0


def test_only_ascii_letters_are_lowered(spark):
    df = spark.createDataFrame([("AbZ[@`{",), ("ÉAİ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(ascii_lower(df.t)).collect()] == ["abz[@`{", "Éaİ", "", None]


def shuffle_files(spark):
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data")}


def test_shuffle_files_go_with_the_staging(spark):
    before = shuffle_files(spark)
    assert stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "trial").count() == 7
    sorted_ids = stage(spark.range(1000).repartition(3).sort("id"), "trial")
    for _ in range(100):  # they are deleted in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and sorted_ids.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    release(spark)


def test_staging_passes_texts_to_python_by_bytes(spark):
    texts = spark.range(40).select(F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert max(r["n"] for r in stage(texts.mapInArrow(sizes, "n long"), "trial").collect()) < 8 << 20
    release(spark)


def test_line_dedup_keeps_no_table_of_all_chunks(spark):
    release(spark)
    text = "one two three four five six seven eight. nine ten eleven twelve thirteen fourteen fifteen.\n"
    docs = spark.createDataFrame([(1, text * 3), (2, text * 3)], "doc_id long, text string")
    out = remove_repeated_lines(docs)
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in STAGED] == ["line-proven"] and out.count() == 2
    release(spark)
