import glob

from pyspark.sql import functions as F

from sondage.plans.stream_queries import in_files


def test_a_part_of_a_feed_is_dealt_over_many_files(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("part")).coalesce(1)
    stream = in_files(spark, rows, f"{tmp_path}/feed")
    assert len(glob.glob(f"{tmp_path}/feed/*.parquet")) == 2 * spark.sparkContext.defaultParallelism
    assert stream.isStreaming and spark.read.parquet(f"{tmp_path}/feed").count() == 1000
