"""Session construction and the one place that decides where checkpoints go."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship_by_value(*modules) -> None:
    """Send kernel modules inside the task closure, so executors need no install."""
    for module in modules:
        cloudpickle.register_pickle_by_value(module)


def local_session(cores: str = "8", app: str = "sondage", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a local relation, so the planner knows its size."""
    return spark.sql(
        "SELECT inline(from_json(:rows, :schema))",
        args={"rows": json.dumps(rows), "schema": f"array<struct<{schema}>>"},
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named, a local session makes one of its own, which goes
    with the process, and any other master is refused: its executors would not see this machine's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    fallback = tempfile.mkdtemp(prefix="sondage-ckpt-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops plan growth."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
