"""What the operators share: staged tables, lower-casing of A-Z, choosing partitions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.session import checkpoint_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_path(df: DataFrame, label: str) -> str:
    """A fresh path below the folder that driver and executors share."""
    return f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


#: Tables and archives that this process has staged and not released.
STAGED: list[str] = []


#: While a table is staged: its shuffle files go as soon as it is written, not when the driver happens to collect garbage,
#: and what passes to Python at once is bounded by bytes, not by a number of texts of any length.
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries started inside run under these settings; the session's own come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and read it back, so later jobs neither recompute it nor depend on an executor."""
    path = shared_path(df, label)
    STAGED.append(path)
    with settings(df.sparkSession, STAGING):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, staged: str) -> bool:
    """Deletes one staged table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    if staged in STAGED:
        STAGED.remove(staged)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def release(spark: SparkSession) -> int:
    """Deletes what this process has staged, once results that read it are written elsewhere; returns how many."""
    gone = 0
    while STAGED:
        gone += discard(spark, STAGED[-1])
    return gone


def rows_with_text(df: DataFrame, keep: list[str] | None, text: str) -> tuple[DataFrame, int]:
    """The columns `keep` (all by default) as one struct `row`, ready for a task that reads the text, and the place of
    the text in it. A text that is not among them is added last, so that no task gets it twice."""
    names = df.columns if keep is None else list(keep)
    fields = [F.col(f"`{c}`") for c in names]
    if text not in names:
        fields.append(F.col(f"`{text}`"))
    return df.select(F.struct(*fields).alias("row")), names.index(text) if text in names else len(names)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII text takes the quick way with the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(df: DataFrame) -> int:
    """Partitions that a shuffle makes in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
