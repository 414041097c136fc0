"""Names below a folder of a shared file system, seen from the driver through Spark's own file systems."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _opened(spark, path)
    return files.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    files, where = _opened(spark, folder)
    return sorted(status.getPath().getName() for status in files.listStatus(where)) if files.exists(where) else []


def delete(spark: SparkSession, path: str) -> bool:
    files, where = _opened(spark, path)
    return files.delete(where, True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a folder its name if the name is free; False if it is taken. One step on file systems whose rename is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files, where = _opened(spark, target)
    files.mkdirs(where.getParent())
    old, new = (files.makeQualified(hadoop.Path(name)) for name in (source, target))
    context = hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(old, new, options)
    except Py4JJavaError as error:
        if not error.java_exception.getClass().getSimpleName().startswith("FileAlreadyExists"):
            raise
        return False
    return True
