"""Tables in versions: a writer publishes a whole version or nothing, a reader keeps the version it began with.

`data/commit=<id>` holds what one commit wrote, partitioned by the table's columns. `versions/<n>` is a small table that says
which commit holds each partition. A commit writes its partitions beside all others, then takes the next number by a rename
that fails if another writer has it; then it looks at what the other changed: if those are other partitions, only the small
table is written anew, else its rows are made again from the newer version. No reader or writer waits, and what a stopped
writer leaves behind is in no version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sondage.sources import storage

#: Versions that stay readable.
KEEP = 8
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other writers were faster every time."""


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in storage.names(spark, f"{path}/versions"))


def current(spark: SparkSession, path: str) -> int | None:
    """The newest version, None for a table that does not exist."""
    return max(versions(spark, path), default=None)


def live(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The partitions of a version: the table's partition columns, commit, and size, the partitions that commit wrote."""
    return spark.read.parquet(f"{path}/versions/{version}")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, by default the newest one; None without a version or without rows.

    Folders of commits that hold a live partition are read, and a semi-join on partition columns leaves out what they hold of
    partitions replaced since. Filters on partition columns reach the list of files.
    """
    version = current(spark, path) if version is None else version
    if version is None:
        return None
    parts = live(spark, path, version)
    folders = [f"{path}/data/commit={r['commit']}" for r in parts.select("commit").distinct().sort("commit").collect()]
    if not folders:
        return None
    source = spark.read.option("basePath", f"{path}/data")
    known = {f.name: f for f in parts.drop("size").schema}
    # partition values keep the types they were written with
    schema = StructType([known.get(f.name, f) for f in source.parquet(*folders).schema])
    return source.schema(schema).parquet(*folders).join(parts.drop("size"), list(known), "left_semi").drop("commit")


def _after(parts: DataFrame | None, mine: DataFrame, by: Sequence[str]) -> DataFrame:
    """The live partitions once `mine` take the place of what was there."""
    return mine if parts is None else parts.join(mine, list(by), "left_anti").select(*mine.columns).unionByName(mine)


def _written(spark: SparkSession, path: str, name: str, schema: StructType, by: Sequence[str]) -> DataFrame:
    """The partitions that commit `name` wrote, from the names of its files."""
    found = spark.read.schema(schema).parquet(f"{path}/data/commit={name}").select(*by).distinct().persist()
    missing = " or ".join(f"`{c}` is null" for c in by)
    many = found.agg(F.count("*").alias("size"), F.count_if(F.expr(missing)).alias("missing")).first()
    if many["missing"]:
        raise ValueError(f"a null in {', '.join(by)}: rows without it have no partition")
    return found.select(*by, F.lit(name).alias("commit"), F.lit(many["size"]).cast("long").alias("size"))


def _unchanged(spark: SparkSession, path: str, mine: DataFrame, by: Sequence[str], base: int | None, now: int | None) -> bool:
    """Whether versions `base` and `now` hold the same in the partitions `mine`. A table that came into being is a change."""
    if base == now:
        return True
    if base is None:
        return False
    was, held = (live(spark, path, n).select(*by, F.col("commit").alias(c)) for n, c in ((base, "was"), (now, "held")))
    both = mine.select(*by).join(was, list(by), "left").join(held, list(by), "left")
    return both.where(~F.col("was").eqNullSafe(F.col("held"))).isEmpty()


def commit(spark: SparkSession, path: str, make: Callable[[int | None], DataFrame], by: Sequence[str], attempts: int = ATTEMPTS) -> int:
    """Publishes the rows of `make(version)` as the whole content of the partitions they fall into, and returns the version's
    number. `make` is given the version to start from (None: no table yet) and called again if another writer has changed
    those partitions meanwhile. Partition values may not be null. Raises Conflict after `attempts` lost races."""
    base, mine, name = None, None, ""
    for _ in range(attempts):
        now = current(spark, path)
        if mine is None or not _unchanged(spark, path, mine, by, base, now):
            if name:  # made from a version that is no longer the newest
                storage.delete(spark, f"{path}/data/commit={name}")
            name, rows = uuid.uuid4().hex, make(now)
            # rebalancing gathers each partition's rows and still splits one that is too large for a task
            rows.hint("rebalance", *[F.col(c) for c in by]).write.option("compression", "zstd").partitionBy(*by).parquet(f"{path}/data/commit={name}")
            mine = _written(spark, path, name, rows.schema, by)
        base = now
        staged = f"{path}/staged/{uuid.uuid4().hex}"
        # rebalanced, so that the number of files does not grow with the number of commits
        _after(None if now is None else live(spark, path, now), mine, by).hint("rebalance").write.parquet(staged)
        number = 0 if now is None else now + 1
        if storage.rename_new(spark, staged, f"{path}/versions/{number}"):
            return number
        storage.delete(spark, staged)
    storage.delete(spark, f"{path}/data/commit={name}")
    raise Conflict(f"{attempts} commits to {path} met other writers")


def compact(spark: SparkSession, path: str, by: Sequence[str]) -> int | None:
    """Writes anew the partitions of commits of which at most half are live: each row that is moved makes room for one that
    is dead, so the work is in proportion to what was written. None if there are no such commits."""
    now = current(spark, path)
    if now is None:
        return None

    def sparse(version: int) -> DataFrame:
        parts = live(spark, path, version)
        thin = parts.groupBy("commit").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("2 * n <= size")
        return parts.join(thin.select("commit"), "commit", "left_semi").select(*by)

    if sparse(now).isEmpty():
        return None
    return commit(spark, path, lambda version: read(spark, path, version).join(sparse(version), list(by), "left_semi"), by)


def expire(spark: SparkSession, path: str, keep: int = KEEP) -> list[int]:
    """Gives up all versions but the newest `keep`, with the commits that only they hold; returns their numbers.

    A reader that began with one of them fails, and so does nothing else: commits on their way are in no version yet.
    """
    known = versions(spark, path)
    old, kept = known[:-keep], known[-keep:]
    if not old:
        return []
    commits = lambda numbers: spark.read.parquet(*[f"{path}/versions/{n}" for n in numbers]).select("commit").distinct()
    dead = [r["commit"] for r in commits(old).join(commits(kept), "commit", "left_anti").collect()]
    for number in old:
        storage.delete(spark, f"{path}/versions/{number}")
    for name in dead:
        storage.delete(spark, f"{path}/data/commit={name}")
    return old
