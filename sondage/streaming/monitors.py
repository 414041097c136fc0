"""Streaming monitors: status changes and failed-job routing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sondage import config
from sondage.operators.logs import route_failures


class StatusChanges(StatefulProcessor):
    """Per run: entries wait until the watermark has passed them, then count in the order of time and `seq`.

    State is the waiting entries (bounded by the watermark's delay; those that came together are one block), the last status, and after a terminal status a mark
    that keeps later entries out. The mark goes `keep_ms` after the terminal entry; then nothing is left of the run.
    """

    def __init__(self, terminal: list[str], keep_ms: int):
        self.terminal, self.keep_ms = frozenset(terminal), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, seq array<long>, status array<string>")
        self.last = handle.getValueState("last", "status string")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest, done = None, self.last.exists() and self.last.get()[0] in self.terminal
        for pdf in rows:
            if not done and len(pdf):
                self.waiting.appendValue((pdf["at"].tolist(), pdf["seq"].tolist(), pdf["status"].tolist()))
                earliest = min(x for x in (earliest, int(pdf["at"].min())) if x is not None)
        if earliest is not None:
            self._wake(-(-earliest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        if last in self.terminal:  # the mark has been held long enough
            self.last.clear()
        else:
            entries = sorted(e for block in self.waiting.get() for e in zip(*block)) if self.waiting.exists() else []
            due = [e for e in entries if e[0] <= now * 1000]
            for at, seq, status in due:
                if status != last:
                    kept.append((key[0], status, seq))
                    last = status
                if last in self.terminal:
                    break
            self.waiting.clear()
            if kept:
                self.last.update((last,))
            if last in self.terminal:
                self._wake(at // 1000 + self.keep_ms)
            elif len(due) < len(entries):
                self.waiting.put([tuple(map(list, zip(*entries[len(due) :])))])
                self._wake(-(-entries[len(due)][0] // 1000))
        if kept:
            yield pd.DataFrame(kept, columns=["run_id", "status", "seq"])

    def _wake(self, ms: int) -> None:
        """One timer per run, at the earliest time it is needed."""
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is not None and held <= ms:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def close(self) -> None:
        pass


def status_change_stream(log: DataFrame, delay: str, keep: str = "7 days", terminal: list[str] = config.TERMINAL_STATUSES, event_time: str = "ts") -> DataFrame:
    """Emit a run's status only when it changes in the order of event time, and nothing after a terminal one.

    `log` has run_id, status, seq (the order within one time) and the event time; entries may arrive in any order as long
    as they are no later than `delay`, beyond that they are dropped. A change comes out once the watermark has passed it.
    A run is forgotten `keep` after its terminal entry, by event time: longer than entries may still name it.
    Needs the state store `ROCKSDB` in `spark.sql.streaming.stateStore.providerClass`.
    """
    spark = log.sparkSession
    keep_ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {keep})").first()[0]
    rows = log.withWatermark(event_time, delay).select("run_id", "status", F.col("seq").cast("long"), F.unix_micros(F.col(event_time).cast("timestamp")).alias("at"), event_time)
    return rows.groupBy("run_id").transformWithStateInPandas(
        StatusChanges(terminal, keep_ms), "run_id string, status string, seq bigint", "append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def route_failures_stream(failed: DataFrame, retry_path: str, dead_path: str, checkpoint: str):
    """Split failed jobs into two tables; each batch overwrites its own folder when replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = route_failures(batch).persist()
        try:
            for route, path in (("retry", retry_path), ("dead_letter", dead_path)):
                routed.where(f"route = '{route}'").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            routed.unpersist()

    return (
        failed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
