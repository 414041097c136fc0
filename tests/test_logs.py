"""Ordered work, failure alarm, status logs, spend and streams."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sondage import config
from sondage.operators import logs, ordered
from sondage.streaming import ingest, monitors


def log_rows(n=600, keys=("hot",), seed=1, fail=0.4):
    rng = random.Random(seed)
    at, rows = 0.0, []
    for i in range(n):
        at += rng.choice([0.0, 0.5, 2.0, 9.0])
        bad = rng.random() < (fail if (i // 150) % 2 == 0 else 0.01)
        rows.append((rng.choice(keys), i, at, not bad))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, call_id bigint, at double, ok boolean")


def test_places_are_exact_for_a_hot_key(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("key"), (F.col("id") * 7919 % 5000).alias("at")
    )
    placed = ordered.with_place(rows.repartition(11), ["key"], ["at"]).where("key = 'hot'").orderBy("at").collect()
    assert [r["_place"] for r in placed] == list(range(4000))


@pytest.mark.parametrize("chunk", [40, 1_000_000])
def test_rolling_failures_with_and_without_chunks(spark, chunk):
    rows = log_rows(keys=("a", "b"))
    out = logs.rolling_failures(frame(spark, rows), ["key"], ["at", "call_id"], max_group=chunk).collect()
    recent, want = {"a": deque(maxlen=30), "b": deque(maxlen=30)}, {}
    for key, i, at, ok in rows:
        recent[key].append(not ok)
        want[i] = sum(recent[key]) / len(recent[key]), len(recent[key]) == 30 and sum(recent[key]) >= 15
    assert len(out) == len(rows)
    for r in out:
        assert (r["failure_ratio"], r["alarm"]) == (pytest.approx(want[r["call_id"]][0]), want[r["call_id"]][1])


STATUS = "run_id string, status string, ts timestamp, seq int"


def statuses(spark, *runs):
    rows = [(f"r{n}", s, i) for n, run in enumerate(runs) for i, s in enumerate(run)]
    return spark.createDataFrame(rows, "run_id string, status string, seq int").withColumn("ts", F.timestamp_seconds(F.col("seq") * 10))


def test_transition_audit(spark):
    happy = ["pending", "personas_ready", "paraphrases_ready", "probing", "stats_running", "completed"]
    bad = statuses(spark, happy, ["pending", "probing"], ["probing", "failed"], ["pending", "failed", "pending"])
    for chunk in (3, 1_000_000):
        out = logs.transition_audit(bad, logs.allowed_pairs(spark), max_group=chunk).collect()
        assert sorted((r["run_id"], r["from_status"], r["to_status"]) for r in out) == [
            ("r1", "pending", "probing"), ("r2", None, "probing"), ("r3", "failed", "pending")]


def test_changes_stop_at_the_first_terminal_status(spark):
    log = statuses(spark, ["pending", "pending", "probing", "completed", "failed", "pending"])
    assert [r["status"] for r in logs.status_changes(log).orderBy("seq").collect()] == ["pending", "probing", "completed"]


def test_stage_durations(spark):
    log = statuses(spark, ["a", "b", "a", "c"])
    for chunk in (2, 1_000_000):
        assert {r["status"]: (r["seconds"], r["visits"]) for r in logs.stage_durations(log, max_group=chunk).collect()} == {"a": (20.0, 2), "b": (10.0, 1)}


def test_prices(spark):
    model = list(config.PRICES)[0]
    rows = [(1, model, 1_000_000, 0, 0, 0), (2, model, 1_000_000, 0, 600_000, 100_000), (3, "other", 9, 9, 0, 0), (4, model, 10, 0, 600, 0)]
    calls = spark.createDataFrame(rows, "call_id int, model string, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int")
    cost = {r["call_id"]: r["cost_usd"] for r in logs.priced_calls(calls, logs.price_list(spark)).collect()}
    assert cost[1] == pytest.approx(3.0) and cost[2] == pytest.approx(0.3 * 3 + 0.6 * 0.3 + 0.1 * 3.75) and cost[3] == 0.0
    assert cost[4] == pytest.approx(600 * 0.3 / 1e6)


def test_cap_breach_orders_equal_instants_by_call(spark):
    rows = [("d", 10, 3.0), ("d", 10, 3.0), ("d", 11, 3.0), ("e", 10, 1.0)]
    calls = spark.createDataFrame([(d, s, i, c) for i, (d, s, c) in enumerate(rows)], "day string, s int, call_id int, cost_usd double")
    out = logs.spend_cap_breach(calls.withColumn("ts", F.timestamp_seconds("s")), cap=5.0).collect()
    assert [(r["day"], r["call_id"], r["spent_usd"]) for r in out] == [("d", 1, 6.0)]


def test_routing(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (2, 3, "y")], "job int, attempt int, reason string")
    assert [(r["route"], r["next_attempt"], r["reason"]) for r in logs.route_failures(rows).orderBy("job").collect()] == [
        ("retry", 2, None), ("dead_letter", None, "y")]


# --- streams in several batches ---------------------------------------------
def feed(spark, df, folder, parts, order):
    """Write `df` as `parts` files in order and read them one file per batch."""
    rows = df.orderBy(*order).collect()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_stream_flags_follow_late_and_changed_answers(spark, tmp_path):
    from sondage.operators.responses import latest_responses
    from sondage.operators.shift import shift_flags

    rng = random.Random(3)
    rows = [("r", f"p{rng.randint(0, 11)}", rng.choice("ab"), rng.randint(0, 2), rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0]), i * 7919 % 900, i) for i in range(900)]
    df = spark.createDataFrame(rows, "run_id string, persona_id string, question_id string, paraphrase_idx int, value double, ts bigint, seq bigint")
    asked = spark.createDataFrame([("r", "a", "likert_5", 0), ("r", "b", "single_choice", 6)], "run_id string, question_id string, type string, n_options int")
    stream = feed(spark, df, f"{tmp_path}/in", 3, ["seq"])
    ingest.keep_responses(stream, f"{tmp_path}/table", f"{tmp_path}/cp", buckets=2).awaitTermination()
    want = shift_flags(latest_responses(df), asked).orderBy("question_id").collect()
    assert ingest.current_flags(spark, f"{tmp_path}/table", asked).orderBy("question_id").collect() == want
    assert ingest.current_flags(spark, f"{tmp_path}/table", asked.where("question_id = 'a'"), "r", ["a"]).collect() == want[:1]
    assert {r["metric"] for r in want} == {"wasserstein", "jensen_shannon"}


def test_stream_upsert_equals_batch(spark, tmp_path):
    from sondage.operators.responses import latest_responses
    from sondage.sources.tables import read_responses

    rng = random.Random(8)
    rows = [(f"r{i % 2}", f"p{rng.randint(0, 5)}", "q", rng.randint(0, 2), float(i), i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id string, persona_id string, question_id string, paraphrase_idx int, value double, ts bigint, seq bigint")
    stream = feed(spark, df, f"{tmp_path}/in", 3, ["ts"])
    ingest.keep_responses(stream, f"{tmp_path}/table", f"{tmp_path}/cp", buckets=2).awaitTermination()
    got = read_responses(spark, f"{tmp_path}/table").select("run_id", "persona_id", "question_id", "paraphrase_idx", "value")
    want = latest_responses(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def status_stream(spark, rows, folder, delay, keep):
    """Rows are (file, run, status, seconds, seq); a last entry far ahead lets the watermark pass the others."""
    for k in sorted({r[0] for r in rows}) + [99]:
        part = [(run, status, at, seq) for file, run, status, at, seq in rows if file == k] or [("close", "close", 10_000_000, 0)]
        df = spark.createDataFrame(part, "run_id string, status string, at long, seq long")
        df.select("run_id", "status", F.timestamp_seconds("at").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("run_id string, status string, ts timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with monitors.rocksdb_state(spark):
        return drain(spark, monitors.status_change_stream(stream, delay, keep), folder).where("run_id <> 'close'")


def test_stream_status_changes_in_order_of_event_time(spark, tmp_path):
    rows = [(0, "a", "pending", 1, 1), (0, "a", "completed", 40, 5), (0, "b", "probing", 20, 9), (1, "a", "probing", 12, 3), (1, "a", "pending", 5, 2),
            (1, "a", "probing", 30, 4), (1, "b", "pending", 10, 8), (2, "a", "failed", 60, 7), (2, "b", "probing", 70, 10), (2, "b", "failed", 75, 11)]
    out = status_stream(spark, rows, tmp_path, "50 seconds", "1 hour")
    got = {run: [r["status"] for r in out.where(F.col("run_id") == run).orderBy("seq").collect()] for run in "ab"}
    assert got == {"a": ["pending", "probing", "completed"], "b": ["pending", "probing", "failed"]}


def test_stream_status_keeps_nothing_of_finished_runs(spark, tmp_path):
    rows = [(0, "a", "pending", 1, 1), (0, "a", "completed", 5, 2), (1, "a", "probing", 30, 3), (1, "b", "pending", 400, 4), (2, "b", "pending", 800, 5)]
    out = status_stream(spark, rows, tmp_path, "10 seconds", "5 minutes")
    assert sorted((r["run_id"], r["status"]) for r in out.collect()) == [("a", "completed"), ("a", "pending"), ("b", "pending")]
    held = lambda name, **more: spark.read.format("statestore").option("stateVarName", name).options(**more).load(f"{tmp_path}/cp")
    assert {r["key"]["run_id"] for r in held("last").collect()} - {"close"} == {"b"}
    assert {r["key"]["run_id"] for r in held("waiting").collect()} - {"close"} == set()


def test_stream_routing_to_two_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1 + i % 4, "x") for i in range(8)], "job int, attempt int, reason string")
    stream = feed(spark, rows, f"{tmp_path}/in", 2, ["job"])
    monitors.route_failures_stream(stream, f"{tmp_path}/retry", f"{tmp_path}/dead", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/retry").count() == 4 and spark.read.parquet(f"{tmp_path}/dead").count() == 4
