"""Named queries over call and status logs, read from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.operators import logs
from sondage.plans import views as v
from sondage.plans.registry import query, rnd, sql_case, with_views

V = v.VIEWS
_MODELS = list(config.PRICES)
_BY_EVENT = {"click": _MODELS[0], "view": _MODELS[0], "purchase": _MODELS[1], "signup": _MODELS[1]}
V["calls"] = f"""
SELECT event_id AS call_id, ts, ts::DATE::VARCHAR AS day, 'r' || user_id % 20 AS run_id,
  {sql_case('event_type', _BY_EVENT, "'unlisted'")} AS model,
  CASE WHEN event_id % 4 = 0 THEN 'paraphrase_gen' ELSE 'probe_response' END AS purpose,
  (500 + floor(value)::BIGINT * 10) AS input_tokens, 20 + event_id % 100 AS output_tokens,
  CASE WHEN event_id % 3 = 0 THEN 400 ELSE 0 END AS cache_read_tokens,
  CASE WHEN event_id % 5 = 0 THEN 300 ELSE 0 END AS cache_write_tokens FROM events"""
_PRICE = "(VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for m, (a, b, c, d) in config.PRICES.items()) + ") AS p(model, pi, po, pw, pr)"
V["priced"] = f"""
SELECT c.*, coalesce((greatest(0, input_tokens - cache_read_tokens - cache_write_tokens) * pi + cache_read_tokens * pr
    + cache_write_tokens * pw + output_tokens * po) / 1000000.0::DOUBLE, 0.0) AS cost_usd,
  coalesce((input_tokens * pi + output_tokens * po) / 1000000.0::DOUBLE, 0.0) AS cost_uncached_usd
FROM calls c LEFT JOIN {_PRICE} USING (model)"""
PRICED = ["calls", "priced"]
CAP = 0.25


def calls(spark, sf_dir):
    key = F.col("event_id")
    model = F.lit(None).cast("string")
    for event, name in _BY_EVENT.items():
        model = F.when(F.col("event_type") == event, name).otherwise(model)
    return v.table(spark, sf_dir, "events").select(
        key.alias("call_id"), "ts", F.to_date("ts").cast("string").alias("day"),
        F.concat(F.lit("r"), F.col("user_id") % 20).alias("run_id"), F.coalesce(model, F.lit("unlisted")).alias("model"),
        F.when(key % 4 == 0, "paraphrase_gen").otherwise("probe_response").alias("purpose"),
        (500 + F.floor("value") * 10).alias("input_tokens"), (20 + key % 100).alias("output_tokens"),
        F.when(key % 3 == 0, 400).otherwise(0).alias("cache_read_tokens"),
        F.when(key % 5 == 0, 300).otherwise(0).alias("cache_write_tokens"),
    )


def priced(spark, sf_dir):
    return logs.priced_calls(calls(spark, sf_dir), logs.price_list(spark))


@query("call_cost", with_views(V, PRICED, f"SELECT call_id, {rnd('cost_usd', 8)} AS cost_usd FROM priced"))
def call_cost(spark, sf_dir):
    return priced(spark, sf_dir).select("call_id", F.round("cost_usd", 8).alias("cost_usd"))


@query("spend_rollup", with_views(V, PRICED, f"""
SELECT CASE WHEN grouping(day) = 1 THEN 'ALL' ELSE day END AS day, CASE WHEN grouping(model) = 1 THEN 'ALL' ELSE model END AS model,
  CASE WHEN grouping(purpose) = 1 THEN 'ALL' ELSE purpose END AS purpose, count(*) AS calls, {rnd('sum(cost_usd)')} AS cost_usd
FROM priced GROUP BY ROLLUP (day, model, purpose)"""))
def spend_rollup(spark, sf_dir):
    return logs.spend_rollup(priced(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("spend_cap_breach", with_views(V, PRICED, f"""
SELECT day, call_id, {rnd('spent')} AS spent_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, call_id) AS rn FROM (
    SELECT *, sum(cost_usd) OVER (PARTITION BY day ORDER BY ts, call_id) AS spent FROM priced) WHERE spent > {CAP}) WHERE rn = 1"""))
def spend_cap_breach(spark, sf_dir):
    return logs.spend_cap_breach(priced(spark, sf_dir), CAP).withColumn("spent_usd", F.round("spent_usd", 6))


@query("cache_savings", with_views(V, PRICED, f"""
SELECT model, sum(cache_read_tokens)::BIGINT AS read_tokens, sum(input_tokens)::BIGINT AS input_tokens, {rnd('sum(cost_usd)')} AS cost_usd,
  {rnd('sum(cost_uncached_usd)')} AS cost_uncached_usd, {rnd('sum(cache_read_tokens) / sum(input_tokens)')} AS read_share,
  {rnd('sum(cost_uncached_usd) - sum(cost_usd)')} AS saved_usd FROM priced GROUP BY 1"""))
def cache_savings(spark, sf_dir):
    out = logs.cache_savings(priced(spark, sf_dir))
    for c in ("cost_usd", "cost_uncached_usd", "read_share", "saved_usd"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("rolling_failure", f"""
SELECT key, call_id, in_window, {rnd('failure_ratio')} AS failure_ratio, in_window = 30 AND failure_ratio >= 0.5 AS alarm FROM (
  SELECT 'k' || user_id % 10 AS key, event_id AS call_id,
    avg(CASE WHEN event_type IN ('error', 'signup', 'view') THEN 1.0 ELSE 0.0 END) OVER w AS failure_ratio, count(*) OVER w AS in_window
  FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""")
def rolling_failure(spark, sf_dir):
    rows = v.table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), F.col("user_id") % 10).alias("key"), F.col("event_id").alias("call_id"), "ts",
        (~F.col("event_type").isin("error", "signup", "view")).alias("ok"),
    )
    out = logs.rolling_failures(rows, ["key"], ["ts", "call_id"])
    return out.select("key", "call_id", "in_window", F.round("failure_ratio", 6).alias("failure_ratio"), "alarm")


# --- status logs: one per user ---------------------------------------------
_NEXT = {"view": ["click", "signup", "error"], "click": ["view", "purchase", "error"], "signup": ["view", "click"],
         "purchase": ["view"], "error": ["view", "click", "signup"]}
_PAIRS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in _NEXT.items() for b in bs) + ") AS n(a, b)"
V["status_log"] = """
SELECT 'u' || user_id AS run_id, CASE WHEN event_id % 40 = 7 THEN 'completed' ELSE event_type END AS status, ts, event_id AS seq FROM events"""
V["status_prev"] = """
SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, seq) AS prev,
  lead(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS left_at,
  min(CASE WHEN status = 'completed' THEN ts END) OVER (PARTITION BY run_id) AS end_ts FROM status_log"""
STATUS = ["status_log", "status_prev"]


def status_log(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("run_id"),
        F.when(F.col("event_id") % 40 == 7, "completed").otherwise(F.col("event_type")).alias("status"),
        "ts", F.col("event_id").alias("seq"),
    )


@query("transition_audit", with_views(V, STATUS, f"""
SELECT run_id, seq, prev AS from_status, status AS to_status FROM status_prev
WHERE (prev IS NOT NULL OR status <> 'view') AND NOT EXISTS (SELECT 1 FROM {_PAIRS} WHERE n.a = prev AND n.b = status)"""))
def transition_audit(spark, sf_dir):
    return logs.transition_audit(status_log(spark, sf_dir), logs.allowed_pairs(spark, _NEXT), initial="view")


@query("status_changes", with_views(V, STATUS, """
SELECT run_id, status, seq FROM status_prev WHERE (end_ts IS NULL OR ts <= end_ts) AND (prev IS NULL OR prev <> status)"""))
def status_changes(spark, sf_dir):
    return logs.status_changes(status_log(spark, sf_dir)).select("run_id", "status", "seq")


@query("stage_durations", with_views(V, STATUS, f"""
SELECT run_id, status, {rnd('sum(epoch_us(left_at) / 1e6 - epoch_us(ts) / 1e6)', 3)} AS seconds, count(*) AS visits
FROM status_prev WHERE left_at IS NOT NULL GROUP BY 1, 2"""))
def stage_durations(spark, sf_dir):
    return logs.stage_durations(status_log(spark, sf_dir)).withColumn("seconds", F.round("seconds", 3))


@query("retry_dlq_split", f"""
SELECT event_id AS job_id, 1 + event_id % 4 AS attempt, CASE WHEN 1 + event_id % 4 < {config.MAX_ATTEMPTS} THEN 'retry' ELSE 'dead_letter' END AS route,
  CASE WHEN 1 + event_id % 4 < {config.MAX_ATTEMPTS} THEN 2 + event_id % 4 END AS next_attempt,
  CASE WHEN 1 + event_id % 4 >= {config.MAX_ATTEMPTS} THEN 'failed with ' || props END AS reason
FROM events WHERE event_type = 'error'""")
def retry_dlq_split(spark, sf_dir):
    failed = v.table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("job_id"), (1 + F.col("event_id") % 4).alias("attempt"),
        F.concat(F.lit("failed with "), F.col("props")).alias("reason"),
    )
    return logs.route_failures(failed)
