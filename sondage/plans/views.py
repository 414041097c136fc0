"""The given tables read as survey tables, in Spark and as SQL view texts.

Each function reads a whole given table; VIEWS holds the matching SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.session import literal_table

VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- recorded responses, from events ---------------------------------------
VIEWS["raw_responses"] = """
SELECT CASE WHEN user_id % 5 = 0 THEN 'r1' ELSE 'r0' END AS run_id, 'p' || user_id AS persona_id,
       event_type AS question_id, event_id % 6 AS paraphrase_idx,
       CASE WHEN event_id % 37 = 0 THEN NULL ELSE 1 + floor(value) % 5 END AS value, ts, event_id AS seq
FROM events"""
VIEWS["responses"] = """
SELECT run_id, persona_id, question_id, paraphrase_idx, value FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, persona_id, question_id, paraphrase_idx
                               ORDER BY ts DESC, seq DESC) AS rn FROM raw_responses) WHERE rn = 1"""
_QUESTIONS = [
    (run, qid, pos, kind, n_options)
    for run in ("r0", "r1")
    for pos, (qid, kind, n_options) in enumerate(
        [
            ("click", "likert_5", 0),
            ("view", "likert_7", 0),
            ("purchase", "single_choice", 5),
            ("signup", "top_box" if run == "r0" else "multi_choice", 0 if run == "r0" else 6),
            ("error", "open_end" if run == "r0" else "nps", 0),
            ("exit", "likert_5" if run == "r1" else "open_end", 0),
        ]
    )
]
VIEWS["questions"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', '{q}', {p}, '{k}', {n})" for r, q, p, k, n in _QUESTIONS)
    + ") AS q(run_id, question_id, position, type, n_options)"
)


def raw_from_events(events: DataFrame) -> DataFrame:
    value = F.when(F.col("event_id") % 37 != 0, 1 + F.pmod(F.floor("value"), F.lit(5))).cast("double")
    return events.select(
        F.when(F.col("user_id") % 5 == 0, "r1").otherwise("r0").alias("run_id"),
        F.concat(F.lit("p"), F.col("user_id")).alias("persona_id"),
        F.col("event_type").alias("question_id"),
        (F.col("event_id") % 6).alias("paraphrase_idx"),
        value.alias("value"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_events(table(spark, sf_dir, "events"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sondage.operators.responses import latest_responses

    return latest_responses(raw_responses(spark, sf_dir))


def questions(spark: SparkSession) -> DataFrame:
    names = ("run_id", "question_id", "position", "type", "n_options")
    rows = [dict(zip(names, q)) for q in _QUESTIONS]
    return literal_table(spark, rows, "run_id string, question_id string, position int, type string, n_options int")
