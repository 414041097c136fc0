"""Variant gate, caches, work lists, answer checks and stored tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondage import config
from sondage.functions import hashing, scalars
from sondage.operators import gate, probes
from sondage.sources import snapshots, tables


def unit(v):
    return (v / np.linalg.norm(v)).astype(float)


def group(question, original, variants):
    return [(question, i, v.tolist()) for i, v in enumerate([original, *variants])]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    base = unit(rng.normal(size=384))

    def near(cos):
        noise = rng.normal(size=384)
        noise = unit(noise - noise @ base * base)
        return cos * base + np.sqrt(1 - cos**2) * noise

    rows = group("ok", base, [near(0.9) for _ in range(5)])
    rows += group("random", base, [unit(rng.normal(size=384)) for _ in range(5)])
    rows += group("same", base, [near(0.999) for _ in range(5)])
    rows += group("apart", base, [near(0.86), near(0.86) * 1.0, *[near(0.9) for _ in range(2)], 0.86 * base - np.sqrt(1 - 0.86**2) * (near(0.0))])
    return spark.createDataFrame(rows, "question_id string, idx int, embedding array<double>")


def test_gate_reasons(spark, vectors):
    got = {r["question_id"]: r["reason"] for r in gate.variant_gate(vectors, too_divergent=0.70).collect()}
    assert (got["ok"], got["random"], got["same"]) == ("ok", "equivalence_below_floor", "pair_too_similar")
    assert {r["question_id"]: r["reason"] for r in gate.variant_gate(vectors, too_divergent=0.90).collect()}["ok"] == "pair_too_divergent"
    assert gate.variant_diversity(vectors).where("question_id = 'ok'").count() == 10


def test_fallback_copies(spark, vectors):
    questions = spark.createDataFrame([("ok", "A?"), ("random", "B?")], "question_id string, text string")
    out = gate.fallback_variants(questions, gate.variant_gate(vectors)).collect()
    assert [r["idx"] for r in sorted(out, key=lambda r: r["idx"])] == [1, 2, 3, 4, 5]
    assert {(r["question_id"], r["text"], r["axis"], r["validated"]) for r in out} == {("random", "B?", "fallback_original", False)}


def test_hashes(spark):
    row = spark.range(1).select(hashing.question_hash(F.lit("Ünï?")).alias("h"), hashing.uniform("a", "b").alias("u")).first()
    assert row["h"] == hashlib.sha256("v1|Ünï?".encode()).hexdigest() and 0 < row["u"] < 1
    mean, spread = spark.range(20_000).select(hashing.gaussian("s", F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.03 and abs(spread - 1) < 0.03


def test_first_write_wins(spark):
    cache = spark.createDataFrame([("a", "old")], "k string, v string")
    rows = spark.createDataFrame([("a", "new", 1), ("b", "late", 9), ("b", "early", 2)], "k string, v string, seq int")
    assert sorted(map(tuple, gate.insert_absent(cache, rows, "k", "seq").collect())) == [("a", "old"), ("b", "early")]


def test_cache_sink_only_appends(spark, tmp_path):
    path = str(tmp_path / "cache")
    for rows in ([("a", "old", 1)], [("a", "new", 1), ("b", "late", 9), ("b", "early", 2)], [("b", "again", 0)]):
        tables.append_absent(spark, path, spark.createDataFrame(rows, "k string, v string, seq int"), "k", "seq")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "old"), ("b", "early")]


def test_variants_beyond_the_usual_number_are_judged_and_shown(spark):
    unit = lambda angle: [float(np.cos(angle)), float(np.sin(angle))]
    vectors = [("q", 0, unit(0.0)), *[("q", i, unit(0.55 * (-1) ** i * (1 + i / 50))) for i in range(1, 6)], ("q", 6, unit(np.pi / 2))]
    df = spark.createDataFrame(vectors, "question_id string, idx int, embedding array<double>")
    row = gate.variant_gate(df).first()
    assert row["reason"] == "equivalence_below_floor" and row["min_equivalence"] == pytest.approx(0.0, abs=1e-9)
    assert gate.variant_equivalence(df).count() == 6
    asked = spark.createDataFrame([("q", "Really?")], "question_id string, text string")
    cache = gate.with_hash(asked).select("question_hash", F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct(i.cast("string").alias("text"))).alias("paraphrases"))
    assert [r["shown"] for r in gate.variant_texts(asked, cache).orderBy("idx").collect()] == ["Really?", *"1234567"]


def test_plan_size_and_resume(spark):
    panel = spark.createDataFrame([("r", i, f"p{i}") for i in range(1, 31)], "run_id string, rank int, persona_id string")
    questions = spark.createDataFrame([("r", f"q{i}") for i in range(6)], "run_id string, question_id string")
    plan = probes.probe_plan(panel, questions, baseline_n=20, subpanel_n=7, k=5)
    assert plan.count() == plan.distinct().count() == 6 * (20 + 5 * 7)
    assert probes.remaining(plan, plan.where("paraphrase_idx = 0")).count() == 6 * 5 * 7


@pytest.mark.parametrize("kind,n,payload,problem", [
    ("likert_5", 0, '{"response_value": 5, "confidence": 1}', None),
    ("likert_5", 0, '{"response_value": 6, "confidence": 0.5}', "response_value out of domain"),
    ("likert_5", 0, '{"response_value": 2.5, "confidence": 0.5}', "response_value out of domain"),
    ("nps", 0, '{"response_value": 0, "confidence": 0}', None),
    ("single_choice", 2, '{"response_value": 2, "confidence": 0.5}', "response_value out of domain"),
    ("multi_choice", 3, '{"response_value": [0, 2], "confidence": 0.5}', None),
    ("multi_choice", 3, '{"response_value": [1, 1], "confidence": 0.5}', "response_value out of domain"),
    ("multi_choice", 3, '{"response_value": 1, "confidence": 0.5}', "response_value out of domain"),
    ("open_end", 0, '{"response_value": "fine", "confidence": 0.5}', None),
    ("nps", 0, '{"confidence": 0.5}', "response_value missing"),
    ("nps", 0, '{"response_value": 1}', "confidence missing"),
    ("nps", 0, '{"response_value": 1, "confidence": 1.2}', "confidence out of range"),
])
def test_answer_domain(spark, kind, n, payload, problem):
    rows = spark.createDataFrame([(kind, n, payload)], "type string, n_options int, payload string")
    assert probes.check_answers(rows).first()["problem"] == problem


def test_payload_scalar(spark):
    rows = spark.createDataFrame([('{"response_value": 3, "confidence": 1}',), ("4",), ('{"response_value": "x"}',), ('{"other": 1}',), (None,)], "p string")
    assert [r[0] for r in rows.select(scalars.payload_scalar(F.col("p"))).collect()] == [3.0, 4.0, None, None, None]


def test_question_text(spark):
    rows = spark.createDataFrame([("nps", "Go?", None), ("single_choice", "Pick", ["a", "b"]), ("single_choice", "Pick", None), ("open_end", "Why?", None)],
                                 "type string, text string, options array<string>")
    shown = [r[0] for r in rows.select(probes.render_question(F.col("type"), F.col("text"), F.col("options"))).collect()]
    assert shown == ["Go?\n\nAnswer 0 to 10.", "Pick\n\nChoose by index:\n0. a\n1. b", "Pick", "Why?"]


RESPONSES = "run_id string, persona_id string, question_id string, paraphrase_idx int, value double, ts bigint, seq bigint"


def test_upserts_converge(spark, tmp_path):
    rng = random.Random(2)
    batches = [
        [(f"r{rng.randint(0, 2)}", f"p{rng.randint(0, 9)}", "q", rng.randint(0, 1), float(rng.randint(1, 5)), b, i) for i in range(60)] for b in range(3)
    ]
    path = str(tmp_path / "responses")
    for k, batch in enumerate([*batches, batches[2], batches[0]]):  # a table keeps the number of buckets it began with
        tables.upsert_responses(spark, path, spark.createDataFrame(batch, RESPONSES), buckets=4 + 3 * k)
    assert snapshots.read(spark, path).select("buckets").distinct().count() == 1
    want = {}
    for batch in batches:
        for *key, value, ts, seq in batch:
            want[tuple(key)] = max(want.get(tuple(key), ((-1, -1), 0)), ((ts, seq), value))
    got = {(r["run_id"], r["persona_id"], r["question_id"], r["paraphrase_idx"]): r["value"] for r in tables.read_responses(spark, path).collect()}
    assert got == {k: v[1] for k, v in want.items()}
    plan = tables.read_responses(spark, path, "r1", ["q"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "EqualTo(question_id,q)" in plan


def test_reports_are_replaced_per_run(spark, tmp_path):
    path = str(tmp_path / "reports")
    write = lambda *rows: tables.write_reports(spark.createDataFrame(rows, "run_id string, report string"), path)
    write(("a", "1"), ("b", "1"))
    write(("b", "2"))
    write(("b", "2"))
    assert sorted((r["run_id"], r["report"]) for r in tables.read_reports(spark, path).collect()) == [("a", "1"), ("b", "2")]


def test_price_and_constant_shapes():
    assert sum(len(v) for v in config.TRAITS.values()) == 17 and len(config.STATES) == 51
