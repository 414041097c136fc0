"""From a clean corpus through planted defects and analyses to scores, as one set of runs."""

import random

from pyspark.sql import functions as F

from sondage.operators import calibrate, inject

SCALES = {"likert_5": (1, 5), "nps": (0, 10), "top_box": (1, 5), "single_choice": (0, 4)}


def test_whole_loop(spark):
    corpus = inject.clean_corpus(spark, spark.range(2).select(F.col("id").alias("idx")))
    questions = corpus.select("survey_id", "question_id", "position", "type", "text")
    rng, rows = random.Random(1), []
    for q in questions.collect():
        lo, hi = SCALES[q["type"]]
        for p in range(120):
            trait = random.Random(p).gauss(0, 1)
            for k in range(6 if p < 60 else 1):
                answer = (lo + hi) / 2 + (hi - lo) / 4 * (0.7 * trait + 0.7 * rng.gauss(0, 1))
                rows.append((q["survey_id"], f"p{p}", q["question_id"], k, float(min(hi, max(lo, round(answer))))))
    recorded = spark.createDataFrame(rows, "survey_id string, persona_id string, question_id string, paraphrase_idx int, value double")
    i = F.col("id")
    people = spark.range(4000).select(
        (18 + i % 48).cast("int").alias("AGEP"), (1 + i % 2).cast("int").alias("SEX"), (1 + i % 24).cast("int").alias("SCHL"),
        (i * 37 % 250_000).cast("double").alias("PINCP"), (1 + i % 50).cast("int").alias("ST"), F.lit(10).alias("PWGTP"))
    audiences = corpus.select("survey_id", "age_min", "age_max").distinct().select(
        F.col("survey_id").alias("audience_id"), "age_min", "age_max", F.array(F.lit("any")).alias("genders"),
        F.lit(None).cast("int").alias("income_min"), F.lit(None).cast("int").alias("income_max"), F.lit("any").alias("education_min"),
        F.array().cast("array<string>").alias("states"))
    quotas = audiences.select("audience_id", F.lit("q0").alias("cell_id"), F.create_map(F.lit("gender"), F.lit("male")).alias("cell"), F.lit(100).alias("target_n"))
    variants = calibrate.variant_questions(questions)
    flags = calibrate.variant_quota_flags(variants, people, audiences, quotas)
    conditions = questions.select("survey_id", "question_id", "position", "type", F.lit(0).alias("n_options"), *[
        F.lit(None).cast("string").alias(c) for c in ("dep_id", "operator", "value")])
    rules = spark.createDataFrame([], "survey_id string, rule_id int, q_id string, if_value_in array<string>, action string")
    screener = calibrate.variant_screener_flags(variants, conditions, rules)
    assert screener.count() == 0
    seen = {(r["run_id"].split("|")[1], r["cell_id"]): r["severity"] for r in flags.collect()}
    assert seen["clean", "q0"] == "none" and ("clean", "planted_obvious") not in seen
    assert seen["infeasible_screener", "planted_obvious"] in ("medium", "high")
    scores, outcomes = calibrate.run_calibration(spark, questions, recorded, flags, screener_flags=screener)
    assert outcomes.count() == 2 * 19
    rows = {(r["level"], r["defect_class"], r["severity"]): r for r in scores.collect()}
    assert len(rows) == 25
    for severity in ("subtle", "moderate", "obvious"):
        assert rows["cell", "leading_wording", severity]["recall"] == 1.0
        assert rows["cell", "redundant_pair", severity]["recall"] == 1.0
    assert rows["class", "infeasible_screener", "ALL"]["recall"] >= 2 / 3 and rows["class", "infeasible_screener", "ALL"]["fp"] == 0
    # no analysis can name these two classes
    assert rows["class", "loaded_language", "ALL"]["tp"] == rows["class", "fatigue_block", "ALL"]["tp"] == 0
    assert 0 < rows["overall", "ALL", "ALL"]["f1"] < 1


def test_runs_without_their_questions(spark):
    questions = inject.clean_corpus(spark, spark.range(3).select(F.col("id").alias("idx"))).select(
        "survey_id", "question_id", "position", "type", "text")
    names = ["run_id", "survey_id", "defect_class", "severity"]
    want = {tuple(r) for r in calibrate.variant_questions(questions).select(*names).distinct().collect()}
    surveys = questions.select("survey_id").distinct().unionByName(spark.createDataFrame([(None,)], "survey_id string"))
    got = [tuple(r) for r in calibrate.variant_runs(surveys).select(*names).collect()]
    assert len(got) == len(want) == 3 * 19 and set(got) == want
