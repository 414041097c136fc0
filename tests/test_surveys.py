"""Survey documents and skip logic."""

import json
import random

import pytest

from sondage.operators import skiplogic
from sondage.plans.catalog import QUERIES
from sondage.sources import surveys

SCHEMA = "survey_id string, question_id string, position int, type string, n_options int, dep_id string, operator string, value string"


def survey(**changes):
    doc = {
        "id": "s1", "brief": {"objectives": ["learn"], "audience_criteria": "adults"}, "audience": {},
        "questions": [{"id": "Q1", "type": "likert_5", "text": "Rate"}, {"id": "Q2", "type": "nps", "text": "Recommend?",
                       "conditional_on": {"q_id": "Q1", "operator": "==", "value": 3}}],
    }
    return json.dumps({**doc, **changes})


def docs(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "slug string, doc string")


@pytest.mark.parametrize("text,reason", [
    (survey(), None),
    (survey(extra=1), "unknown top-level field"),
    (survey(questions=[{"id": "a", "type": "slider", "text": "x"}]), "unknown question type"),
    (survey(questions=[{"id": "a", "type": "nps", "text": "x", "hue": 1}]), "unknown question field"),
    (survey(questions=[{"id": "a", "type": "nps", "text": "x", "conditional_on": {"q_id": "b", "operator": "~", "value": 1}}]), "bad condition"),
    (survey(screener={"rules": [{"q_id": "Q1", "if_value_in": [1], "action": "drop"}]}), "bad screener rule"),
    (survey(audience={"genders": ["unknown"]}), "unknown gender"),
    (survey(audience={"age_range": {"min": -1, "max": 50}}), "age out of range"),
    (survey(audience={"education_min": "phd"}), "unknown education level"),
    (survey(brief=None), "missing required field"),
    ("{not json", "not a JSON object"),
])
def test_validation(spark, text, reason):
    assert surveys.validate(docs(spark, text)).first()["reject_reason"] == reason


def test_documents_are_spread_and_parsed_once(spark):
    """The condition on validity stays above the parser, and one file of documents is not one task."""
    good = surveys.validate(docs(spark, *[survey(id=f"s{i}") for i in range(40)]).coalesce(1)).where("valid")
    plan = surveys.flatten_questions(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.index("Filter") < plan.index("from_json(StructField(id")
    assert good.rdd.getNumPartitions() > 1 and good.count() == 40


def test_files_flatten_with_defaults_and_typed_values(spark, tmp_path):
    rules = [{"q_id": "Q1", "if_value_in": [1, "1", True], "action": "terminate"}, {"q_id": "Q1", "action": "qualify"}]
    (tmp_path / "b_second.json").write_text(survey(id="s2", screener={"rules": rules}, quotas=[{"cell": {"gender": "male"}, "target_n": 9}]))
    (tmp_path / "a_first.json").write_text(survey())
    good = surveys.validate(surveys.read_survey_files(spark, str(tmp_path))).where("valid")
    assert sorted(r["slug"] for r in surveys.listing(good).collect()) == ["a_first", "b_second"]
    rows = {(r["survey_id"], r["question_id"]): r for r in surveys.flatten_questions(good).collect()}
    assert rows["s2", "Q2"]["position"] == 1 and rows["s2", "Q2"]["value"] == "3" and rows["s2", "Q1"]["n_options"] == 0
    assert [r["if_value_in"] for r in surveys.flatten_rules(good).orderBy("rule_id").collect()] == [["1", '"1"', "true"], None]
    assert surveys.flatten_quotas(good).first()["cell"] == {"gender": "male"}
    audience = surveys.flatten_audiences(good).first()
    assert (audience["age_min"], audience["age_max"], audience["genders"]) == (18, 65, ["any"])


def test_flattened_questions_keep_every_field(spark):
    """Scale labels, axes, the stimulus and the options themselves, besides type, text and condition."""
    full = {"id": "Q1", "type": "likert_5", "text": "Rate", "options": ["a", "b"], "scale_labels": ["low", "high"], "evaluation_axes": ["taste"],
            "stimulus": {"kind": "ad", "description": "a poster", "url": "u"}}
    plain = {"id": "Q2", "type": "nps", "text": "Recommend?", "scale_labels": [], "stimulus": {"kind": "concept", "description": "an idea"}}
    good = surveys.validate(docs(spark, survey(questions=[full, plain, {"id": "Q3", "type": "nps", "text": "x"}]))).where("valid")
    fields = ["options", "n_options", "scale_labels", "evaluation_axes", "stimulus_kind", "stimulus_description", "stimulus_url"]
    assert [tuple(r) for r in surveys.flatten_questions(good).orderBy("position").select(fields).collect()] == [
        (["a", "b"], 2, ["low", "high"], ["taste"], "ad", "a poster", "u"), (None, 0, [], None, "concept", "an idea", None), (None, 0, *[None] * 5)]


def test_survey_flatten_returns_every_field(spark):
    rows = QUERIES["survey_flatten"](spark, "/root/testdata/sf0.001")
    lists = {"options", "scale_labels", "evaluation_axes", "stimulus_kind", "stimulus_description", "stimulus_url"}
    assert lists < set(rows.columns) and {r["options"] for r in rows.select("options").distinct().collect()} == {None, '["x","y"]'}


def table(spark, *rows):
    return spark.createDataFrame([("s", *r) for r in rows], SCHEMA)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_clean_survey_has_no_flags(spark):
    rows = table(spark, ("a", 0, "likert_5", 0, None, None, None), ("b", 1, "nps", 0, "a", "==", "3"))
    rules = spark.createDataFrame([], "survey_id string, rule_id int, q_id string, if_value_in array<string>, action string")
    assert skiplogic.skip_logic_flags(rows, rules).count() == 0


def test_self_loop_forward_reference_and_unknown_dependency(spark):
    rows = table(
        spark, ("a", 0, "likert_5", 0, "a", "==", "1"), ("b", 1, "likert_5", 0, "c", "==", "1"),
        ("c", 2, "likert_5", 0, None, None, None), ("d", 3, "likert_5", 0, "gone", "==", "1"),
    )
    assert found(skiplogic.self_loops(rows), "question_id") == [("a",)]
    assert found(skiplogic.unreachable(rows), "question_id", "flag") == [
        ("a", "unreachable_question"), ("b", "unreachable_question"), ("d", "dead_branch")]
    assert skiplogic.cycles(rows).count() == 0


@pytest.mark.parametrize("kind,n,value,fits", [
    ("likert_5", 0, "5", True), ("likert_5", 0, "99", False), ("top_box", 0, "0", False), ("likert_7", 0, "7", True),
    ("nps", 0, "0", True), ("nps", 0, "11", False), ("likert_5", 0, "true", True), ("likert_5", 0, '"3"', False),
    ("likert_5", 0, "3.0", False), ("single_choice", 3, "2", True), ("single_choice", 3, "3", False), ("single_choice", 0, "0", False),
    ("multi_choice", 3, "[0, 2]", True), ("multi_choice", 3, "[3]", False), ("multi_choice", 3, "1", False), ("multi_choice", 3, "[]", True),
    ("open_end", 0, '"x"', True), ("likert_5", 0, None, False),
])
def test_condition_values(spark, kind, n, value, fits):
    rows = table(spark, ("a", 0, kind, n, None, None, None), ("b", 1, "nps", 0, "a", "!=", value))
    assert skiplogic.impossible_conditions(rows).count() == (0 if fits else 1)
    listed = table(spark, ("a", 0, kind, n, None, None, None), ("b", 1, "nps", 0, "a", "in", value))
    assert skiplogic.impossible_conditions(listed).count() == 0


def test_cycles_equal_pointer_walk(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for s in range(30):
        n = rng.randint(2, 40)
        dep = {i: rng.randrange(n) for i in range(n) if rng.random() < 0.9}
        rows += [(f"s{s}", f"{i:03d}", i, "nps", 0, None if i not in dep else f"{dep[i]:03d}", "==", "1") for i in range(n)]
        for i in range(n):
            path, at = [i], dep.get(i)
            while at is not None and at not in path:
                path.append(at)
                at = dep.get(at)
            if at == i and len(path) > 1:
                want.add((f"s{s}", f"{min(path):03d}", f"{i:03d}", path.index(min(path))))
    got = skiplogic.cycles(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(r["survey_id"], r["cycle_id"], r["question_id"], r["step"]) for r in got} == want and want


def test_contradicting_rules(spark):
    rows = [("s", 0, "q", ["1", "2", "2"], "terminate"), ("s", 1, "q", ["2", "3"], "qualify"), ("s", 2, "q", None, "qualify"),
            ("s", 3, "q", ["9"], "qualify"), ("s", 4, "p", ["2"], "qualify"), ("s", 5, "q", ["1", "2"], "terminate")]
    rules = spark.createDataFrame(rows, "survey_id string, rule_id int, q_id string, if_value_in array<string>, action string")
    assert found(skiplogic.rule_contradictions(rules), "terminate_rule", "qualify_rule", "overlap") == [(0, 1, ["2"]), (5, 1, ["2"])]
