"""Population, audiences, panels and quota cells."""

import pytest
from pyspark.sql import functions as F

from sondage import config
from sondage.functions import people
from sondage.operators import feasibility, panel
from sondage.plans import population_queries
from sondage.sources import population as source

AUDIENCE = (
    "audience_id string, age_min int, age_max int, genders array<string>, income_min int, "
    "income_max int, education_min string, states array<string>"
)


@pytest.fixture(scope="module")
def pop(spark):
    i = F.col("id")
    return spark.range(3000).select(
        i.alias("person_id"), (18 + i % 63).cast("int").alias("AGEP"), (1 + i % 2).cast("int").alias("SEX"),
        (1 + i % 26).cast("int").alias("SCHL"), F.when(i % 7 != 0, (i * 37 % 250_000).cast("double")).alias("PINCP"),
        (1 + i % 60).cast("int").alias("ST"), (1 + i % 9).cast("int").alias("RAC1P"), (1 + i % 5).cast("int").alias("MAR"),
        (10 + i % 97).cast("int").alias("PWGTP"),
    ).cache()


def audiences(spark, *rows):
    return spark.createDataFrame(rows, AUDIENCE)


def keep(pdf, lo=18, hi=120, sex=None, inc=(None, None), edu=0, states=()):
    level = pdf.SCHL.map(lambda c: next((config.EDUCATION_RANK[n] for u, n in config.EDUCATION_UPTO if 1 <= c <= u), -1))
    codes = [c for c, s in config.STATES.items() if s in states]
    mask = pdf.AGEP.between(lo, hi)
    mask &= pdf.SEX.isin(sex) if sex else True
    mask &= (pdf.PINCP.fillna(0) >= inc[0]) if inc[0] is not None else True
    mask &= (pdf.PINCP.fillna(0) <= inc[1]) if inc[1] is not None else True
    mask &= (level >= edu) if edu else True
    mask &= pdf.ST.isin(codes) if codes else True
    return pdf[mask]


CASES = {
    "ages": (("ages", 30, 40, ["any"], None, None, "any", []), dict(lo=30, hi=40)),
    "women": (("women", 18, 80, ["female"], None, None, "any", []), dict(hi=80, sex=[2])),
    "both": (("both", 18, 80, ["male", "female"], None, None, "any", []), dict(hi=80, sex=[1, 2])),
    "income": (("income", 18, 80, [], 0, 90_000, "any", []), dict(hi=80, inc=(0, 90_000))),
    "floor": (("floor", 18, 80, [], 1, None, "any", []), dict(hi=80, inc=(1, None))),
    "school": (("school", 18, 80, ["any"], None, None, "college", []), dict(hi=80, edu=3)),
    "states": (("states", 18, 80, ["any"], None, None, "any", ["CA", "ZZ", "TX"]), dict(hi=80, states=("CA", "TX"))),
    "no_state": (("no_state", 18, 80, ["any"], None, None, "any", ["ZZ"]), dict(hi=80)),
    "nobody": (("nobody", 18, 20, ["any"], 900_000, None, "any", []), dict(hi=20, inc=(900_000, None))),
    "mixed": (("mixed", 21, 66, ["female"], 10_000, 120_000, "hs", ["NY", "CA", "FL"]),
              dict(lo=21, hi=66, sex=[2], inc=(10_000, 120_000), edu=1, states=("NY", "CA", "FL"))),
}


def test_filters_joins_and_counts_agree(spark, pop):
    pdf = pop.toPandas()
    table = audiences(spark, *[c[0] for c in CASES.values()])
    members = {r["audience_id"]: r["n"] for r in panel.audience_members(pop, table).groupBy("audience_id").agg(F.count("*").alias("n")).collect()}
    counted = {r["audience_id"]: (r["people"], r["weight"]) for r in feasibility.audience_match_counts(pop, table).collect()}
    names = ("age_min", "age_max", "genders", "income_min", "income_max", "education_min", "states")
    for name, (row, rule) in CASES.items():
        want = keep(pdf, **rule)
        assert members.get(name, 0) == len(want), name
        assert counted[name] == (len(want), want.PWGTP.sum()), name
        assert panel.filter_audience(pop, **dict(zip(names, row[1:]))).count() == len(want), name


def test_equal_bounds_are_looked_up_once(spark, pop):
    pdf = pop.toPandas()
    rows = [(f"{name}{i}", *case[0][1:]) for name, case in CASES.items() for i in range(20)]
    table = audiences(spark, *rows)
    assert feasibility.box_shapes(feasibility.audience_boxes(table)).count() == len(CASES)
    counted = {r["audience_id"]: (r["people"], r["weight"]) for r in feasibility.audience_match_counts(pop, table).collect()}
    assert len(counted) == len(rows)
    for name, (_, rule) in CASES.items():
        want = keep(pdf, **rule)
        assert all(counted[f"{name}{i}"] == (len(want), want.PWGTP.sum()) for i in range(20)), name


def test_sample_size_determinism_and_weights(spark, pop):
    first = [r["person_id"] for r in panel.weighted_sample(pop, 100).collect()]
    again = [r["person_id"] for r in panel.weighted_sample(pop.repartition(13), 100).collect()]
    assert first == again and len(set(first)) == 100
    assert first != [r["person_id"] for r in panel.weighted_sample(pop, 100, seed=1).collect()]
    assert panel.weighted_sample(pop, 10_000).count() == 3000
    big = panel.weighted_sample(pop, 600).agg(F.avg("PWGTP")).first()[0]
    assert big > pop.agg(F.avg("PWGTP")).first()[0] * 1.1
    with pytest.raises(ValueError):
        panel.weighted_sample(pop.drop("PWGTP"), 5)


def test_no_income_is_too_high_to_count(spark, pop):
    rich = pop.limit(1).withColumn("PINCP", F.lit(2e12)).withColumn("AGEP", F.lit(40)).withColumn("person_id", F.lit(-1).cast(pop.schema["person_id"].dataType))
    table = audiences(spark, CASES["ages"][0], CASES["income"][0])
    before = {r["audience_id"]: r["people"] for r in feasibility.audience_match_counts(pop, table).collect()}
    both = pop.unionByName(rich)
    members = {r["audience_id"]: r["count"] for r in panel.audience_members(both, table).groupBy("audience_id").count().collect()}
    after = {r["audience_id"]: r["people"] for r in feasibility.audience_match_counts(both, table).collect()}
    assert after == members and after["ages"] == before["ages"] + 1


def test_panels_hold_the_smallest_keys_of_their_members(spark, pop):
    table = audiences(spark, *[c[0] for c in CASES.values()])
    few = panel.build_panels(pop, table, 25).collect()
    keyed = pop.where("PWGTP > 0").withColumn("_key", panel.sampling_key(F.col("person_id"), F.col("PWGTP"), config.SEED))
    want = {}
    for r in panel.audience_members(keyed, table).orderBy("_key", "person_id").select("audience_id", "person_id").collect():
        want.setdefault(r["audience_id"], []).append(r["person_id"])
    got = {}
    for r in sorted(few, key=lambda r: r["rank"]):
        got.setdefault(r["audience_id"], []).append(r["person_id"])
    assert got == {k: v[:25] for k, v in want.items()}
    assert max(r["rank"] for r in few) == 25
    assert [r["audience_id"] for r in panel.empty_audiences(pop, table).collect()] == ["nobody"]


def test_trait_shares_follow_their_weights(spark):
    draws = spark.range(20_000).select(*[c.alias(k) for k, c in people.traits(F.col("id"), 42).items()])
    for trait, levels in config.TRAITS.items():
        got = {r[trait]: r["count"] / 20_000 for r in draws.groupBy(trait).count().collect()}
        assert all(abs(got[k] - w) < 0.02 for k, w in levels.items())
    unscaled = {"t": {"a": 2.0, "never": 0.0, "b": 6.0}}
    got = {r["x"]: r["count"] for r in spark.range(8000).select(people.draw_trait("t", F.col("id"), 1, unscaled).alias("x")).groupBy("x").count().collect()}
    assert set(got) == {"a", "b"} and abs(got["a"] / 8000 - 0.25) < 0.02


def test_recode_defaults(spark):
    row = spark.createDataFrame([(40, 2, 99, None, 3, 0, 9)], "AGEP int, SEX int, SCHL int, PINCP double, ST int, RAC1P int, MAR int")
    got = row.select(*[c.alias(k) for k, c in people.demographic().items()]).first().asDict()
    assert got == {"age": 40, "sex": "female", "education": "less_than_hs", "income": None, "state": "??", "race": "other", "marital": "never_married"}


def test_prompt_skips_empty_traits_and_has_three_paragraphs(spark):
    columns = "age int, sex string, education string, income bigint, state string, race string, marital string, " + ", ".join(f"{t} string" for t in config.TRAITS)
    row = spark.createDataFrame([(33, "male", "hs", None, "OH", "black", "divorced", "optimizer", "low", "medium", "low", "college", "mobile")], columns)
    text = row.select(people.persona_prompt().alias("p")).first()["p"]
    parts = text.split("\n\n")
    assert len(parts) == 3 and "33-year-old Black man living in OH" in parts[0] and "no reported income" in parts[0]
    assert "  " not in parts[1] and len(parts[1].split(". ")) >= 3


def test_quota_cells_against_direct_filters(spark, pop):
    pdf = pop.toPandas()
    table = audiences(spark, CASES["both"][0], CASES["income"][0], CASES["nobody"][0])
    cells = [{}, {"age_bucket": "65+"}, {"gender": "female", "state": "CA"}, {"income_bracket": "high"}, {"income_bracket": "low"},
             {"colour": "red", "gender": "robot"}, {"age_bucket": "18-24", "income_bracket": "middle", "gender": "male"}]
    rows = [(a, f"c{i}", c, 300) for a in ("both", "income", "nobody") for i, c in enumerate(cells)]
    quotas = spark.createDataFrame(rows, "audience_id string, cell_id string, cell map<string,string>, target_n int")
    out = feasibility.quota_feasibility(feasibility.quota_share(pop, table, quotas)).collect()
    assert len(out) == len(rows)
    states = {u: c for c, u in config.STATES.items()}
    for r in out:
        inside = keep(pdf, **CASES[r["audience_id"]][1])
        cell, part = r["cell"], inside
        if cell.get("age_bucket") in config.AGE_BUCKETS:
            part = part[part.AGEP.between(*config.AGE_BUCKETS[cell["age_bucket"]])]
        if cell.get("gender") in ("male", "female"):
            part = part[part.SEX == (1 if cell["gender"] == "male" else 2)]
        if cell.get("income_bracket"):
            lo, hi = config.INCOME_BRACKETS[cell["income_bracket"]]
            part = part[(part.PINCP >= lo) & (part.PINCP < hi)]
        if cell.get("state"):
            part = part[part.ST == states[cell["state"]]]
        pct = 100 * part.PWGTP.sum() / inside.PWGTP.sum() if len(inside) else 0.0
        assert r["pct"] == pytest.approx(pct), (r["audience_id"], cell)
        assert r["severity"] == ("high" if pct < 1 else "medium" if pct < 5 else "none")
        assert r["estimated_n"] == int(r["pct"] / 100 * 300)


def test_csv_to_stored_population(spark, tmp_path):
    lines = ["SERIALNO,AGEP,SEX,SCHL,PINCP,ST,RAC1P,MAR,PWGTP", "a,30,1,16,1000,6,1,1,10", "b,17,1,16,1,6,1,1,10",
             "c,81,2,16,1,6,1,1,10", "d,,2,16,1,6,1,1,10", "e,50,2,21,,48,2,3,", "f,80,2,21,,48,2,3,7"]
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    clean = source.clean_population(source.read_microdata_csv(spark, str(tmp_path / "raw.csv")))
    source.write_population(clean, str(tmp_path / "pop"))
    back = source.read_population(spark, str(tmp_path / "pop")).orderBy("AGEP").collect()
    assert [tuple(r) for r in back] == [(30, 1, 16, 1000.0, 6, 1, 1, 10), (80, 2, 21, None, 48, 2, 3, 7)]
    assert source.read_population(spark, str(tmp_path / "pop")).schema.simpleString().count("int") == 7


def test_panel_json_sink(spark, pop, tmp_path):
    panels = panel.build_panels(pop, audiences(spark, CASES["ages"][0]), 5)
    panel.write_panel_json(panels, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 5 and set(back.columns) == {"id", "demographic", "response_style", "audience_id"}


def test_sampling_keys_are_drawn_once_and_in_many_tasks(spark):
    """The stored keys are read by all later steps: no condition on their level draws them again."""
    people_rows = population_queries.population(spark, "/root/testdata/sf0.001").coalesce(1)
    out = panel.build_panels(people_rows, population_queries.audiences(spark), 5)
    assert "ln(" not in out._jdf.queryExecution().optimizedPlan().toString().lower() and out.count() > 0
