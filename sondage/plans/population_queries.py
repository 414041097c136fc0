"""Named queries over the population: audiences, panels and quota feasibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.functions import hashing, people
from sondage.operators import feasibility, panel
from sondage.plans import views as v
from sondage.plans.registry import query, rnd, sql_case, sql_fixed1, sql_list, sql_uniform, with_views
from sondage.session import literal_table
from sondage.sources.population import clean_population

V = v.VIEWS
V["population"] = """
SELECT c_custkey AS person_id, (18 + c_custkey % 63)::INT AS AGEP, (1 + c_custkey % 2)::INT AS SEX,
       (1 + c_custkey % 25)::INT AS SCHL, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal * 25 END AS PINCP,
       c_nationkey AS ST, (1 + c_custkey % 10)::INT AS RAC1P, (1 + c_custkey % 6)::INT AS MAR,
       (10 + c_custkey % 97)::INT AS PWGTP
FROM customer"""
_AUDIENCES = [
    ("all", 18, 80, ["any"], None, None, "any", []),
    ("young_women", 18, 34, ["female"], None, None, "any", []),
    ("earners", 25, 60, [], 20_000, 150_000, "any", ["CA", "NY", "TX", "??"]),
    ("graduates", 21, 65, ["male", "female"], 0, None, "college", []),
    ("south", 30, 70, ["male"], None, 90_000, "hs", ["AL", "FL", "GA", "DC"]),
    ("unknown_state", 18, 65, ["any"], None, None, "any", ["ZZ"]),
    ("nobody", 18, 20, ["any"], 900_000, None, "graduate", []),
]
_AUDIENCE_SCHEMA = (
    "audience_id string, age_min int, age_max int, genders array<string>, income_min int, "
    "income_max int, education_min string, states array<string>"
)
_CELLS = [
    (a, f"q{i}", cell, target)
    for a in [x[0] for x in _AUDIENCES]
    for i, (cell, target) in enumerate(
        [
            ({"age_bucket": "18-24"}, 200),
            ({"age_bucket": "65+", "gender": "female"}, 150),
            ({"income_bracket": "middle", "state": "CA"}, 100),
            ({"income_bracket": "high"}, 400),
            ({"gender": "robot", "age_bucket": "25-34"}, 80),
            ({"income_bracket": "low", "gender": "male", "plan": "gold"}, 300),
            ({"state": "VT"}, 50),
        ]
    )
]


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return sql_list(value) + "::VARCHAR[]"
    return f"'{value}'" if isinstance(value, str) else str(value)


def _numeric(audience) -> tuple:
    name, lo, hi, genders, inc_min, inc_max, education, states = audience
    sexes = None if not genders or "any" in genders else [c for g, c in (("male", 1), ("female", 2)) if g in genders]
    codes = [c for c, usps in config.STATES.items() if usps in states] or None
    return name, lo, hi, sexes, codes, inc_min, inc_max, config.EDUCATION_MIN[education]


_list = lambda x: "NULL::INT[]" if x is None else sql_list(x) + "::INT[]"
_num = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
V["audiences"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {lo}, {hi}, {_list(s)}, {_list(c)}, {_num(a)}, {_num(b)}, {e})"
    for n, lo, hi, s, c, a, b, e in map(_numeric, _AUDIENCES)
) + ") AS a(audience_id, age_lo, age_hi, sexes, states, inc_min, inc_max, edu_min)"


def _cell_row(a, i, cell, target) -> str:
    age = config.AGE_BUCKETS.get(cell.get("age_bucket"))
    inc = config.INCOME_BRACKETS.get(cell.get("income_bracket"))
    sex = {"male": 1, "female": 2}.get(cell.get("gender"))
    st = {u: c for c, u in config.STATES.items()}.get(cell.get("state"))
    null = lambda x: "NULL::INT" if x is None else str(x)
    text = ",".join(f"{k}={cell[k]}" for k in sorted(cell))
    lo, hi = age or (None, None)
    ilo, ihi = inc or (None, None)
    return f"('{a}', '{i}', '{text}', {target}, {null(lo)}, {null(hi)}, {null(sex)}, {null(ilo)}, {null(ihi)}, {null(st)})"


V["cells"] = "SELECT * FROM (VALUES " + ", ".join(_cell_row(*c) for c in _CELLS) + (
    ") AS c(audience_id, cell_id, cell, target_n, c_lo, c_hi, c_sex, c_ilo, c_ihi, c_st)"
)
_EDU = "(CASE " + " ".join(
    f"WHEN SCHL BETWEEN 1 AND {upto} THEN {config.EDUCATION_RANK[name]}" for upto, name in config.EDUCATION_UPTO
) + " END)"
V["members"] = f"""
SELECT a.audience_id, p.* FROM population p JOIN audiences a ON p.AGEP BETWEEN a.age_lo AND a.age_hi
 AND (a.sexes IS NULL OR list_contains(a.sexes, p.SEX)) AND (a.states IS NULL OR list_contains(a.states, p.ST))
 AND (a.inc_min IS NULL OR coalesce(p.PINCP, 0) >= a.inc_min) AND (a.inc_max IS NULL OR coalesce(p.PINCP, 0) <= a.inc_max)
 AND (a.edu_min = 0 OR {_EDU} >= a.edu_min)"""
MEMBERS = ["population", "audiences", "members"]
V["shares_pct"] = """
SELECT c.*, coalesce(m.total, 0) AS total,
  CASE WHEN coalesce(m.total, 0) > 0 THEN coalesce((
    SELECT sum(x.PWGTP) FROM members x WHERE x.audience_id = c.audience_id
     AND (c.c_lo IS NULL OR x.AGEP BETWEEN c.c_lo AND c.c_hi) AND (c.c_sex IS NULL OR x.SEX = c.c_sex)
     AND (c.c_ilo IS NULL OR (x.PINCP >= c.c_ilo AND x.PINCP < c.c_ihi)) AND (c.c_st IS NULL OR x.ST = c.c_st)
  ), 0) / m.total * 100 ELSE 0.0 END AS pct
FROM cells c LEFT JOIN (SELECT audience_id, sum(PWGTP)::DOUBLE AS total FROM members GROUP BY 1) m USING (audience_id)"""
SHARES = [*MEMBERS, "cells", "shares_pct"]


def population(spark, sf_dir):
    key = F.col("c_custkey")
    code = lambda base, mod: (base + key % mod).cast("int")
    return v.table(spark, sf_dir, "customer").select(
        key.alias("person_id"), code(18, 63).alias("AGEP"), code(1, 2).alias("SEX"), code(1, 25).alias("SCHL"),
        F.when(key % 17 != 0, F.col("c_acctbal") * 25).alias("PINCP"), F.col("c_nationkey").alias("ST"),
        code(1, 10).alias("RAC1P"), code(1, 6).alias("MAR"), code(10, 97).alias("PWGTP"),
    )


def audiences(spark):
    names = [c.split()[0] for c in _AUDIENCE_SCHEMA.split(", ")]
    return literal_table(spark, [dict(zip(names, a)) for a in _AUDIENCES], _AUDIENCE_SCHEMA)


def cells(spark):
    names = ("audience_id", "cell_id", "cell", "target_n")
    rows = [dict(zip(names, c)) for c in _CELLS]
    return literal_table(spark, rows, "audience_id string, cell_id string, cell map<string,string>, target_n int")


def cell_text(df):
    entries = F.transform(F.array_sort(F.map_keys("cell")), lambda k: F.concat(k, F.lit("="), F.col("cell")[k]))
    return df.withColumn("cell", F.array_join(entries, ","))


@query("pop_prepare", """
SELECT c_custkey AS person_id, c_custkey % 95 AS AGEP, 1 + c_custkey % 2 AS SEX, 1 + c_custkey % 24 AS SCHL,
       CASE WHEN c_custkey % 17 <> 0 THEN (c_custkey * 8)::FLOAT END AS PINCP, c_nationkey AS ST,
       1 + c_custkey % 9 AS RAC1P, 1 + c_custkey % 5 AS MAR, 10 + c_custkey % 97 AS PWGTP
FROM customer WHERE c_custkey % 41 <> 0 AND c_custkey % 43 <> 0 AND c_custkey % 95 BETWEEN 18 AND 80""")
def pop_prepare(spark, sf_dir):
    key = F.col("c_custkey")
    raw = v.table(spark, sf_dir, "customer").select(
        key.alias("person_id"), F.when(key % 41 != 0, key % 95).alias("AGEP"), (1 + key % 2).alias("SEX"),
        (1 + key % 24).alias("SCHL"), F.when(key % 17 != 0, key * 8.0).otherwise(F.lit(float("nan"))).alias("PINCP"),
        F.col("c_nationkey").alias("ST"), (1 + key % 9).alias("RAC1P"), (1 + key % 5).alias("MAR"),
        F.when(key % 43 != 0, 10 + key % 97).alias("PWGTP"),
    )
    return clean_population(raw)


@query("audience_filter", with_views(V, MEMBERS, "SELECT person_id FROM members WHERE audience_id = 'earners'"))
def audience_filter(spark, sf_dir):
    kept = panel.filter_audience(
        population(spark, sf_dir), age_min=25, age_max=60, genders=[], income_min=20_000, income_max=150_000,
        states=["CA", "NY", "TX", "??"],
    )
    return kept.select("person_id")


@query("audience_match_counts", with_views(V, MEMBERS, """
SELECT a.audience_id, coalesce(sum(m.PWGTP), 0)::DOUBLE AS weight, count(m.person_id) AS people
FROM audiences a LEFT JOIN members m USING (audience_id) GROUP BY 1"""))
def audience_match_counts(spark, sf_dir):
    return feasibility.audience_match_counts(population(spark, sf_dir), audiences(spark))


_EDU_NAME = "(CASE " + " ".join(f"WHEN SCHL BETWEEN 1 AND {u} THEN '{n}'" for u, n in config.EDUCATION_UPTO) + " ELSE 'less_than_hs' END)"
DEMOGRAPHIC = f"""AGEP AS age, CASE WHEN SEX = 2 THEN 'female' ELSE 'male' END AS sex, {_EDU_NAME} AS education,
 trunc(PINCP)::BIGINT AS income, {sql_case('ST', config.STATES, "'??'")} AS state,
 {sql_case('RAC1P', config.RACE, "'other'")} AS race, {sql_case('MAR', config.MARITAL, "'never_married'")} AS marital"""


@query("demographic_recode", with_views(V, ["population"], f"SELECT person_id, {DEMOGRAPHIC} FROM population"))
def demographic_recode(spark, sf_dir):
    return population(spark, sf_dir).select("person_id", *[c.alias(k) for k, c in people.demographic().items()])


def _sql_trait(trait: str, ident: str) -> str:
    u, total, out = sql_uniform(str(config.SEED), ident, f"'{trait}'"), 0.0, ""
    levels = list(config.TRAITS[trait].items())
    weight = sum(w for _, w in levels)
    for level, w in levels[:-1]:
        total += w / weight
        out += f" WHEN {u} < {total!r}::DOUBLE THEN '{level}'"
    return f"(CASE{out} ELSE '{levels[-1][0]}' END) AS {trait}"


_TRAITS = lambda ident: ", ".join(_sql_trait(t, ident) for t in config.TRAITS)
V["personas"] = f"SELECT person_id, {DEMOGRAPHIC}, {_TRAITS('person_id')} FROM population"
_BAND = "(CASE WHEN income IS NULL THEN '" + config.PROMPT_INCOME_NONE + "' " + " ".join(
    f"WHEN income < {x} THEN '{n}'" for x, n in config.PROMPT_INCOME
) + f" ELSE '{config.PROMPT_INCOME_TOP}' END)"


def personas(spark, sf_dir):
    base = population(spark, sf_dir)
    columns = people.demographic() | people.traits(F.col("person_id"), config.SEED)
    return base.select("person_id", *[c.alias(k) for k, c in columns.items()])


@query("trait_assign", with_views(V, ["population", "personas"], f"SELECT person_id, {', '.join(config.TRAITS)} FROM personas"))
def trait_assign(spark, sf_dir):
    return personas(spark, sf_dir).select("person_id", *config.TRAITS)


@query("income_band", with_views(V, ["population", "personas"], f"SELECT person_id, {_BAND} AS band FROM personas"))
def income_band(spark, sf_dir):
    return personas(spark, sf_dir).select("person_id", people.income_band(F.col("income")).alias("band"))


_STYLE = "concat_ws(' ', " + ", ".join(f"nullif({sql_case(t, w)}, '')" for t, w in config.PROMPT_TRAITS.items()) + ")"
_FRAME = config.PROMPT_FRAMING.replace("'", "''")


@query("persona_prompt", with_views(V, ["population", "personas"], f"""
SELECT person_id, concat_ws(chr(10) || chr(10),
  'You are a ' || age || '-year-old ' || {sql_case('race', config.PROMPT_RACE)}
  || CASE WHEN sex = 'female' THEN ' woman' ELSE ' man' END || ' living in ' || state || '. You '
  || {sql_case('education', config.PROMPT_EDUCATION)} || ' and are ' || {sql_case('marital', config.PROMPT_MARITAL)}
  || '. You are in the ' || {_BAND} || ' bracket.', {_STYLE}, '{_FRAME}') AS prompt FROM personas"""))
def persona_prompt(spark, sf_dir):
    return personas(spark, sf_dir).select("person_id", people.persona_prompt().alias("prompt"))


@query("weighted_sample", with_views(V, ["population"], f"""
SELECT person_id, AGEP, PWGTP FROM population ORDER BY -ln({sql_uniform(str(config.SEED), 'person_id')}) / PWGTP, person_id LIMIT 200"""))
def weighted_sample(spark, sf_dir):
    return panel.weighted_sample(population(spark, sf_dir), 200).select("person_id", "AGEP", "PWGTP")


_IDENT = "audience_id || '|' || person_id"
PANEL_SIZE = 40
V["panel_rows"] = f"""
SELECT audience_id, rank, person_id,
  'p_' || printf('%04d', rank - 1) || '_' || substr(md5('{config.SEED}|' || audience_id || '|' || person_id), 1, 8) AS persona_id,
  {DEMOGRAPHIC}, {_TRAITS(_IDENT)}
FROM (SELECT *, row_number() OVER (PARTITION BY audience_id
        ORDER BY -ln({sql_uniform(str(config.SEED), 'person_id')}) / PWGTP, person_id) AS rank FROM members)
WHERE rank <= {PANEL_SIZE}"""


@query("panel_build", with_views(V, [*MEMBERS, "panel_rows"], "SELECT * FROM panel_rows"))
def panel_build(spark, sf_dir):
    return panel.build_panels(population(spark, sf_dir), audiences(spark), PANEL_SIZE)


@query("quota_share", with_views(V, SHARES, f"SELECT audience_id, cell_id, cell, target_n, {rnd('pct')} AS pct FROM shares_pct"))
def quota_share(spark, sf_dir):
    out = feasibility.quota_share(population(spark, sf_dir), audiences(spark), cells(spark))
    return cell_text(out).drop("audience_weight").withColumn("pct", F.round("pct", 6))


QUOTA_FLAG = f"""audience_id, cell_id, cell, target_n, pct,
 CASE WHEN pct < {config.QUOTA_INFEASIBLE_PCT} THEN 'high' WHEN pct < {config.QUOTA_MARGINAL_PCT} THEN 'medium' ELSE 'none' END AS severity,
 floor(pct / 100 * target_n)::BIGINT AS estimated_n,
 CASE WHEN total <= 0 THEN 'audience matches nobody' WHEN pct < {config.QUOTA_MARGINAL_PCT}
      THEN 'only ' || {sql_fixed1('pct')} || '% fits the cell' ELSE {sql_fixed1('pct')} || '% fits the cell' END AS summary"""
V["quota_flags"] = f"SELECT {QUOTA_FLAG} FROM shares_pct"


@query("quota_feasibility", with_views(V, [*SHARES, "quota_flags"], f"SELECT * EXCLUDE (pct), {rnd('pct')} AS pct FROM quota_flags"))
def quota_feasibility(spark, sf_dir):
    shares = feasibility.quota_share(population(spark, sf_dir), audiences(spark), cells(spark))
    return cell_text(feasibility.quota_feasibility(shares)).withColumn("pct", F.round("pct", 6))


V["cell_entries"] = """
SELECT 's' || c_custkey AS audience_id, 'c' || c_nationkey AS cell_id,
  unnest([{'key': 'age_bucket', 'value': CASE WHEN c_custkey % 7 = 0 THEN '90-99' ELSE '18-24' END},
          {'key': 'state', 'value': CASE WHEN c_custkey % 11 = 0 THEN 'ZZ' ELSE 'CA' END},
          {'key': 'gender', 'value': CASE WHEN c_custkey % 13 = 0 THEN 'any' ELSE 'male' END},
          {'key': CASE WHEN c_custkey % 5 = 0 THEN 'segment' ELSE 'income_bracket' END,
           'value': CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE 'low' END}]) AS e FROM customer"""


@query("quota_unknown_keys", with_views(V, ["cell_entries"], f"""
SELECT audience_id, cell_id, e.key AS key, e.value AS value,
  CASE WHEN e.key IN ('age_bucket', 'gender', 'income_bracket', 'state') THEN 'unknown_value' ELSE 'unknown_key' END AS reason
FROM cell_entries WHERE NOT coalesce(CASE e.key WHEN 'age_bucket' THEN list_contains({sql_list(config.AGE_BUCKETS)}, e.value)
  WHEN 'gender' THEN e.value IN ('male', 'female') WHEN 'income_bracket' THEN list_contains({sql_list(config.INCOME_BRACKETS)}, e.value)
  WHEN 'state' THEN list_contains({sql_list(config.STATES.values())}, e.value) END, false)"""))
def quota_unknown_keys(spark, sf_dir):
    key = F.col("c_custkey")
    rows = v.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("s"), key).alias("audience_id"), F.concat(F.lit("c"), F.col("c_nationkey")).alias("cell_id"),
        F.create_map(
            F.lit("age_bucket"), F.when(key % 7 == 0, "90-99").otherwise("18-24"),
            F.lit("state"), F.when(key % 11 == 0, "ZZ").otherwise("CA"),
            F.lit("gender"), F.when(key % 13 == 0, "any").otherwise("male"),
            F.when(key % 5 == 0, "segment").otherwise("income_bracket"),
            F.when(key % 3 == 0, F.lower("c_mktsegment")).otherwise("low"),
        ).alias("cell"),
    )
    return feasibility.unknown_cell_entries(rows)


V["customer_audiences"] = """
SELECT c_custkey AS audience_id, 18 + c_custkey % 20 AS age_min, 50 + c_custkey % 30 AS age_max,
  CASE WHEN c_custkey % 3 = 0 THEN ['any'] ELSE ['male', 'female'] END AS genders,
  CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END AS income_min, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 90 END AS income_max,
  CASE WHEN c_custkey % 5 = 0 THEN 'hs' ELSE 'any' END AS education_min,
  CASE WHEN c_custkey % 6 = 0 THEN ['TX', 'CA'] ELSE []::VARCHAR[] END AS states FROM customer"""
_STYLES = ";".join(
    f"{t}:" + ",".join(f"{k}={w}" for k, w in sorted(levels.items())) for t, levels in sorted(config.TRAITS.items())
)


@query("audience_hash", with_views(V, ["customer_audiences"], f"""
SELECT audience_id, sha256(concat_ws('|', coalesce(age_min::VARCHAR, 'null'), coalesce(age_max::VARCHAR, 'null'),
  '[' || array_to_string(list_sort(genders), ',') || ']', coalesce(income_min::VARCHAR, 'null'),
  coalesce(income_max::VARCHAR, 'null'), education_min, '[' || array_to_string(list_sort(states), ',') || ']',
  CASE WHEN audience_id % 10 = 0 THEN 'CA' ELSE 'US' END, CASE WHEN audience_id % 8 = 0 THEN '[gamer,parent]' WHEN audience_id % 8 = 1 THEN 'null' ELSE '[]' END,
  '{_STYLES}', '1000', '42', 'v1')) AS audience_hash FROM customer_audiences"""))
def audience_hash(spark, sf_dir):
    key = F.col("c_custkey")
    none = F.array().cast("array<string>")
    digest = hashing.audience_hash(
        18 + key % 20, 50 + key % 30,
        F.when(key % 3 == 0, F.array(F.lit("any"))).otherwise(F.array(F.lit("male"), F.lit("female"))),
        F.when(key % 2 == 0, key * 10), F.when(key % 4 == 0, key * 90),
        F.when(key % 5 == 0, "hs").otherwise("any"),
        F.when(key % 6 == 0, F.array(F.lit("TX"), F.lit("CA"))).otherwise(none), n=1000, seed=42,
        country=F.when(key % 10 == 0, "CA").otherwise("US"),
        tags=F.when(key % 8 == 0, F.array(F.lit("parent"), F.lit("gamer"))).when(key % 8 != 1, none),
    )
    return v.table(spark, sf_dir, "customer").select(key.alias("audience_id"), digest.alias("audience_hash"))
