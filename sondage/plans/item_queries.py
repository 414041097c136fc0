"""Named queries over item scores: redundancy and discrimination."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondage import config
from sondage.operators import irt, redundancy
from sondage.plans import views as v
from sondage.plans.fit_sql import add_fit_views
from sondage.plans.registry import query, rnd, sql_bits, sql_signed2, with_views
from sondage.session import literal_table

V = v.VIEWS
V["item_scores"] = """
SELECT 'r' || p % 3 AS run_id, 'c' || p AS persona_id, p, item, v AS value FROM (
  SELECT o_custkey AS p, l_linenumber AS item, l_quantity AS v,
         row_number() OVER (PARTITION BY o_custkey, l_linenumber
           ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1"""
V["item_table"] = f"""
SELECT run_id, persona_id, item AS position, value FROM item_scores UNION ALL
SELECT run_id, persona_id, 8, value + {sql_bits("'near'", "p")} % 5 FROM item_scores WHERE item = 1 UNION ALL
SELECT run_id, persona_id, 9, 60 - value + {sql_bits("'mirror'", "p")} % 20 FROM item_scores WHERE item = 2 UNION ALL
SELECT run_id, persona_id, 10, value + {sql_bits("'loose'", "p")} % 40 FROM item_scores WHERE item = 3"""
V["rank_pairs"] = """
SELECT a.run_id, a.position AS pos_a, b.position AS pos_b, a.value AS va, b.value AS vb,
       rank() OVER wa + (count(*) OVER ea - 1) / 2 AS ra, rank() OVER wb + (count(*) OVER eb - 1) / 2 AS rb
FROM item_table a JOIN item_table b ON a.run_id = b.run_id AND a.persona_id = b.persona_id AND a.position < b.position
WINDOW wa AS (PARTITION BY a.run_id, a.position, b.position ORDER BY a.value),
       wb AS (PARTITION BY a.run_id, a.position, b.position ORDER BY b.value),
       ea AS (PARTITION BY a.run_id, a.position, b.position, a.value),
       eb AS (PARTITION BY a.run_id, a.position, b.position, b.value)"""
V["pair_stats"] = """
SELECT run_id, pos_a, pos_b, count(*) AS n_personas, corr(va, vb) AS pearson, corr(ra, rb) AS spearman
FROM rank_pairs GROUP BY 1, 2, 3 HAVING count(*) >= 20 AND stddev_pop(va) > 0 AND stddev_pop(vb) > 0"""
PAIRS = ["item_scores", "item_table", "rank_pairs", "pair_stats"]
V["medians"] = "SELECT run_id, item, median(value) AS med FROM item_scores GROUP BY 1, 2"
V["binary_items"] = """
SELECT run_id, persona_id, p, item, CASE WHEN value > med THEN 1 ELSE 0 END AS y
FROM item_scores JOIN medians USING (run_id, item)"""
BINARY = ["item_scores", "medians", "binary_items"]


def item_scores(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").join(
        v.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    newest = F.max(F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity"))
    return (
        lines.groupBy("o_custkey", "l_linenumber")
        .agg(newest.alias("z"))
        .select(
            F.concat(F.lit("r"), F.col("o_custkey") % 3).alias("run_id"),
            F.concat(F.lit("c"), F.col("o_custkey")).alias("persona_id"),
            F.col("o_custkey").alias("p"),
            F.col("l_linenumber").cast("string").alias("item"),
            F.col("z.l_quantity").alias("value"),
        )
    )


def item_table(spark, sf_dir):
    """Item scores plus three derived items that copy, mirror or loosely follow others."""
    from sondage.functions.hashing import draw_bits

    p, value = F.col("p"), F.col("value")
    extra = (
        F.when(F.col("item") == "1", F.struct(F.lit(8).alias("position"), (value + draw_bits("near", p) % 5).alias("value")))
        .when(F.col("item") == "2", F.struct(F.lit(9).alias("position"), (60 - value + draw_bits("mirror", p) % 20).alias("value")))
        .when(F.col("item") == "3", F.struct(F.lit(10).alias("position"), (value + draw_bits("loose", p) % 40).alias("value")))
    )
    own = F.struct(F.col("item").cast("int").alias("position"), value.alias("value"))
    rows = item_scores(spark, sf_dir).select("run_id", "persona_id", F.explode(F.array(own, extra)).alias("x"))
    return rows.where("x IS NOT NULL").select("run_id", "persona_id", "x.position", "x.value")


def item_questions(spark):
    rows = [{"run_id": r, "question_id": f"L{i}", "position": i} for r in ("r0", "r1", "r2") for i in range(1, 11)]
    return literal_table(spark, rows, "run_id string, question_id string, position int")


def binary_items(spark, sf_dir):
    return irt.dichotomize(item_scores(spark, sf_dir))


@query(
    "redundancy_pairs",
    with_views(V, PAIRS, f"SELECT run_id, pos_a, pos_b, n_personas, {rnd('pearson')} AS pearson, {rnd('spearman')} AS spearman FROM pair_stats"),
)
def redundancy_pairs(spark, sf_dir):
    pairs = redundancy.redundancy_pairs(item_table(spark, sf_dir))
    return pairs.withColumn("pearson", F.round("pearson", 6)).withColumn("spearman", F.round("spearman", 6))


@query(
    "redundancy_flags",
    with_views(V, PAIRS, f"""
    SELECT run_id, 'L' || pos_a AS q_id_a, 'L' || pos_b AS q_id_b, {rnd('pearson')} AS pearson,
           {rnd('spearman')} AS spearman, n_personas,
           CASE WHEN abs(pearson) >= {config.PEARSON_HIGH} THEN 'high' ELSE 'medium' END AS severity,
           'L' || pos_a || ' and L' || pos_b || CASE WHEN abs(pearson) >= {config.PEARSON_HIGH}
             THEN ' measure ' || CASE WHEN pearson > 0 THEN 'the same' ELSE 'opposite' END || ' thing ('
                  || {sql_signed2('pearson')} || '); drop one'
             ELSE ' are correlated ' || {sql_signed2('pearson')} END AS summary
    FROM pair_stats WHERE abs(pearson) >= {config.PEARSON_MED}"""),
)
def redundancy_flags(spark, sf_dir):
    pairs = redundancy.redundancy_pairs(item_table(spark, sf_dir))
    flags = redundancy.redundancy_flags(pairs, item_questions(spark))
    return flags.withColumn("pearson", F.round("pearson", 6)).withColumn("spearman", F.round("spearman", 6))


@query(
    "item_dichotomize",
    with_views(V, BINARY, "SELECT run_id, persona_id, CAST(item AS VARCHAR) AS item, y FROM binary_items"),
)
def item_dichotomize(spark, sf_dir):
    return binary_items(spark, sf_dir)


_P = "1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.5 + 0.1 * item) * ((p % 21 - 10) / 5.0::DOUBLE - 0.1 * (item - 4))))"


@query(
    "irt_loglik_at",
    with_views(V, BINARY, f"""
    SELECT run_id, {rnd(f"-sum(CASE WHEN y = 1 THEN ln({_P}) ELSE ln(1 - {_P}) END)", 4)} AS nll, count(*) AS n
    FROM binary_items GROUP BY 1"""),
)
def irt_loglik_at(spark, sf_dir):
    item, person = F.col("item").cast("double"), F.substring("persona_id", 2, 20).cast("bigint")
    rows = binary_items(spark, sf_dir).withColumn("theta", (person % 21 - 10) / 5.0)
    rows = rows.withColumn("a", 0.5 + 0.1 * item).withColumn("b", 0.1 * (item - 4))
    return irt.negative_log_likelihood(rows).withColumn("nll", F.round("nll", 4))


V["nodes"] = """
SELECT q, (q - 2)::DOUBLE AS t, exp(-0.5 * (q - 2) * (q - 2)) / sum(exp(-0.5 * (q - 2) * (q - 2))) OVER () AS w
FROM (SELECT unnest(range(0, 5)) AS q)"""
V["loglik"] = """
SELECT run_id, persona_id, q, t, w, sum(CASE WHEN y = 1 THEN ln(pr) ELSE ln(1 - pr) END) + ln(w) AS ll FROM (
  SELECT b.*, n.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(0.5 + 0.1 * item) * (t - 0.1 * (item - 4)))) AS pr
  FROM binary_items b CROSS JOIN nodes n) GROUP BY 1, 2, 3, 4, 5"""
V["posterior"] = """
SELECT run_id, persona_id, q, t, exp(ll - max(ll) OVER pp) / sum(exp(ll - mx)) OVER pp AS post
FROM (SELECT *, max(ll) OVER (PARTITION BY run_id, persona_id) AS mx FROM loglik)
WINDOW pp AS (PARTITION BY run_id, persona_id)"""
POSTERIOR = [*BINARY, "nodes", "loglik", "posterior"]


def _fixed_parameters(binary):
    item = F.col("item").cast("double")
    return binary.select("run_id", "item").distinct().select(
        "run_id", "item", (0.5 + 0.1 * item).alias("a"), (0.1 * (item - 4)).alias("b")
    )


@query(
    "irt_posterior_step",
    with_views(V, POSTERIOR, f"""
    SELECT b.run_id, CAST(b.item AS VARCHAR) AS item, p.q::INT AS node,
           {rnd('sum(p.post)', 4)} AS expected_n, {rnd('sum(b.y * p.post)', 4)} AS expected_right
    FROM binary_items b JOIN posterior p USING (run_id, persona_id) GROUP BY 1, 2, 3"""),
)
def irt_posterior_step(spark, sf_dir):
    binary = binary_items(spark, sf_dir)
    counts = irt.posterior_counts(irt.answer_patterns(binary), _fixed_parameters(binary), nodes=5, span=2.0)
    cells = F.array(*[
        F.struct(F.lit(q).alias("node"), F.round(f"n{q}", 4).alias("n"), F.round(f"r{q}", 4).alias("r")) for q in range(5)
    ])
    return counts.select("run_id", "item", F.explode(cells).alias("c")).select(
        "run_id", "item", "c.node", F.col("c.n").alias("expected_n"), F.col("c.r").alias("expected_right")
    )


@query(
    "irt_ability",
    with_views(V, POSTERIOR, f"SELECT run_id, persona_id, {rnd('sum(post * t)', 5)} AS theta FROM posterior GROUP BY 1, 2"),
)
def irt_ability(spark, sf_dir):
    binary = binary_items(spark, sf_dir)
    out = irt.abilities(binary, _fixed_parameters(binary), nodes=5, span=2.0)
    return out.withColumn("theta", F.round("theta", 5))


def _em_steps(steps: int) -> str:
    """SQL of whole EM steps: the posterior over 21 nodes, expected counts, then six Newton rounds inside the bounds."""
    node = "exp(-0.5 * t * t)"
    clip = lambda x, lo, hi: f"least(greatest({x}, {lo}), {hi})"
    p = lambda a, b: clip(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{clip(f'{a} * (t - {b})', -30, 30)}))", "1e-9", "(1 - 1e-9)")
    parts = [f"""grid AS (SELECT q, t, {node} / sum({node}) OVER () AS w FROM (SELECT q, -4.0::DOUBLE + q * 0.4::DOUBLE AS t FROM range(21) r(q))),
big AS (SELECT run_id FROM binary_items GROUP BY 1 HAVING count(DISTINCT persona_id) >= {config.IRT_MIN_PERSONS} AND count(DISTINCT item) >= {config.IRT_MIN_ITEMS}),
bin AS (SELECT run_id, persona_id, item, y FROM binary_items WHERE run_id IN (SELECT run_id FROM big)),
p0 AS (SELECT run_id, item, 1.0::DOUBLE AS a, -ln({clip('avg(y)', 0.01, 0.99)} / (1 - {clip('avg(y)', 0.01, 0.99)})) AS b FROM bin GROUP BY 1, 2)"""]
    for k in range(steps):
        parts.append(f"""ll{k} AS MATERIALIZED (SELECT run_id, persona_id, q, ln(w) + sum(CASE WHEN y = 1 THEN ln(pr) ELSE ln(1 - pr) END) AS ll FROM (
  SELECT bin.*, q, w, {p('a', 'b')} AS pr FROM bin JOIN p{k} USING (run_id, item), grid) GROUP BY run_id, persona_id, q, w),
po{k} AS (SELECT run_id, persona_id, q, exp(ll - m) / sum(exp(ll - m)) OVER (PARTITION BY run_id, persona_id) AS po
  FROM (SELECT *, max(ll) OVER (PARTITION BY run_id, persona_id) AS m FROM ll{k})),
c{k} AS MATERIALIZED (SELECT run_id, item, q, t, sum(po) AS n, sum(y * po) AS r FROM bin JOIN po{k} USING (run_id, persona_id) JOIN grid USING (q) GROUP BY 1, 2, 3, 4),
m{k}_0 AS (SELECT * FROM p{k})""")
        for j in range(6):
            parts.append(f"""g{k}_{j} AS (SELECT run_id, item, a, b, sum((r - n * pr) * t) AS ga, sum(r - n * pr) AS gc, sum(i * t * t) + 1e-9 AS haa,
  sum(i * t) AS hac, sum(i) + 1e-9 AS hcc FROM (SELECT *, n * pr * (1 - pr) AS i FROM (
    SELECT *, {p('a', 'b')} AS pr FROM c{k} JOIN m{k}_{j} USING (run_id, item))) GROUP BY 1, 2, 3, 4),
s{k}_{j} AS (SELECT run_id, item, {clip(f"a + {clip('(hcc * ga - hac * gc) / det', -1.0, 1.0)}", 0.05, 4.0)} AS a,
  -a * b + {clip('(haa * gc - hac * ga) / det', -1.5, 1.5)} AS c FROM (SELECT *, greatest(haa * hcc - hac * hac, 1e-12) AS det FROM g{k}_{j})),
m{k}_{j + 1} AS MATERIALIZED (SELECT run_id, item, a, {clip('-c / a', -5.0, 5.0)} AS b FROM s{k}_{j})""")
        parts.append(f"p{k + 1} AS (SELECT * FROM m{k}_6)")
    return ", " + ", ".join(parts) + f" SELECT run_id, CAST(item AS VARCHAR) AS item, {rnd('a', 4)} AS a, {rnd('b', 4)} AS b FROM p{steps}"


@query("irt_em_steps", with_views(V, BINARY, "").rstrip() + _em_steps(3))
def irt_em_steps(spark, sf_dir):
    """The fit, stopped after three whole steps."""
    fit = irt.fit_discrimination(binary_items(spark, sf_dir), max_iterations=3, tolerance=0.0)
    return fit.select("run_id", "item", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


FIT = [*BINARY, *add_fit_views(V, "item_fit", "binary_items")]


@query("irt_discrimination", with_views(V, FIT, f"SELECT * REPLACE ({rnd('discrimination', 4)} AS discrimination) FROM item_fit").replace("WITH ", "WITH RECURSIVE ", 1))
def irt_discrimination(spark, sf_dir):
    flags = irt.irt_flags(irt.fit_discrimination(binary_items(spark, sf_dir)))
    return flags.withColumn("discrimination", F.round("discrimination", 4))


@query(
    "irt_variance_proxy",
    with_views(V, BINARY, f"""
    SELECT run_id, CAST(item AS VARCHAR) AS item, {rnd('coalesce(var_samp(y), 0)')} AS discrimination, count(*) AS n_personas,
           CASE WHEN coalesce(var_samp(y), 0) < {config.PROXY_LOW_VARIANCE} THEN 'high' ELSE 'none' END AS severity
    FROM binary_items GROUP BY 1, 2"""),
)
def irt_variance_proxy(spark, sf_dir):
    return irt.variance_proxy(binary_items(spark, sf_dir)).withColumn("discrimination", F.round("discrimination", 6))
