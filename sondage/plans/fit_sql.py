"""SQL of the whole discrimination fit: the same steps and the same stop rule, as a recursion over all open runs."""

from __future__ import annotations

from sondage import config
from sondage.plans.registry import sql_fixed2

NODES, ROUNDS, STEPS, TOLERANCE = 21, 6, 200, 0.005


def _clip(x: str, low, high) -> str:
    return f"least(greatest({x}, {low}), {high})"


def _probability(a: str, b: str, t: str) -> str:
    return _clip(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{_clip(f'{a} * ({t} - {b})', -30, 30)}))", "1e-9", "(1 - 1e-9)")


def _newton(source: str) -> str:
    """One Newton round on slope and intercept; n and r list expected answers and right answers by node."""
    t = "(-4.0::DOUBLE + (i - 1) * 0.4::DOUBLE)"
    total = lambda x: f"list_sum(list_transform(range(1, {NODES + 1}), lambda i: {x}))"
    miss, info = "(r[i] - n[i] * pr[i])", "(n[i] * pr[i] * (1 - pr[i]))"
    sums = f"""SELECT *, {total(f'{miss} * {t}')} AS ga, {total(miss)} AS gc, {total(f'{info} * {t} * {t}')} + 1e-9 AS haa, {total(f'{info} * {t}')} AS hac,
      {total(info)} + 1e-9 AS hcc FROM (SELECT *, list_transform(range(1, {NODES + 1}), lambda i: {_probability('a', 'b', t)}) AS pr FROM ({source}))"""
    step = f"""SELECT * EXCLUDE (a, b, pr, ga, gc, haa, hac, hcc, det), {_clip(f"a + {_clip('(hcc * ga - hac * gc) / det', -1.0, 1.0)}", 0.05, 4.0)} AS a,
      -a * b + {_clip('(haa * gc - hac * ga) / det', -1.5, 1.5)} AS c FROM (SELECT *, greatest(haa * hcc - hac * hac, 1e-12) AS det FROM ({sums}))"""
    return f"SELECT * EXCLUDE (c), {_clip('-c / a', -5.0, 5.0)} AS b FROM ({step})"


def add_fit_views(views: dict[str, str], name: str, binary: str) -> list[str]:
    """Adds views for the fit of `binary` (run_id, persona_id, item, y); the last, `name`, has its flags per run and item.

    They need WITH RECURSIVE."""
    n = lambda part: f"{name}_{part}"
    views[n("grid")] = f"""SELECT q, t, exp(-0.5 * t * t) / sum(exp(-0.5 * t * t)) OVER () AS w
  FROM (SELECT q, -4.0::DOUBLE + (q - 1) * 0.4::DOUBLE AS t FROM range(1, {NODES + 1}) g(q))"""
    views[n("answers")] = f"""SELECT run_id, persona_id, item::VARCHAR AS item, y FROM {binary} WHERE run_id IN (
  SELECT run_id FROM {binary} GROUP BY 1 HAVING count(DISTINCT persona_id) >= {config.IRT_MIN_PERSONS} AND count(DISTINCT item) >= {config.IRT_MIN_ITEMS})"""
    share = _clip("avg(y)", 0.01, 0.99)
    likelihood = f"""SELECT run_id, persona_id, q, ln(w) + sum(CASE WHEN y = 1 THEN ln(pr) ELSE ln(1 - pr) END) AS ll FROM (
      SELECT x.run_id, x.persona_id, x.y, g.q, g.w, {_probability('a', 'b', 't')} AS pr
      FROM {n('answers')} x JOIN (SELECT * FROM {n('steps')} WHERE open AND it < {STEPS}) p ON p.run_id = x.run_id AND p.item = x.item, {n('grid')} g) GROUP BY run_id, persona_id, q, w"""
    posterior = f"""SELECT run_id, persona_id, q, exp(ll - m) / sum(exp(ll - m)) OVER (PARTITION BY run_id, persona_id) AS po
      FROM (SELECT *, max(ll) OVER (PARTITION BY run_id, persona_id) AS m FROM ({likelihood}))"""
    counts = f"""SELECT run_id, item, list(n ORDER BY q) AS n, list(r ORDER BY q) AS r FROM (
      SELECT x.run_id, x.item, q, sum(po) AS n, sum(y * po) AS r FROM {n('answers')} x JOIN ({posterior}) o ON o.run_id = x.run_id AND o.persona_id = x.persona_id
      GROUP BY x.run_id, x.item, q) GROUP BY run_id, item"""
    rounds = f"""SELECT p.run_id, p.item, p.it, p.a AS old, p.a, p.b, n, r FROM {n('steps')} p JOIN ({counts}) c ON c.run_id = p.run_id AND c.item = p.item
      WHERE p.open AND p.it < {STEPS}"""
    for _ in range(ROUNDS):
        rounds = _newton(rounds)
    views[n("steps")] = f"""
  SELECT run_id, item, 1.0::DOUBLE AS a, -ln({share} / (1 - {share})) AS b, 0 AS it, true AS open FROM {n('answers')} GROUP BY 1, 2
  UNION ALL SELECT run_id, item, a, b, it + 1, max(abs(a - old)) OVER (PARTITION BY run_id) >= {TOLERANCE} FROM ({rounds})"""
    label = f"CASE WHEN ok THEN CASE WHEN d < {config.A_POOR} THEN 'poor' WHEN d < {config.A_STRONG} THEN 'moderate' ELSE 'strong' END ELSE 'experimental' END"
    views[name] = f"""
  SELECT run_id, item AS question_id, d AS discrimination, {label} AS interpretation, ok AS convergence_ok, n_personas,
    CASE WHEN ok THEN CASE WHEN d < {config.A_POOR} THEN 'high' WHEN d < {config.A_STRONG} THEN 'medium' ELSE 'none' END
         WHEN variance < {config.PROXY_LOW_VARIANCE} THEN 'high' ELSE 'none' END AS severity,
    CASE WHEN NOT ok THEN 'fit did not converge; variance proxy used' END AS note, {label} || ' discrimination ' || {sql_fixed2('d')} AS summary
  FROM (SELECT s.run_id, s.item, NOT s.open AS ok, CASE WHEN s.open THEN variance ELSE s.a END AS d, variance, n_personas
    FROM (SELECT run_id, item, arg_max(a, it) AS a, arg_max(open, it) AS open FROM {n('steps')} GROUP BY 1, 2) s
    JOIN (SELECT run_id, item, coalesce(var_samp(y), 0) AS variance, count(*) AS n_personas FROM {n('answers')} GROUP BY 1, 2) v ON v.run_id = s.run_id AND v.item = s.item)"""
    return [n("grid"), n("answers"), n("steps"), name]
