"""DuckDB SQL with the result of each registered query, by independent means where possible.

Rank tests and areas are counted over pairs, tail probabilities come from series, and the
penalised regressions are solved by coordinate descent in a recursive query.
"""

from __future__ import annotations

from assaylens.plans import roles

ORACLES: dict[str, str] = {}


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c) for c in row) + ")" for row in rows)


_FULL, _HR, _MMR = _list(roles.FULL), _list(roles.HR), _list(roles.MMR)

BASE = f"""
dims(response_id, response) AS (VALUES {_values(enumerate(roles.RESPONSES, 1))}),
plan AS (SELECT response_id, response, upper(response[3:3]) || lower(response[4:]) AS name FROM dims),
planned AS (
  SELECT response_id, response,
         CASE response_id WHEN 4 THEN 'Not Specified' ELSE name END AS response_name FROM plan
  UNION ALL SELECT 6, '6-ABSENT', 'Absent'),
ent AS (SELECT c_custkey AS entity_id, c_mktsegment AS context FROM customer),
pres AS (
  SELECT o_custkey AS entity_id, o_orderpriority AS response, ln(avg(o_totalprice)) - 12.4 AS y
  FROM orders GROUP BY 1, 2),
resp AS (
  SELECT e.entity_id, d.response, p.y FROM ent e CROSS JOIN dims d
  LEFT JOIN pres p ON p.entity_id = e.entity_id AND p.response = d.response),
brand_lines AS (
  SELECT o_custkey AS entity_id, p_brand AS feature, count(*) AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
hits AS (SELECT entity_id, feature FROM brand_lines WHERE lines >= 4 AND feature IN ({_FULL})),
brands(feature) AS (VALUES {_values([(b,) for b in roles.FULL])}),
flag AS (
  SELECT e.entity_id, b.feature, CASE WHEN h.feature IS NULL THEN 0 ELSE 1 END AS v
  FROM ent e CROSS JOIN brands b LEFT JOIN hits h ON h.entity_id = e.entity_id AND h.feature = b.feature),
score AS (
  SELECT entity_id,
         CAST(sum(CASE WHEN feature IN ({_HR}) THEN v ELSE 0 END) AS INTEGER) AS hrd_score,
         CAST(max(CASE WHEN feature IN ({_MMR}) THEN v ELSE 0 END) AS INTEGER) AS msi_status,
         CAST(sum(v) AS INTEGER) AS ddr_burden
  FROM flag GROUP BY 1),
feat AS (
  SELECT entity_id, feature, CAST(v AS DOUBLE) AS v FROM flag
  UNION ALL SELECT entity_id, 'hrd_score', hrd_score FROM score
  UNION ALL SELECT entity_id, 'msi_status', msi_status FROM score
  UNION ALL SELECT entity_id, 'ddr_burden', ddr_burden FROM score),
lab_all AS (SELECT response, entity_id, CASE WHEN y < 0 THEN 1 ELSE 0 END AS label FROM resp),
lab AS (
  SELECT * FROM lab_all WHERE response IN (
    SELECT response FROM lab_all GROUP BY 1 HAVING sum(label) >= 15 AND sum(1 - label) >= 15)),
fold AS (
  SELECT response, label, entity_id,
         CAST((row_number() OVER (PARTITION BY response, label
           ORDER BY md5('42#' || entity_id), entity_id) - 1) % 5 AS INTEGER) AS fold
  FROM lab),
cut AS (
  SELECT response, quantile_cont(y, 0.25) AS low, quantile_cont(y, 0.75) AS high
  FROM pres GROUP BY 1),
quart AS (
  SELECT p.response, p.entity_id, c.low, CASE WHEN p.y <= c.low THEN 1 ELSE 0 END AS label
  FROM pres p JOIN cut c USING (response)),
cells AS (
  SELECT l.response, f.feature, f.v, CAST(sum(l.label) AS DOUBLE) AS n1, CAST(sum(1 - l.label) AS DOUBLE) AS n0
  FROM lab l JOIN feat f USING (entity_id) GROUP BY 1, 2, 3)"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {BASE.strip()}{',' + more if more else ''}\n{body}"


def erfc(x: str) -> str:
    """1 - erf by the all-positive series."""
    return (
        f"(1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 120), "
        f"lambda n: pow({x}, 2 * n + 1) * exp(n * ln(4) + lgamma(n + 1) - lgamma(2 * n + 2)))))"
    )


def rank_sum_cte(cells: str, keys: str) -> str:
    """U by pair counting over distinct values, then the corrected normal tail, as CTE mw."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    keyed = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
pairs AS (
  SELECT {keyed}, sum(a.n1 * b.n0 * CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0.0 END) AS u
  FROM {cells} a JOIN {cells} b ON {on} GROUP BY {keyed}),
sizes AS (
  SELECT {keys}, sum(n1) AS s1, sum(n0) AS s0, sum(pow(n1 + n0, 3) - (n1 + n0)) AS ties,
         count(*) FILTER (WHERE n1 > 0) AS d1, count(*) FILTER (WHERE n0 > 0) AS d0
  FROM {cells} GROUP BY {keys}),
zs AS (
  SELECT {keys}, u, s1, s0, (d1 <= 1 AND d0 <= 1) OR s1 = 0 OR s0 = 0 AS flat,
         (greatest(u, s1 * s0 - u) - s1 * s0 / 2 - 0.5)
         / sqrt(nullif(s1 * s0 / 12 * ((s1 + s0 + 1) - ties / ((s1 + s0) * (s1 + s0 - 1))), 0)) / sqrt(2) AS x
  FROM pairs JOIN sizes USING ({keys})),
mw AS (
  SELECT {keys}, CASE WHEN flat THEN 0.0 ELSE u END AS u_statistic,
         CASE WHEN flat OR x <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, {erfc('x')})) END AS p_value
  FROM zs)"""


BH = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY response ORDER BY p_value, feature) AS rn,
         count(*) OVER (PARTITION BY response) AS m FROM mw),
bh AS (
  SELECT response, feature, u_statistic, p_value,
         min(least(1.0, p_value * m / rn)) OVER (PARTITION BY response ORDER BY rn
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_adjusted
  FROM ordered)"""

EFFECT = """
moments AS (
  SELECT l.response, f.feature,
         avg(f.v) FILTER (WHERE label = 1) AS m1, avg(f.v) FILTER (WHERE label = 0) AS m0,
         coalesce(var_samp(f.v) FILTER (WHERE label = 1), 0) AS v1,
         coalesce(var_samp(f.v) FILTER (WHERE label = 0), 0) AS v0,
         count(*) FILTER (WHERE label = 1) AS s1, count(*) FILTER (WHERE label = 0) AS s0
  FROM lab l JOIN feat f USING (entity_id) GROUP BY 1, 2),
effect AS (
  SELECT response, feature, m1, m0,
         CASE WHEN s1 + s0 <= 2 OR (v1 = 0 AND v0 = 0) THEN 0.0
              ELSE (m1 - m0) / sqrt(((s1 - 1) * v1 + (s0 - 1) * v0) / (s1 + s0 - 2)) END AS d
  FROM moments)"""

SPEARMAN_T = """
t AS (
  SELECT response, n, rho, n - 2 AS df, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM corrs),
angles AS (SELECT *, df / (df + t * t) AS c2, t / sqrt(df + t * t) AS s FROM t),
tailed AS (
  SELECT response, n, rho,
    CASE WHEN df % 2 = 0 THEN
      1 - s * list_sum(list_transform(range(0, CAST(df // 2 AS BIGINT)), lambda k:
        exp(k * ln(c2) + lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5))))
    ELSE
      1 - 2 / pi() * (atan(t / sqrt(df)) + s * sqrt(c2) * list_sum(list_transform(
        range(0, CAST((df - 1) // 2 AS BIGINT)), lambda k:
        exp(k * ln(c2) + lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)))))
    END AS p
  FROM angles)"""


def corr_cte(score: str) -> str:
    return f"""
ranked AS (
  SELECT p.response,
         rank() OVER (PARTITION BY p.response ORDER BY p.y)
           + (count(*) OVER (PARTITION BY p.response, p.y) - 1) / 2.0 AS ry,
         rank() OVER (PARTITION BY p.response ORDER BY s.{score})
           + (count(*) OVER (PARTITION BY p.response, s.{score}) - 1) / 2.0 AS rs
  FROM pres p JOIN score s USING (entity_id)),
corrs AS (SELECT response, count(*) AS n, corr(CAST(rs AS DOUBLE), CAST(ry AS DOUBLE)) AS rho FROM ranked GROUP BY 1),{SPEARMAN_T}"""


QUALITY = """
docs AS (SELECT n_chars AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
pts AS (
  SELECT s.score, count(*) FILTER (WHERE label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE label = 0)::DOUBLE AS fp
  FROM (SELECT DISTINCT score FROM docs) s JOIN docs d ON d.score >= s.score GROUP BY 1),
tot AS (SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM docs)"""

CLOSED = """
box AS (
  SELECT response, feature,
         sum(n1) FILTER (WHERE v = 1) AS a, sum(n0) FILTER (WHERE v = 1) AS b,
         sum(n1) FILTER (WHERE v = 0) AS c, sum(n0) FILTER (WHERE v = 0) AS d
  FROM cells WHERE feature IN (SELECT feature FROM brands) GROUP BY 1, 2),
closed AS (
  SELECT response, feature,
         CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN ln(c / d) END AS intercept,
         CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN ln(a) + ln(d) - ln(b) - ln(c) END AS coefficient
  FROM box),
lin AS (
  SELECT l.response, f.feature, avg(abs(c.coefficient * (f.v - m.mv))) AS mean_abs_shap
  FROM lab l JOIN feat f USING (entity_id)
  JOIN (SELECT feature, avg(v) AS mv FROM feat GROUP BY 1) m ON m.feature = f.feature
  JOIN closed c ON c.response = l.response AND c.feature = f.feature
  WHERE c.coefficient IS NOT NULL GROUP BY 1, 2)"""

RANKS = """
ev AS (
  SELECT e.response, e.feature, round(coalesce(l.mean_abs_shap, 0), 12) AS shap, b.u_statistic, b.p_value,
         b.p_adjusted, e.d, round(abs(e.d), 12) AS ad
  FROM effect e JOIN bh b USING (response, feature) LEFT JOIN lin l USING (response, feature)),
summ AS (
  SELECT *,
    (SELECT count(*) FROM ev o WHERE o.response = ev.response AND o.shap > ev.shap)
      + ((SELECT count(*) FROM ev o WHERE o.response = ev.response AND o.shap = ev.shap) + 1) / 2.0 AS shap_rank,
    (SELECT count(*) FROM ev o WHERE o.response = ev.response AND o.p_adjusted < ev.p_adjusted)
      + ((SELECT count(*) FROM ev o WHERE o.response = ev.response AND o.p_adjusted = ev.p_adjusted) + 1) / 2.0 AS pval_rank,
    (SELECT count(*) FROM ev o WHERE o.response = ev.response AND o.ad > ev.ad)
      + ((SELECT count(*) FROM ev o WHERE o.response = ev.response AND o.ad = ev.ad) + 1) / 2.0 AS effect_rank
  FROM ev)"""

# Penalised balanced logistic regression on the six HR flags, scaled per training fold, for each
# held-out fold and for all rows (-1): cyclic coordinate descent, one coordinate per recursion.
_X = ", ".join(f"max(CASE WHEN f.feature = '{b}' THEN f.v ELSE 0 END)::DOUBLE" for b in roles.HR)
DESCENT = f"""
qfold AS (
  SELECT response, label, entity_id,
         CAST((row_number() OVER (PARTITION BY response, label
           ORDER BY md5('42#' || entity_id), entity_id) - 1) % 5 AS INTEGER) AS fold FROM quart),
vec AS (SELECT f.entity_id, [1.0::DOUBLE, {_X}] AS x FROM flag f GROUP BY 1),
held(held) AS (VALUES (-1), (0), (1), (2), (3), (4)),
train AS (
  SELECT q.response, h.held, q.label, v.x, count(*)::DOUBLE AS n
  FROM qfold q JOIN vec v USING (entity_id) JOIN held h ON q.fold <> h.held GROUP BY 1, 2, 3, 4),
cls AS (SELECT response, held, label, sum(n) AS c, sum(sum(n)) OVER (PARTITION BY response, held) AS t FROM train GROUP BY 1, 2, 3),
tr AS (
  SELECT t.response, t.held, t.label, t.x, t.n * c.t / (2 * c.c) AS w FROM train t JOIN cls c USING (response, held, label)),
pos(j) AS (SELECT unnest(range(1, 8))),
pen AS (
  SELECT response, held, list(pen ORDER BY j) AS pen FROM (
    SELECT t.response, t.held, p.j, CASE WHEN p.j = 1 THEN 0.0
      WHEN sum(n * t.x[p.j] * t.x[p.j]) / sum(n) - pow(sum(n * t.x[p.j]) / sum(n), 2) <= 0 THEN 1.0
      ELSE sum(n * t.x[p.j] * t.x[p.j]) / sum(n) - pow(sum(n * t.x[p.j]) / sum(n), 2) END AS pen
    FROM train t CROSS JOIN pos p GROUP BY 1, 2, 3) GROUP BY 1, 2),
fit AS (
  SELECT response, held, 0 AS k, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0] AS b, pen FROM pen
  UNION ALL
  SELECT response, held, k + 1, list_transform(b, lambda v, i: CASE WHEN i = k % 7 + 1 THEN
    v - (g + pen[k % 7 + 1] * v) / (h + pen[k % 7 + 1]) ELSE v END), pen
  FROM (
    SELECT f.response, f.held, f.k, f.b, f.pen,
           sum(t.w * t.x[f.k % 7 + 1] * (1 / (1 + exp(-list_dot_product(t.x, f.b))) - t.label)) AS g,
           sum(t.w * t.x[f.k % 7 + 1] * t.x[f.k % 7 + 1]
               / (1 + exp(-list_dot_product(t.x, f.b))) / (1 + exp(list_dot_product(t.x, f.b)))) AS h
    FROM fit f JOIN tr t ON t.response = f.response AND t.held = f.held WHERE f.k < 420 GROUP BY ALL)),
final AS (SELECT response, held, b, pen FROM fit WHERE k = 420),
oof AS (
  SELECT q.response, q.fold, v.x, sum(q.label) AS pos, sum(1 - q.label) AS neg,
         any_value(list_dot_product(v.x, f.b)) AS z
  FROM qfold q JOIN vec v USING (entity_id) JOIN final f ON f.response = q.response AND f.held = q.fold GROUP BY 1, 2, 3),
q_auc AS (
  SELECT a.response, a.fold,
         sum(a.pos * b.neg * CASE WHEN a.z > b.z THEN 1.0 WHEN a.z = b.z THEN 0.5 ELSE 0.0 END)::DOUBLE
         / (any_value(w.p) * any_value(w.n)) AS auc
  FROM oof a JOIN oof b ON a.response = b.response AND a.fold = b.fold
  JOIN (SELECT response, fold, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM oof GROUP BY 1, 2) w
    ON a.response = w.response AND a.fold = w.fold GROUP BY 1, 2),
q_cv AS (SELECT response, avg(auc) AS m, stddev_pop(auc) AS s FROM q_auc GROUP BY 1),
hr(feature, j) AS (VALUES {_values([(b, i + 2) for i, b in enumerate(roles.HR)])})"""

# The 16-feature regressions: a fixed bound of the curvature (a quarter of the weighted squares)
# gives the step, its linear system is solved by conjugate gradients inside a list fold.
_ALL = ", ".join(f"max(CASE WHEN f.feature = '{b}' THEN f.v ELSE 0 END)::DOUBLE" for b in roles.FEATURES)
_P = len(roles.FEATURES) + 1
_CG = """
list_reduce(list_transform(range(0, 61), lambda q: [list_transform(g, lambda v: 0.0::DOUBLE), g, g]), lambda s, y:
  list_transform([list_transform(hh, lambda line: list_dot_product(line, s[3]))], lambda ap:
    list_transform([coalesce(list_dot_product(s[2], s[2]) / nullif(list_dot_product(s[3], ap), 0), 0)], lambda a:
      list_transform([list_transform(s[2], lambda v, i: v - a * ap[i])], lambda r:
        [list_transform(s[1], lambda v, i: v + a * s[3][i]), r,
         list_transform(r, lambda v, i: v + coalesce(list_dot_product(r, r) / nullif(list_dot_product(s[2], s[2]), 0), 0) * s[3][i])]
      )[1])[1])[1])[1]"""


def bounded(
    name: str, split: str, grid: str, steps: int = 15, rows: str = "dealt", vec: str = "vec16", at: str = "at17", scaled: bool = False
) -> str:
    """Penalised fits of (response, held-out fold of *split*, c) as CTE *name*, c taken from *grid*.

    With *scaled* the penalty of a coefficient is weighted by the training variance of its feature.
    """
    mean = "sum(t.n * t.x[a.i]) / sum(t.n)"
    variance = f"sum(t.n * t.x[a.i] * t.x[a.i]) / sum(t.n) - pow({mean}, 2)"
    weight = f"CASE WHEN {variance} > 0 THEN {variance} ELSE 1 END" if scaled else "1"
    return f"""
{name}_train AS (
  SELECT q.response, h.held, q.label, v.x, count(*)::DOUBLE AS n
  FROM {rows} q JOIN {vec} v USING (entity_id) JOIN (SELECT DISTINCT {split} AS held FROM {rows} UNION SELECT -1) h ON q.{split} <> h.held
  GROUP BY 1, 2, 3, 4),
{name}_cls AS (
  SELECT response, held, label, sum(n) AS c, sum(sum(n)) OVER (PARTITION BY response, held) AS t FROM {name}_train GROUP BY 1, 2, 3),
{name}_tr AS (
  SELECT t.response, t.held, t.label, t.x, t.n * k.t / (2 * k.c) AS w
  FROM {name}_train t JOIN {name}_cls k USING (response, held, label)),
{name}_pen AS (
  SELECT t.response, t.held, a.i, CASE WHEN a.i = 1 THEN 0.0 ELSE {weight} END AS pen
  FROM {name}_train t CROSS JOIN {at} a GROUP BY 1, 2, 3),
{name}_pens AS (SELECT response, held, list(pen ORDER BY i) AS pens FROM {name}_pen GROUP BY 1, 2),
{name}_cell AS (
  SELECT t.response, t.held, a.i, b.i AS j, sum(t.w * t.x[a.i] * t.x[b.i]) / 4 AS s
  FROM {name}_tr t CROSS JOIN {at} a CROSS JOIN {at} b GROUP BY 1, 2, 3, 4),
{name}_line AS (
  SELECT m.response, m.held, g.c, m.i,
         list(g.c * m.s + CASE WHEN m.i = m.j THEN p.pen ELSE 0 END ORDER BY m.j) AS line
  FROM {name}_cell m JOIN {grid} g ON g.response = m.response
  JOIN {name}_pen p ON p.response = m.response AND p.held = m.held AND p.i = m.i GROUP BY 1, 2, 3, 4),
{name}_h AS (SELECT response, held, c, list(line ORDER BY i) AS hh FROM {name}_line GROUP BY 1, 2, 3),
{name}_it AS (
  SELECT response, held, c, hh, pens, 0 AS k, list_transform(pens, lambda q: 0.0::DOUBLE) AS b
  FROM {name}_h JOIN {name}_pens USING (response, held)
  UNION ALL
  SELECT response, held, c, hh, pens, k + 1, list_transform(b, lambda v, i: v - step[i])
  FROM (SELECT response, held, c, hh, pens, k, b, {_CG} AS step FROM (
    SELECT response, held, c, any_value(hh) AS hh, any_value(pens) AS pens, k, any_value(b) AS b,
           list(c * s + pens[i] * b[i] ORDER BY i) AS g
    FROM (
      SELECT f.response, f.held, f.c, any_value(f.hh) AS hh, any_value(f.pens) AS pens, f.k, any_value(f.b) AS b, a.i,
             sum(t.w * (1 / (1 + exp(-list_dot_product(t.x, f.b))) - t.label) * t.x[a.i]) AS s
      FROM {name}_it f JOIN {name}_tr t ON t.response = f.response AND t.held = f.held CROSS JOIN {at} a
      WHERE f.k < {steps} GROUP BY f.response, f.held, f.c, f.k, a.i)
    GROUP BY response, held, c, k))),
{name} AS (SELECT response, held, c, b FROM {name}_it WHERE k = {steps}),
{name}_z AS (
  SELECT q.response, q.{split} AS held, m.c, q.label, list_dot_product(v.x, m.b) AS z
  FROM {rows} q JOIN {vec} v USING (entity_id) JOIN {name} m ON m.response = q.response AND m.held = q.{split}),
{name}_auc AS (
  SELECT a.response, a.held, a.c, avg(CASE WHEN a.z > b.z THEN 1.0 WHEN a.z = b.z THEN 0.5 ELSE 0.0 END) AS auc
  FROM {name}_z a JOIN {name}_z b ON a.response = b.response AND a.held = b.held AND a.c = b.c AND a.label = 1 AND b.label = 0
  GROUP BY 1, 2, 3)"""


SELECT_C = f"""
dealt AS (
  SELECT response, label, entity_id, fold, CAST((rn - 1) % 3 AS INTEGER) AS inner_fold
  FROM (SELECT *, row_number() OVER (PARTITION BY response, label ORDER BY md5('42#' || entity_id), entity_id) AS rn FROM fold)),
vec16 AS (SELECT f.entity_id, [1.0::DOUBLE, {_ALL}] AS x FROM feat f GROUP BY 1),
at17(i) AS (SELECT unnest(range(1, {_P + 1}))),
cgrid AS (SELECT DISTINCT response, c FROM lab CROSS JOIN (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0)) g(c)),""" + bounded(
    "inn", "inner_fold", "cgrid"
) + """,
chosen AS (
  SELECT response, c, auc FROM (SELECT response, c, round(avg(auc), 12) AS auc FROM inn_auc GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY response ORDER BY auc DESC, c) = 1)"""
LR_CV = SELECT_C + "," + bounded("outr", "fold", "chosen", 25) + """,
lr_hit AS (
  SELECT response, held,
         count(*) FILTER (WHERE label = 1 AND z > 0)::DOUBLE AS tp, count(*) FILTER (WHERE label = 0 AND z > 0)::DOUBLE AS fp,
         count(*) FILTER (WHERE label = 1 AND z <= 0)::DOUBLE AS fn, count(*) FILTER (WHERE label = 0 AND z <= 0)::DOUBLE AS tn
  FROM outr_z GROUP BY 1, 2)"""

_NARROW = ", ".join(f"max(CASE WHEN f.feature = '{b}' THEN f.v ELSE 0 END)::DOUBLE" for b in roles.HR)
MODELS = f"""
vec16 AS (SELECT f.entity_id, [1.0::DOUBLE, {_ALL}] AS x FROM feat f GROUP BY 1),
vec6 AS (SELECT f.entity_id, [1.0::DOUBLE, {_NARROW}] AS x FROM feat f GROUP BY 1),
at17(i) AS (SELECT unnest(range(1, {_P + 1}))),
at7(i) AS (SELECT unnest(range(1, 8))),
unit AS (SELECT DISTINCT response, 1.0::DOUBLE AS c FROM lab),""" + bounded("few", "fold", "unit", 25, "fold", "vec6", "at7") + "," + bounded(
    "every", "fold", "unit", 25, "fold", "vec16", "at17"
) + """,
scored AS (
  SELECT response, 'HR' AS model, held AS fold, label, 1 / (1 + exp(-z)) AS prob FROM few_z
  UNION ALL SELECT response, 'full', held, label, 1 / (1 + exp(-z)) FROM every_z),
tally AS (
  SELECT response, model, fold, prob, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY 1, 2, 3, 4),
fold_auc AS (
  SELECT a.response, a.model, a.fold,
         sum(a.pos * b.neg * CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END)::DOUBLE
         / (any_value(w.p) * any_value(w.n)) AS auc
  FROM tally a JOIN tally b ON a.response = b.response AND a.model = b.model AND a.fold = b.fold
  JOIN (SELECT response, model, fold, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM tally GROUP BY 1, 2, 3) w
    ON a.response = w.response AND a.model = w.model AND a.fold = w.fold
  GROUP BY 1, 2, 3),
hit AS (
  SELECT response, model, fold,
         count(*) FILTER (WHERE label = 1 AND prob > 0.5)::DOUBLE AS tp,
         count(*) FILTER (WHERE label = 0 AND prob > 0.5)::DOUBLE AS fp,
         count(*) FILTER (WHERE label = 1 AND prob <= 0.5)::DOUBLE AS fn,
         count(*) FILTER (WHERE label = 0 AND prob <= 0.5)::DOUBLE AS tn
  FROM scored GROUP BY 1, 2, 3),
per_fold AS (
  SELECT h.response, h.model, h.fold, coalesce(a.auc, 0.5) AS auc,
         (tp + tn) / (tp + fp + fn + tn) AS accuracy,
         coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
         coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM hit h JOIN fold_auc a USING (response, model, fold)),
compared AS (
  SELECT response, model, round_even(avg(auc), 4) AS auc, round_even(avg(accuracy), 4) AS accuracy,
         round_even(avg(precision), 4) AS precision, round_even(avg(recall), 4) AS recall, round_even(avg(f1), 4) AS f1
  FROM per_fold GROUP BY 1, 2)"""

ABLATION = MODELS + """,
cv AS (SELECT response, model, avg(auc) AS m, stddev_pop(auc) AS s FROM fold_auc GROUP BY 1, 2),
abl AS (
  SELECT p.response_id, p.response_name, l.n, l.n_sensitive, a.m AS auc_base, a.s AS std_base,
         b.m AS auc_full, b.s AS std_full, b.m - a.m AS delta
  FROM planned p JOIN cv a ON a.response = p.response AND a.model = 'HR'
  JOIN cv b ON b.response = p.response AND b.model = 'full'
  JOIN (SELECT response, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_sensitive FROM lab GROUP BY 1) l
    ON l.response = p.response)"""


SUMMARY = LR_CV + f""",
place(feature, j) AS (VALUES {_values([(f, i) for i, f in enumerate(roles.FEATURES, 2)])}),
lin AS (
  SELECT l.response, f.feature, avg(abs(m.b[p.j] * (f.v - a.mv))) AS mean_abs_shap
  FROM lab l JOIN feat f USING (entity_id) JOIN place p ON p.feature = f.feature
  JOIN (SELECT l.response, f.feature, avg(f.v) AS mv FROM lab l JOIN feat f USING (entity_id) GROUP BY 1, 2) a
    ON a.response = l.response AND a.feature = f.feature
  JOIN outr m ON m.response = l.response AND m.held = -1 GROUP BY 1, 2),""" + rank_sum_cte("cells", "response, feature") + "," + BH + "," + EFFECT + "," + RANKS

# nested: each outer fold is a response of its own, made of the rows outside that fold
NESTED = SELECT_C[: SELECT_C.index("cgrid AS")].rstrip() + """
parts AS (SELECT DISTINCT fold AS o FROM fold),
nest AS (SELECT d.response || '#' || o AS response, label, entity_id, inner_fold FROM dealt d JOIN parts ON d.fold <> o),
ngrid AS (SELECT DISTINCT response, c FROM nest CROSS JOIN (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0)) g(c)),""" + bounded(
    "nin", "inner_fold", "ngrid", rows="nest"
) + """,
nchosen AS (
  SELECT response, c FROM (SELECT response, c, round(avg(auc), 12) AS auc FROM nin_auc GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY response ORDER BY auc DESC, c) = 1),
nz AS (
  SELECT d.response, d.fold, d.label, list_dot_product(v.x, m.b) AS z
  FROM dealt d JOIN vec16 v USING (entity_id) JOIN nchosen k ON k.response = d.response || '#' || d.fold
  JOIN nin m ON m.response = k.response AND m.c = k.c AND m.held = -1),
nauc AS (
  SELECT a.response, a.fold, avg(CASE WHEN a.z > b.z THEN 1.0 WHEN a.z = b.z THEN 0.5 ELSE 0.0 END) AS auc
  FROM nz a JOIN nz b ON a.response = b.response AND a.fold = b.fold AND a.label = 1 AND b.label = 0 GROUP BY 1, 2),
nhit AS (
  SELECT response, fold,
         count(*) FILTER (WHERE label = 1 AND z > 0)::DOUBLE AS tp, count(*) FILTER (WHERE label = 0 AND z > 0)::DOUBLE AS fp,
         count(*) FILTER (WHERE label = 1 AND z <= 0)::DOUBLE AS fn, count(*) FILTER (WHERE label = 0 AND z <= 0)::DOUBLE AS tn
  FROM nz GROUP BY 1, 2)"""
_FLAGS = ", ".join(f"max(CASE WHEN f.feature = '{b}' THEN f.v ELSE 0 END)::DOUBLE" for b in (*roles.FULL, "msi_status"))
_CONTEXT = ", ".join(f"max(CASE WHEN e.context = '{c}' THEN 1 ELSE 0 END)::DOUBLE" for c in roles.CONTEXTS)
SETS = f"""
outer_quarters AS (
  SELECT p.response, p.entity_id, CASE WHEN p.y <= c.low THEN 1 ELSE 0 END AS label
  FROM pres p JOIN cut c USING (response) WHERE p.y <= c.low OR p.y >= c.high),
qfold AS (
  SELECT response, label, entity_id,
         CAST((row_number() OVER (PARTITION BY response, label
           ORDER BY md5('42#' || entity_id), entity_id) - 1) % 5 AS INTEGER) AS fold FROM outer_quarters),
vec14 AS (SELECT f.entity_id, [1.0::DOUBLE, {_FLAGS}] AS x FROM feat f GROUP BY 1),
vec19 AS (SELECT f.entity_id, [1.0::DOUBLE, {_FLAGS}, {_CONTEXT}] AS x FROM feat f JOIN ent e USING (entity_id) GROUP BY 1),
at15(i) AS (SELECT unnest(range(1, 16))),
at20(i) AS (SELECT unnest(range(1, 21))),
unit AS (SELECT DISTINCT response, 1.0::DOUBLE AS c FROM outer_quarters),""" + bounded(
    "base", "fold", "unit", 40, "qfold", "vec14", "at15", True
) + "," + bounded("wide", "fold", "unit", 80, "qfold", "vec19", "at20", True)

_wide_resp = ", ".join(f"round(max(y) FILTER (WHERE response = '{r}'), 9) AS {{{i}}}" for i, r in enumerate(roles.RESPONSES))

ORACLES["response_long"] = sql("SELECT entity_id, response, round(y, 9) AS y FROM resp")
ORACLES["feature_long"] = sql("SELECT entity_id, feature, v FROM flag")
ORACLES["dirty_numeric_flags"] = r"""
SELECT event_id, raw,
       CASE WHEN regexp_full_match(raw, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')
            THEN coalesce(try_cast(trunc(try_cast(trim(raw) AS DOUBLE)) AS BIGINT), 0) ELSE 0 END AS k
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN props
        ELSE (CASE WHEN event_id % 4 = 0 THEN '-' ELSE '' END) || event_id
             || ['', 'd', 'F', '000000000', '.75', 'e2', ' ', 'x', '.'][event_id % 9 + 1] END AS raw FROM events)"""
ORACLES["response_keys"] = sql("SELECT CAST(response_id AS INTEGER) AS response_id, count(*) AS n FROM pres JOIN dims USING (response) GROUP BY 1")
ORACLES["csv_roundtrip"] = sql(f"SELECT entity_id, {_wide_resp.format(*'abcde')} FROM resp GROUP BY 1")
ORACLES["missing_source_default"] = sql("SELECT entity_id, context FROM ent")
ORACLES["merged_matrix"] = sql(
    f"SELECT w.*, f.r1_mut, f.r2_mut, f.r3_mut, f.r4_mut, f.r5_mut, e.context, 1 AS r1_mut_meta FROM "
    f"(SELECT entity_id, {_wide_resp.format('r1', 'r2', 'r3', 'r4', 'r5')} FROM resp GROUP BY 1) w "
    "JOIN (SELECT entity_id, "
    + ", ".join(f"max(v) FILTER (WHERE feature = '{b}') AS r{i}_mut" for i, b in enumerate(roles.HR[:5], 1))
    + " FROM flag GROUP BY 1) f USING (entity_id) JOIN ent e USING (entity_id)"
)
ORACLES["shared_entities"] = sql("SELECT entity_id FROM pres INTERSECT SELECT entity_id FROM flag")
ORACLES["panel_scores"] = sql(
    "SELECT s.*, n.narrow, n.broad FROM score s JOIN (SELECT entity_id, "
    f"CAST(sum(v) FILTER (WHERE feature IN ({_list(roles.NARROW)})) AS INTEGER) AS narrow, "
    f"CAST(sum(v) FILTER (WHERE feature IN ({_list(roles.FULL[:11])})) AS INTEGER) AS broad FROM flag GROUP BY 1) n USING (entity_id)"
)
_CHOSEN = {**roles.PANELS, "narrow": roles.NARROW, "broad": roles.FULL[:11]}
ORACLES["panel_score_rows"] = sql(f"""
SELECT h.entity_id, m.panel, CAST(count(*) AS DOUBLE) AS score, true AS hit
FROM hits h JOIN (VALUES {_values([(n, f) for n, fs in _CHOSEN.items() for f in fs])}) m(panel, feature)
  ON m.feature = h.feature
GROUP BY 1, 2""")

ORACLES["size_panel_summary"] = sql("""
SELECT panel, count(DISTINCT m.feature) AS features, count(DISTINCT entity_id) AS entities,
       CAST(coalesce(sum(score) FILTER (WHERE nth = 1), 0) AS DOUBLE) AS total,
       CAST(coalesce(max(score), 0) AS DOUBLE) AS most
FROM (
  SELECT m.panel, m.feature, b.entity_id, count(b.entity_id) OVER (PARTITION BY m.panel, b.entity_id) AS score,
         row_number() OVER (PARTITION BY m.panel, b.entity_id ORDER BY m.feature) AS nth
  FROM (SELECT DISTINCT 'size ' || p_size AS panel, p_brand AS feature FROM part) m
  LEFT JOIN brand_lines b ON b.feature = m.feature AND b.lines >= 4) m
GROUP BY 1""")

ORACLES["panel_scores_wide"] = sql(
    "SELECT s.*, f.v AS \"Brand#1\" FROM score s JOIN flag f USING (entity_id) WHERE f.feature = 'Brand#1'"
)
ORACLES["panel_missing"] = sql(
    f"SELECT feature FROM (VALUES {_values([(b,) for b in (*roles.HR, 'Brand#98', 'Brand#99')])}) r(feature) "
    "WHERE feature NOT IN (SELECT feature FROM flag)"
)
ORACLES["panel_subset_violations"] = f"""
SELECT DISTINCT 'size ' || p_size AS panel, p_brand AS feature FROM part WHERE p_brand NOT IN ({_FULL})"""
ORACLES["interaction_features"] = sql(
    "SELECT entity_id, "
    + ", ".join(
        f"CAST(min(v) FILTER (WHERE feature IN ('{a}', '{b}')) AS INTEGER) AS \"{a}_x_{b}\"" for a, b in roles.PAIRS
    )
    + " FROM flag GROUP BY 1"
)
ORACLES["interaction_hits"] = sql(
    " UNION ALL ".join(
        f"SELECT '{a}_x_{b}' AS feature, count(*) AS n FROM hits a JOIN hits b USING (entity_id) "
        f"WHERE a.feature = '{a}' AND b.feature = '{b}' HAVING count(*) > 0"
        for a, b in roles.PAIRS
    )
)
ORACLES["label_threshold"] = sql("SELECT response, entity_id, label FROM lab_all")
ORACLES["label_quantile"] = sql("SELECT response, entity_id, round(low, 9) AS cut, label FROM quart")
ORACLES["label_extreme_quartiles"] = sql(
    "SELECT response, entity_id, CASE WHEN y <= low THEN 1 ELSE 0 END AS label FROM pres JOIN cut USING (response) "
    "WHERE y <= low OR y >= high"
)
ORACLES["class_balance"] = sql(
    "SELECT response, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_sensitive, CAST(sum(1 - label) AS BIGINT) AS n_resistant, "
    "round(100.0::DOUBLE * sum(label) / count(*), 6) AS pct_sensitive, "
    "round(100.0::DOUBLE * sum(1 - label) / count(*), 6) AS pct_resistant FROM lab_all GROUP BY 1"
)
ORACLES["class_gate"] = sql(
    "SELECT response || '/' || context AS response, count(*) AS n, "
    "CAST(sum(CASE WHEN y < -1.2 THEN 1 ELSE 0 END) AS BIGINT) AS n_sensitive FROM resp JOIN ent USING (entity_id) GROUP BY 1 "
    "HAVING sum(CASE WHEN y < -1.2 THEN 1 ELSE 0 END) >= 15 AND sum(CASE WHEN y < -1.2 THEN 0 ELSE 1 END) >= 15"
)
ORACLES["response_status"] = sql(
    """SELECT CAST(response_id AS INTEGER) AS response_id, response_name, coalesce(n, 0) AS n,
       CASE WHEN n >= 40 THEN k ELSE 0 END AS n_sensitive,
       CASE WHEN response_id = 6 THEN 'response absent' WHEN n IS NULL THEN 'no joined rows' WHEN n < 40 THEN 'insufficient samples'
            WHEN k < 5 OR n - k < 5 THEN 'class imbalance' ELSE '' END AS note
       FROM planned LEFT JOIN (
         SELECT response, count(*) AS n, count(*) FILTER (WHERE y <= q) AS k
         FROM jp JOIN (SELECT response, quantile_cont(y, 0.25) AS q FROM jp GROUP BY 1) USING (response) GROUP BY 1) USING (response)""",
    "\njp AS (SELECT * FROM pres WHERE entity_id IN (SELECT entity_id FROM flag))",
)
ORACLES["score_histogram"] = sql("SELECT hrd_score AS score, count(*) AS n FROM score GROUP BY 1")
ORACLES["score_stats"] = sql(
    "SELECT round(avg(hrd_score), 9) AS mean_score, round(stddev_samp(hrd_score), 9) AS std_score, "
    "max(hrd_score) AS max_score, count(DISTINCT entity_id) AS n_entities FROM score"
)
_MW = rank_sum_cte("cells", "response, feature")
ORACLES["mann_whitney"] = sql("SELECT response, feature, u_statistic, round(p_value, 9) AS p_value FROM mw", _MW)
ORACLES["mann_whitney_lineitem"] = (
    "WITH long AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, "
    "unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem), "
    "lc AS (SELECT feature, v, sum(label)::DOUBLE AS n1, sum(1 - label)::DOUBLE AS n0 FROM long GROUP BY 1, 2),"
    + rank_sum_cte("lc", "feature")
    + "\nSELECT feature, u_statistic, round(p_value, 9) AS p_value FROM mw"
)
ORACLES["bh_fdr"] = sql("SELECT response, feature, round(p_adjusted, 9) AS p_adjusted FROM bh", _MW + "," + BH)
ORACLES["significant_counts"] = sql(
    "SELECT response, count(*) AS n_features, count(*) FILTER (WHERE p_adjusted < 0.05) AS n_significant FROM bh GROUP BY 1",
    _MW + "," + BH,
)
ORACLES["bonferroni"] = sql(
    "SELECT CAST(response_id AS INTEGER) AS response_id, count(*) OVER () AS n_tests, "
    "CASE WHEN p * count(*) OVER () <= 0.05 THEN 1 ELSE 0 END AS significant FROM tailed JOIN planned USING (response)",
    corr_cte("ddr_burden"),
)
ORACLES["cohens_d"] = sql(
    "SELECT response, feature, round(d, 9) AS cohens_d, round(abs(d), 9) AS abs_cohens_d, "
    "round(m1, 9) AS mean_sensitive, round(m0, 9) AS mean_resistant FROM effect",
    EFFECT,
)
ORACLES["spearman"] = sql(
    "SELECT CAST(response_id AS INTEGER) AS response_id, response_name, coalesce(n, 0) AS n, round(rho, 9) AS spearman_rho, "
    "round(p, 9) AS p_value, CASE WHEN n IS NULL THEN 'response absent' ELSE '' END AS note FROM planned LEFT JOIN tailed USING (response)",
    corr_cte("hrd_score"),
)
ORACLES["spearman_scatter"] = sql(
    "SELECT response, entity_id, hrd_score AS score, round(y, 9) AS y FROM pres JOIN score USING (entity_id)"
)
ORACLES["subgroup_sensitivity"] = sql(
    "SELECT response, CAST(n1 AS BIGINT) AS n_member, CAST(n0 AS BIGINT) AS n_other, round(med1, 9) AS median_member, "
    "round(med0, 9) AS median_other, u_statistic, round(p_value, 9) AS p_value FROM mw JOIN ("
    "SELECT response, count(*) FILTER (WHERE msi_status = 1) AS n1, count(*) FILTER (WHERE msi_status = 0) AS n0, "
    "median(y) FILTER (WHERE msi_status = 1) AS med1, median(y) FILTER (WHERE msi_status = 0) AS med0 "
    "FROM pres JOIN score USING (entity_id) GROUP BY 1) USING (response)",
    "\nsub AS (SELECT response, y AS v, sum(msi_status)::DOUBLE AS n1, sum(1 - msi_status)::DOUBLE AS n0 "
    "FROM pres JOIN score USING (entity_id) GROUP BY 1, 2)," + rank_sum_cte("sub", "response"),
)
ORACLES["association_matrix"] = sql(
    "SELECT feature, "
    + ", ".join(f"round(max(d) FILTER (WHERE response = '{r}'), 9) AS r{r[0]}" for r in roles.RESPONSES)
    + " FROM effect GROUP BY 1",
    EFFECT,
)
ORACLES["stratified_folds"] = sql("SELECT response, label, entity_id, fold FROM fold")
ORACLES["balanced_weights"] = sql(
    "SELECT f.response, h.fold, f.label, any_value(t.n) AS n, count(*) AS n_class, "
    "round(any_value(t.n) / (2.0::DOUBLE * count(*)), 9) AS weight "
    "FROM fold f JOIN (SELECT DISTINCT fold FROM fold) h ON f.fold <> h.fold "
    "JOIN (SELECT a.response, h.fold, count(*) AS n FROM fold a JOIN (SELECT DISTINCT fold FROM fold) h ON a.fold <> h.fold GROUP BY 1, 2) t "
    "ON t.response = f.response AND t.fold = h.fold GROUP BY 1, 2, 3"
)
ORACLES["scaled_features"] = sql(
    """SELECT t.response, t.fold, t.feature, round(t.sd, 9) AS scale, round(h.m / t.sd, 9) AS mean_scaled_held_out FROM (
         SELECT f.response, h.fold, x.feature, CASE WHEN stddev_pop(x.v) > 0 THEN stddev_pop(x.v) ELSE 1 END AS sd
         FROM fold f JOIN (SELECT DISTINCT fold FROM fold) h ON f.fold <> h.fold JOIN feat x USING (entity_id) GROUP BY 1, 2, 3) t
       JOIN (SELECT f.response, f.fold, x.feature, avg(x.v) AS m FROM fold f JOIN feat x USING (entity_id) GROUP BY 1, 2, 3) h
       USING (response, fold, feature)"""
)
ORACLES["roc_points"] = "WITH" + QUALITY + """
SELECT 'n_chars' AS model, score::DOUBLE AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM pts, tot
UNION ALL SELECT 'n_chars', NULL, 0.0, 0.0"""
ORACLES["roc_auc"] = "WITH" + QUALITY + """
SELECT 'n_chars' AS model, (SELECT CAST(p AS BIGINT) FROM tot) AS n_pos, (SELECT CAST(n AS BIGINT) FROM tot) AS n_neg,
       round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 9) AS auc
FROM docs a JOIN docs b ON a.label = 1 AND b.label = 0"""
ORACLES["pr_points"] = "WITH" + QUALITY + """
SELECT 'n_chars' AS model, score::DOUBLE AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / p, 9) AS recall FROM pts, tot
UNION ALL SELECT 'n_chars', NULL, 1.0, 0.0"""
ORACLES["pr_auc"] = "WITH" + QUALITY + """,
line AS (
  SELECT tp / p AS r, tp / (tp + fp) AS pr, lag(tp / p, 1, 0.0) OVER (ORDER BY score DESC) AS r_before,
         lag(tp / (tp + fp), 1, 1.0) OVER (ORDER BY score DESC) AS pr_before FROM pts, tot)
SELECT 'n_chars' AS model, round(sum((r - r_before) * (pr + pr_before) / 2), 9) AS pr_auc_trapezoid FROM line"""
ORACLES["prevalence"] = sql("SELECT count(*) AS n, round(avg(label), 9) AS prevalence FROM scored", MODELS, recursive=True)
ORACLES["confusion"] = sql(
    "SELECT m.response, m.model, a.v AS actual, b.v AS predicted, count(s.label) AS n "
    "FROM (SELECT DISTINCT response, model FROM scored) m CROSS JOIN (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v) "
    "LEFT JOIN scored s ON s.response = m.response AND s.model = m.model AND s.label = a.v AND (s.prob > 0.5) = (b.v = 1) GROUP BY 1, 2, 3, 4",
    MODELS,
    recursive=True,
)
ORACLES["classification_metrics"] = sql(
    "SELECT response, model, fold, round(auc, 9) AS auc, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, "
    "round(recall, 9) AS recall, round(f1, 9) AS f1 FROM per_fold",
    MODELS,
    recursive=True,
)
ORACLES["model_comparison"] = sql("SELECT * FROM compared", MODELS, recursive=True)
ORACLES["best_model"] = sql(
    "SELECT response, model, "
    + ", ".join(f"round({m}, 9) AS {m}" for m in ("auc", "accuracy", "precision", "recall", "f1"))
    + " FROM (SELECT response, model, "
    + ", ".join(f"avg({m}) AS {m}" for m in ("auc", "accuracy", "precision", "recall", "f1"))
    + " FROM per_fold GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY response ORDER BY auc DESC, model = 'full') = 1",
    MODELS,
    recursive=True,
)
ORACLES["comparison_long"] = sql(
    " UNION ALL ".join(
        f"SELECT response, model, '{m}' AS metric, {m} AS value FROM compared" for m in ("auc", "accuracy", "precision", "recall", "f1")
    ),
    MODELS,
    recursive=True,
)
ORACLES["lr_closed_form"] = sql(
    "SELECT response, feature, round(intercept, 9) AS intercept, round(coefficient, 9) AS coefficient FROM closed", CLOSED
)
ORACLES["linear_attribution"] = sql("SELECT response, feature, round(mean_abs_shap, 9) AS mean_abs_shap FROM lin", CLOSED)
ORACLES["attribution_rows"] = sql(
    "SELECT l.response, l.entity_id, f.feature, f.v AS value, round(c.coefficient * (f.v - m.mv), 9) AS phi "
    "FROM lab l JOIN flag f USING (entity_id) JOIN (SELECT feature, avg(v) AS mv FROM flag GROUP BY 1) m ON m.feature = f.feature "
    "JOIN closed c ON c.response = l.response AND c.feature = f.feature",
    CLOSED,
)
ORACLES["biomarker_summary"] = sql(
    "SELECT response, feature, round(shap, 6) AS mean_abs_shap, u_statistic, round(p_value, 9) AS p_value, "
    "round(p_adjusted, 9) AS p_adjusted, round(d, 9) AS cohens_d, round(abs(d), 9) AS abs_cohens_d, "
    "shap_rank::DOUBLE AS shap_rank, pval_rank::DOUBLE AS pval_rank, effect_rank::DOUBLE AS effect_rank, "
    "(shap_rank + pval_rank + effect_rank)::DOUBLE AS composite_rank FROM summ",
    SUMMARY,
    recursive=True,
)
ORACLES["top_biomarkers"] = sql(
    "SELECT response, CAST(place AS INTEGER) AS place, feature, composite_rank FROM ("
    "SELECT response, feature, (shap_rank + pval_rank + effect_rank)::DOUBLE AS composite_rank, "
    "row_number() OVER (PARTITION BY response ORDER BY shap_rank + pval_rank + effect_rank, feature) AS place FROM summ) WHERE place <= 5",
    SUMMARY,
    recursive=True,
)
ORACLES["per_response_cv_auc"] = sql(
    "SELECT CAST(response_id AS INTEGER) AS response_id, response_name, coalesce(n, 0) AS n, coalesce(k, 0) AS n_sensitive, "
    "round(m, 6) AS cv_auc_mean, round(s, 6) AS cv_auc_std, CASE WHEN n IS NULL THEN 'response absent' ELSE '' END AS note "
    "FROM planned LEFT JOIN q_cv USING (response) LEFT JOIN (SELECT response, count(*) AS n, CAST(sum(label) AS BIGINT) AS k FROM quart GROUP BY 1) USING (response)",
    DESCENT,
    recursive=True,
)
ORACLES["attribution_best_response"] = sql(
    "SELECT p.response_name, h.feature, round(avg(abs(f.b[h.j] * (v.x[h.j] - m.mv))), 6) AS mean_abs_shap, "
    "0.0::DOUBLE AS mean_signed_shap "
    "FROM (SELECT response FROM q_cv JOIN planned USING (response) ORDER BY m DESC, response_id LIMIT 1) best "
    "JOIN planned p USING (response) JOIN final f ON f.response = best.response AND f.held = -1 "
    "JOIN qfold q ON q.response = best.response JOIN vec v ON v.entity_id = q.entity_id CROSS JOIN hr h "
    "JOIN (SELECT q.response, h.feature, avg(v.x[h.j]) AS mv FROM qfold q JOIN vec v USING (entity_id) CROSS JOIN hr h GROUP BY 1, 2) m "
    "ON m.response = best.response AND m.feature = h.feature GROUP BY 1, 2",
    DESCENT,
    recursive=True,
)
ORACLES["importance_fallback"] = sql(
    "SELECT f.response, h.feature, round(abs(f.b[h.j]) * sqrt(f.pen[h.j]), 6) AS mean_abs_shap, "
    "sign(f.b[h.j])::DOUBLE AS direction, 'coef fallback' AS note FROM final f CROSS JOIN hr h WHERE f.held = -1",
    DESCENT,
    recursive=True,
)
ORACLES["lr_select_c"] = sql("SELECT response, c, round(auc, 6) AS auc FROM chosen", SELECT_C, recursive=True)
ORACLES["lr_cv"] = sql(
    "SELECT response, round(avg(auc), 6) AS auc, round(avg((tp + tn) / (tp + fp + fn + tn)), 6) AS accuracy, "
    "round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS recall, "
    "round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS f1 "
    "FROM lr_hit JOIN outr_auc USING (response, held) GROUP BY 1",
    LR_CV,
    recursive=True,
)
ORACLES["feature_set_ablation"] = sql(
    "SELECT CAST(response_id AS INTEGER) AS response_id, response_name, n, n_sensitive, round(m1, 6) AS auc_base, round(s1, 6) AS std_base, "
    "round(m2, 6) AS auc_full, round(s2, 6) AS std_full, round(m2 - m1, 6) AS delta FROM planned "
    "JOIN (SELECT response, avg(auc) AS m1, stddev_pop(auc) AS s1 FROM base_auc GROUP BY 1) USING (response) "
    "JOIN (SELECT response, avg(auc) AS m2, stddev_pop(auc) AS s2 FROM wide_auc GROUP BY 1) USING (response) "
    "JOIN (SELECT response, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_sensitive FROM outer_quarters GROUP BY 1) USING (response)",
    SETS,
    recursive=True,
)
ORACLES["context_onehot"] = sql(
    "SELECT entity_id, " + ", ".join(f"CAST(context = '{c}' AS INTEGER) AS \"context_{c}\"" for c in roles.CONTEXTS) + " FROM ent"
)
ORACLES["score_ablation"] = sql(
    "SELECT CAST(response_id AS INTEGER) AS response_id, response_name, n, n_sensitive, round(auc_base, 9) AS auc_base, "
    "round(std_base, 9) AS std_base, round(auc_full, 9) AS auc_full, round(std_full, 9) AS std_full, round(delta, 9) AS delta FROM abl",
    ABLATION,
    recursive=True,
)
ORACLES["benchmark_report"] = sql(
    """SELECT 1 AS section, CAST(response_id AS BIGINT) AS key, printf('| %s | %d | %d | %.3f ± %.3f | %.3f ± %.3f | %+.3f |',
         response_name, n, n_sensitive, auc_base, std_base, auc_full, std_full, delta) AS line FROM abl
       UNION ALL SELECT 0, 0, '| Response | n | n_sens | AUC (HR) | AUC (full) | Δ AUC |'
       UNION ALL SELECT 0, 1, '| --- | ---: | ---: | ---: | ---: | ---: |'
       UNION ALL SELECT 2, 2, printf('**Mean AUC (HR): %.3f**', avg(auc_base)) FROM abl
       UNION ALL SELECT 2, 3, printf('**Mean AUC (full): %.3f**', avg(auc_full)) FROM abl
       UNION ALL SELECT 2, 4, printf('**Mean Δ: %+.3f AUC**', avg(auc_full) - avg(auc_base)) FROM abl""",
    ABLATION,
    recursive=True,
)
ORACLES["score_report"] = sql(
    f"""SELECT 0 AS section, CAST(0 AS BIGINT) AS key, printf('Entities analysed (N): %d', count(DISTINCT entity_id)) AS line FROM score
       UNION ALL SELECT 0, 1, '  available: {', '.join(roles.HR)}' UNION ALL SELECT 0, 2, '  missing: Brand#98'
       UNION ALL SELECT 1, CAST(hrd_score AS BIGINT), printf('  score=%d: n=%d', hrd_score, count(*)) FROM score GROUP BY hrd_score
       UNION ALL SELECT 2, 0, printf('  mean=%.3f  std=%.3f  max=%d', avg(hrd_score), stddev_samp(hrd_score), max(hrd_score)) FROM score
       UNION ALL SELECT 3, CAST(response_id AS BIGINT), printf('  %-12s (Drug %d): n=%4d', response_name, response_id, coalesce(n, 0))
         || '  rho=' || coalesce(printf('%+.3f', rho), '+nan') || '  p=' || coalesce(printf('%.3g', p), 'nan') || '  '
         || CASE WHEN n IS NULL THEN 'response absent' ELSE '' END FROM planned LEFT JOIN tailed USING (response)""",
    corr_cte("hrd_score"),
)
ORACLES["results_persist"] = sql(
    "SELECT response, model, fold, n, round(accuracy, 9) AS accuracy FROM per_fold JOIN "
    "(SELECT response, model, fold, count(*) AS n FROM scored GROUP BY 1, 2, 3) USING (response, model, fold)",
    MODELS,
    recursive=True,
)
ORACLES["models_persist"] = ORACLES["lr_cv"]
ORACLES["tree_local_accuracy"] = sql(
    "SELECT response, count(*) AS n_vectors, 0::BIGINT AS n_off FROM (SELECT DISTINCT l.response, v.x FROM lab l JOIN vec16 v USING (entity_id)) GROUP BY 1",
    f"\nvec16 AS (SELECT f.entity_id, [{_ALL}] AS x FROM feat f GROUP BY 1)",
)
ORACLES["boosted_persist"] = sql("SELECT response, count(*) AS n, 0::BIGINT AS n_off FROM lab GROUP BY 1")
_CELLS = "(SELECT DISTINCT response FROM lab) r CROSS JOIN (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v)"
ORACLES["oof_confusion"] = sql(
    f"SELECT r.response, a.v AS actual, b.v AS predicted, count(s.label) AS n FROM {_CELLS} "
    "LEFT JOIN outr_z s ON s.response = r.response AND s.label = a.v AND (s.z > 0) = (b.v = 1) GROUP BY 1, 2, 3",
    LR_CV,
    recursive=True,
)
ORACLES["resubstitution_confusion"] = sql(
    f"SELECT r.response, a.v AS actual, b.v AS predicted, count(s.label) AS n FROM {_CELLS} LEFT JOIN ("
    "SELECT q.response, q.label, list_dot_product(v.x, m.b) AS z FROM dealt q JOIN vec16 v USING (entity_id) "
    "JOIN outr m ON m.response = q.response AND m.held = -1) s "
    "ON s.response = r.response AND s.label = a.v AND (s.z > 0) = (b.v = 1) GROUP BY 1, 2, 3",
    LR_CV,
    recursive=True,
)
ORACLES["lr_nested_cv"] = ORACLES["lr_cv"].replace(LR_CV, NESTED).replace("FROM lr_hit JOIN outr_auc USING (response, held)", "FROM nhit JOIN nauc USING (response, fold)")
ORACLES["ablation_csv_report"] = ORACLES["benchmark_report"]
