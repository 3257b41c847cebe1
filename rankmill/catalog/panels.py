"""The annual panel over orders: entity (nation, customer), route = priority, year = order year.

Orders before 2001 are the held weight and those marked F carry a score; the 2001
orders supply the published counts, the capacities and part of the totals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollup
from ..plans import panel
from ..session import cut_lineage
from .registry import query, table

RULES = panel.PanelRules(
    quota_routes=("1-URGENT", "2-HIGH", "5-LOW"),
    sibling=("2-HIGH", "3-MEDIUM"),
    capacity_route="5-LOW",
    return_order=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"),
    complete_years={"1-URGENT": (1996, 1998)},
    total_names={"3-MEDIUM": "2-HIGH"},
    uncalibrated=("4-NOT SPECIFIED",),
)


def inputs(spark, d):
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("sub"), F.col("c_nationkey").alias("grp"), "c_mktsegment")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("sub"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("route"),
        "o_orderstatus", F.col("o_totalprice"), F.lit(1.0).alias("weight"),
    ).join(customers, "sub")
    rows = rows.withColumn("score", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 977))
    rows = rows.withColumn("label", F.concat("c_mktsegment", F.lit("-"), "route")).withColumn("source", F.col("o_orderstatus"))
    # All inputs of the panel come from this one reading of orders.
    rows = cut_lineage(rows.drop("c_mktsegment", "o_totalprice"))
    past, last = rows.where("year < 2001"), rows.where("year = 2001")
    quotas = last.groupBy("grp", "sub", "year").pivot("route", list(RULES.quota_routes)).agg(F.sum("weight"))
    capacities = last.where("route IN ('5-LOW', '4-NOT SPECIFIED')")
    named = F.when(F.col("route") == "3-MEDIUM", "2-HIGH").otherwise(F.col("route"))
    totals = rows.groupBy("year", named.alias("route")).agg((F.sum("weight") * 1.5).alias("total"))
    return past.where("o_orderstatus = 'F'"), past, quotas, capacities, totals, rows


def built(spark, d, stage, given=None):
    scored, seats, quotas, capacities, totals, _ = given or inputs(spark, d)
    return panel.build(scored, seats, quotas, capacities, totals, RULES, stage)


def shown(df):
    return df.withColumn("weight", F.round("weight", 4)).withColumn("ability", F.round("ability", 4))


BASE = """r AS (SELECT c_nationkey AS grp, o_custkey AS sub, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS route,
  1.0::DOUBLE AS weight, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 977 END AS score, o_orderstatus AS source,
  c_mktsegment || '-' || o_orderpriority AS label FROM orders JOIN customer ON c_custkey = o_custkey),
obs AS (SELECT grp, sub, year, route, sum(weight) AS weight, sum(score * weight) / sum(weight) FILTER (score IS NOT NULL) AS ability,
  'observed' AS weight_method, CASE WHEN count(score) > 0 THEN 'observed' ELSE '' END AS ability_method, count(*) AS input_rows
  FROM r WHERE year < 2001 GROUP BY 1, 2, 3, 4)"""
QUOTAS = BASE + """,
ql AS (SELECT grp, sub, year, p.route AS source_route, sum(CASE WHEN r.route = p.route THEN weight ELSE 0 END) AS quota
  FROM r, (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) p(route) WHERE year = 2001 GROUP BY 1, 2, 3, 4),
hist AS (SELECT grp, sub, list(DISTINCT route) AS routes, max(year) FILTER (route = '2-HIGH' AND weight > 0) AS py,
  max(year) FILTER (route = '3-MEDIUM' AND weight > 0) AS cy FROM obs GROUP BY 1, 2),
qr AS (SELECT ql.*, coalesce(routes, []) AS routes, CASE WHEN source_route = '2-HIGH' AND cy > coalesce(py, -1) THEN '3-MEDIUM'
  ELSE source_route END AS route FROM ql LEFT JOIN hist USING (grp, sub)),
qk AS (SELECT * FROM qr WHERE quota > 0 OR list_contains(routes, route)),
qc AS (SELECT grp, sub, year, route, quota FROM qk UNION ALL SELECT grp, sub, year,
  CASE WHEN route = '2-HIGH' THEN '3-MEDIUM' ELSE '2-HIGH' END, 0 FROM qk WHERE source_route = '2-HIGH'
  AND list_contains(routes, CASE WHEN route = '2-HIGH' THEN '3-MEDIUM' ELSE '2-HIGH' END)),
c1 AS (SELECT grp, sub, year, route, coalesce(quota, weight) AS weight, ability,
  CASE WHEN quota IS NOT NULL THEN 'moe_quota' ELSE weight_method END AS weight_method, coalesce(ability_method, '') AS ability_method,
  CAST(coalesce(input_rows, 0) AS BIGINT) AS input_rows FROM obs FULL JOIN qc USING (grp, sub, year, route))"""
CAPS = QUOTAS + """,
cap AS (SELECT grp, sub, year, sum(weight) AS cap, count(*) AS n FROM r WHERE year = 2001 AND route IN ('5-LOW', '4-NOT SPECIFIED')
  AND year NOT IN (SELECT year FROM c1 WHERE route = '5-LOW' AND weight_method = 'observed') GROUP BY 1, 2, 3),
c2 AS (SELECT c1.* REPLACE (CASE WHEN c1.route = '5-LOW' AND c1.year IN (SELECT year FROM cap) AND cap IS NULL THEN 0 ELSE c1.weight END AS weight,
  CASE WHEN c1.route = '5-LOW' AND c1.year IN (SELECT year FROM cap) AND cap IS NULL THEN 'uac_post_return' ELSE c1.weight_method END AS weight_method)
  FROM c1 LEFT JOIN cap USING (grp, sub, year)),
gr AS (SELECT cap.grp, cap.sub, cap.year, cap - coalesce(c2.weight, 0) AS want FROM cap LEFT JOIN c2 ON c2.grp = cap.grp AND c2.sub = cap.sub
  AND c2.year = cap.year AND c2.route = '5-LOW'),
mv AS (SELECT c2.*, CASE WHEN c2.route <> '5-LOW' THEN greatest(0, least(coalesce(c2.weight, 0), coalesce(want, 0) - coalesce(sum(CASE WHEN c2.route <> '5-LOW'
  THEN coalesce(c2.weight, 0) ELSE 0 END) OVER (PARTITION BY c2.grp, c2.sub, c2.year ORDER BY c2.route ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
  ELSE 0 END AS moved FROM c2 LEFT JOIN gr USING (grp, sub, year)),
c3 AS (SELECT grp, sub, year, route, CASE WHEN route = '5-LOW' THEN coalesce(cap, mv.weight) ELSE mv.weight - coalesce(moved, 0) END AS weight, ability,
  CASE WHEN route = '5-LOW' AND cap IS NOT NULL THEN 'uac_post_return' WHEN moved > 0 THEN weight_method || '-uac_return_estimate' ELSE weight_method END AS weight_method,
  coalesce(ability_method, '') AS ability_method, CAST(coalesce(cp.n, input_rows, 0) AS BIGINT) AS input_rows
  FROM mv FULL JOIN (SELECT *, '5-LOW' AS route FROM cap) cp USING (grp, sub, year, route))"""
DENSE = CAPS + """,
sp AS (SELECT grp, sub, min(year) AS lo, max(year) AS hi FROM c3 GROUP BY 1, 2),
g AS (SELECT sp.grp, sp.sub, CAST(y.year AS INTEGER) AS year, rr.route FROM sp JOIN (SELECT unnest(range(1990, 2010)) AS year) y
  ON y.year BETWEEN lo AND hi JOIN (SELECT DISTINCT grp, sub, route FROM c3) rr ON rr.grp = sp.grp AND rr.sub = sp.sub),
cov AS (SELECT DISTINCT grp, year, route, 1 AS yes FROM r WHERE year < 2001),
c4 AS (SELECT g.grp, g.sub, g.year, g.route,
  CASE WHEN c3.grp IS NULL AND (yes = 1 OR g.route = '1-URGENT' AND g.year BETWEEN 1996 AND 1998) THEN 0 ELSE c3.weight END AS weight, ability,
  CASE WHEN c3.grp IS NULL AND (yes = 1 OR g.route = '1-URGENT' AND g.year BETWEEN 1996 AND 1998) THEN 'structural_zero'
    WHEN c3.grp IS NULL THEN '' ELSE weight_method END AS weight_method,
  coalesce(ability_method, '') AS ability_method, CAST(coalesce(input_rows, 0) AS BIGINT) AS input_rows
  FROM g LEFT JOIN c3 ON c3.grp = g.grp AND c3.sub = g.sub AND c3.year = g.year AND c3.route = g.route
  LEFT JOIN cov ON cov.grp = g.grp AND cov.year = g.year AND cov.route = g.route)"""


def _fill(source: str, target: str, value: str) -> str:
    lo = f"last_value({{}} IGNORE NULLS) OVER (PARTITION BY grp, sub, route ORDER BY year ROWS UNBOUNDED PRECEDING)"
    hi = f"first_value({{}} IGNORE NULLS) OVER (PARTITION BY grp, sub, route ORDER BY year ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    year = f"CASE WHEN {value} IS NOT NULL THEN year END"
    return f""",
{target}_n AS (SELECT *, {lo.format(year)} AS y0, {lo.format(value)} AS v0, {hi.format(year)} AS y1, {hi.format(value)} AS v1 FROM {source}),
{target} AS (SELECT * EXCLUDE (y0, v0, y1, v1) REPLACE (CASE WHEN {value} IS NOT NULL THEN {value} WHEN y0 IS NULL THEN v1 WHEN y1 IS NULL THEN v0
  ELSE v0 + (v1 - v0) * CAST(year - y0 AS DOUBLE) / (y1 - y0) END AS {value},
  CASE WHEN {value} IS NOT NULL THEN {value}_method WHEN y0 IS NOT NULL AND y1 IS NOT NULL THEN 'interpolated:' || y0 || ',' || y1
  WHEN y0 IS NOT NULL OR y1 IS NOT NULL THEN 'nearest:' || coalesce(y0, y1) ELSE {value}_method END AS {value}_method) FROM {target}_n)"""


FILLED = DENSE + _fill("c4", "c5", "weight") + _fill("c5", "c6", "ability")
_LEVELS = [("department_year", "grp, sub, year"), ("department", "grp, sub"), ("school_route_year", "grp, route, year"),
           ("school_year", "grp, year"), ("school_route", "grp, route"), ("school", "grp"), ("route_year", "route, year"), ("year", "year")]
FALLBACK = FILLED + ",\nlive AS (SELECT * FROM c6 WHERE ability IS NOT NULL AND weight > 0)" + "".join(
    f",\nf{i} AS (SELECT {k}, sum(ability * weight) / sum(weight) AS m{i} FROM live GROUP BY {k})" for i, (_, k) in enumerate(_LEVELS)
) + ",\nf8 AS (SELECT sum(ability * weight) / sum(weight) AS m8 FROM live),\nc7 AS (SELECT c6.* REPLACE (coalesce(ability, " + ", ".join(
    f"m{i}" for i in range(9)) + ") AS ability, CASE WHEN ability IS NOT NULL THEN ability_method " + " ".join(
    f"WHEN m{i} IS NOT NULL THEN '{n}'" for i, (n, _) in enumerate(_LEVELS)) + " ELSE 'national' END AS ability_method) FROM c6 " + " ".join(
    f"LEFT JOIN f{i} USING ({k})" for i, (_, k) in enumerate(_LEVELS)) + " CROSS JOIN f8)"
CALIBRATED = FALLBACK + """,
tt AS (SELECT year, CASE WHEN route = '3-MEDIUM' THEN '2-HIGH' ELSE route END AS tr, sum(weight) * 1.5 AS target FROM r GROUP BY 1, 2),
bs AS (SELECT year, CASE WHEN route = '3-MEDIUM' THEN '2-HIGH' ELSE route END AS tr, sum(coalesce(weight, 0)) AS base,
  sum(CASE WHEN weight_method LIKE 'interpolated%' OR weight_method LIKE 'nearest%' THEN coalesce(weight, 0) ELSE 0 END) AS est FROM c7 GROUP BY 1, 2),
sc AS (SELECT year, tr, (target - base + est) / est AS scale FROM bs JOIN tt USING (year, tr) WHERE base > 0 AND est > 0
  AND target >= base - est AND tr <> '4-NOT SPECIFIED'),
c8 AS (SELECT c7.* REPLACE (CASE WHEN i THEN c7.weight * scale ELSE c7.weight END AS weight,
  CASE WHEN i AND abs(scale - 1) > 1e-9 THEN weight_method || '+national_scale' ELSE weight_method END AS weight_method),
  CASE WHEN i THEN scale ELSE 1.0 END AS weight_scale FROM (SELECT c7.*, scale, scale IS NOT NULL AND
  (weight_method LIKE 'interpolated%' OR weight_method LIKE 'nearest%') AS i FROM c7 LEFT JOIN sc ON sc.year = c7.year
  AND sc.tr = CASE WHEN c7.route = '3-MEDIUM' THEN '2-HIGH' ELSE c7.route END) c7)"""
CALIBRATED = CALIBRATED.replace("SELECT c7.* REPLACE (CASE WHEN i THEN", "SELECT c7.* EXCLUDE (scale, i) REPLACE (CASE WHEN i THEN")
COLUMNS = """grp, sub, year, route, round(weight, 4) AS weight, round(ability, 4) AS ability, weight_method, ability_method, input_rows"""


@query("n1_weight_evidence", f"WITH {BASE} SELECT grp, sub, year, route, weight FROM r WHERE year < 2001")
def weight_evidence(spark, d):
    """Route-specific weight columns of several sources in one row shape."""
    from ..sources.tables import union_sources

    rows = inputs(spark, d)[1]
    shape = ["grp", "sub", "year", "route", "weight"]
    per_route = [
        rows.where(F.col("route") == r).select("grp", "sub", "year", F.lit(r).alias("route"), F.col("weight").alias(name))
        for r, name in (("1-URGENT", "seats"), ("2-HIGH", "admitted"), ("3-MEDIUM", "quota"), ("4-NOT SPECIFIED", "n"), ("5-LOW", "held"))
    ]
    return union_sources([(df, {"weight": F.col(df.columns[-1])}) for df in per_route], shape).where("weight > 0")


@query("n2_observed_cells", f"WITH {BASE} SELECT {COLUMNS} FROM obs")
def observed(spark, d):
    return shown(built(spark, d, "observed"))


@query("n3_quota_override", f"WITH {QUOTAS} SELECT {COLUMNS} FROM c1")
def quota_override(spark, d):
    return shown(built(spark, d, "quotas"))


@query("n4_capacity_override", f"WITH {CAPS} SELECT {COLUMNS} FROM c3")
def capacity_override(spark, d):
    return shown(built(spark, d, "capacities"))


@query("n5_densify", f"WITH {DENSE} SELECT {COLUMNS} FROM c4")
def densify(spark, d):
    return shown(built(spark, d, "dense"))


@query("n6_fill_own_series", f"WITH {FILLED} SELECT {COLUMNS} FROM c6")
def fill_own_series(spark, d):
    return shown(built(spark, d, "filled"))


@query("n7_fallback_scores", f"WITH {FALLBACK} SELECT {COLUMNS} FROM c7")
def fallback_scores(spark, d):
    return shown(built(spark, d, "fallback"))


@query("n8_calibrate_totals", f"WITH {CALIBRATED} SELECT {COLUMNS}, round(weight_scale, 6) AS weight_scale FROM c8")
def calibrate_totals(spark, d):
    return shown(built(spark, d, "all")).withColumn("weight_scale", F.round("weight_scale", 6))


@query("n9_panel_rows", f"""WITH {CALIBRATED},
yn AS (SELECT grp, sub, year, string_agg(DISTINCT source, ' | ' ORDER BY source) AS names FROM r GROUP BY 1, 2, 3),
lb AS (SELECT DISTINCT ON (grp, sub) grp, sub, label FROM r ORDER BY grp, sub, year DESC, weight DESC, label DESC),
ny AS (SELECT DISTINCT ON (c.grp, c.sub, c.year) c.grp, c.sub, c.year, names FROM (SELECT DISTINCT grp, sub, year FROM c8) c
  JOIN yn ON yn.grp = c.grp AND yn.sub = c.sub ORDER BY c.grp, c.sub, c.year, abs(yn.year - c.year), yn.year)
SELECT year, grp, sub, names AS year_name, label, route, round(weight, 2) AS weight, round(ability, 3) AS ability, weight_method,
  round(weight_scale, 6) AS weight_scale, ability_method, input_rows FROM c8 JOIN ny USING (grp, sub, year) JOIN lb USING (grp, sub)""")
def panel_rows(spark, d):
    given = inputs(spark, d)
    return panel.output_rows(built(spark, d, "all", given), given[5])


@query("n10_entity_ranking", f"""WITH {CALIBRATED},
a AS (SELECT grp, round(sum(ability * weight) FILTER (weight > 0 AND ability IS NOT NULL) / sum(weight) FILTER (weight > 0 AND ability IS NOT NULL), 2) AS score,
  count(DISTINCT year) AS years, CAST(max(year) AS INTEGER) AS last_year, round(sum(weight) FILTER (weight > 0) / count(DISTINCT year), 1) AS weight_avg FROM c8 GROUP BY 1),
dr AS (SELECT grp, round(avg(score) FILTER (route = '1-URGENT'), 4) AS urgent, round(avg(score) FILTER (route = '5-LOW'), 4) AS low FROM r
  WHERE year < 2001 AND score IS NOT NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY score DESC, grp) AS rank, a.*, urgent, low,
  round(CASE WHEN urgent IS NOT NULL AND low IS NOT NULL THEN abs(urgent - low) END, 4) AS spread FROM a LEFT JOIN dr USING (grp)""")
def entity_ranking(spark, d):
    given = inputs(spark, d)
    scored = given[0].where("route IN ('1-URGENT', '5-LOW')")
    direct = rollup.readings(scored, ["grp"], "route", ["1-URGENT", "5-LOW"], "score", "weight")
    direct = direct.select("grp", F.round("1-URGENT", 4).alias("urgent"), F.round("5-LOW", 4).alias("low"))
    direct = direct.withColumn("spread", F.round(rollup.spread(F.col("urgent"), F.col("low")), 4))
    out = panel.rank_entities(built(spark, d, "all", given), direct, ["grp"])
    return out.select("rank", "grp", "score", "years", "last_year", F.round("weight_avg", 1).alias("weight_avg"), "urgent", "low", "spread")


@query("a6_fallback_means", f"""WITH {FILLED}, live AS (SELECT * FROM c6 WHERE ability IS NOT NULL AND weight > 0)
SELECT grp, sub, route, year, round(sum(ability * weight) / sum(weight), 4) AS mean,
CAST(CASE grouping_id(grp, sub, route, year) WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 3 WHEN 5 THEN 4 WHEN 7 THEN 5
  WHEN 12 THEN 6 WHEN 14 THEN 7 ELSE 8 END AS INTEGER) AS level FROM live GROUP BY GROUPING SETS ((grp, sub, year), (grp, sub),
  (grp, route, year), (grp, year), (grp, route), (grp), (route, year), (year), ())""")
def fallback_means(spark, d):
    return panel.fallback_means(cut_lineage(built(spark, d, "filled"))).withColumn("mean", F.round("mean", 4))


@query("w10_series_gap_fill", "WITH " + DENSE + """,
s AS (SELECT grp, sub, route, year, weight, weight_method FROM c4)""" + _fill("s", "o", "weight") + """
SELECT grp, sub, route, year, round(weight, 6) AS weight, weight_method FROM o""")
def series_gap_fill(spark, d):
    from ..operators.interp import fill_series

    cells = built(spark, d, "dense").select("grp", "sub", "route", "year", "weight", "weight_method")
    out = fill_series(cells, ["grp", "sub", "route"], "year", "weight", "weight_method")
    return out.withColumn("weight", F.round("weight", 6))


@query("w15_priority_deduction", """WITH c AS (SELECT o_custkey, o_orderpriority AS route, CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY 1, 2),
w AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) / 2 AS want FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
m AS (SELECT c.*, CASE WHEN route = '5-LOW' THEN 0 ELSE greatest(0, least(weight, coalesce(want, 0) - coalesce(sum(CASE WHEN route <> '5-LOW' THEN weight END)
  OVER (PARTITION BY o_custkey ORDER BY route ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS moved FROM c LEFT JOIN w USING (o_custkey))
SELECT o_custkey, route, weight - moved AS weight, CASE WHEN moved > 0 THEN 'held-returned' ELSE 'held' END AS method FROM m""")
def priority_deduction(spark, d):
    from ..operators.allocate import deduct_by_priority

    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "route")
    cells = orders.groupBy("o_custkey", "route").agg(F.count("*").cast("double").alias("weight")).withColumn("method", F.lit("held"))
    wants = orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg((F.count("*") / 2).alias("want"))
    return deduct_by_priority(cells, wants, ["o_custkey"], "route", RULES.return_order, "weight", "method", "want", "-returned")
