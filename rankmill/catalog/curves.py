"""Tiling, monotone curves, formula inversion and ordered walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formula, hist, interp, intervals, tiling
from ..operators.allocate import consume
from ..session import cut_lineage
from .registry import query, table


def pchip_sql(source: str, key: str) -> str:
    """CTEs ``{source}_s`` (segments with slopes) for knots (key, x, y) in ``source``."""
    over = f"OVER (PARTITION BY {key} ORDER BY x)"

    def end(h, hn, d, dn):
        raw = f"(((2 * {h} + {hn}) * {d} - {h} * {dn}) / ({h} + {hn}))"
        return (f"CASE WHEN {dn} IS NULL THEN {d} WHEN sign({raw}) <> sign({d}) THEN 0 "
                f"WHEN sign({d}) <> sign({dn}) AND abs({raw}) > 3 * abs({d}) THEN 3 * {d} ELSE {raw} END")

    return f"""{source}_h AS (SELECT *, lead(x) {over} - x AS h, (lead(y) {over} - y) / (lead(x) {over} - x) AS d FROM {source}),
{source}_w AS (SELECT *, lag(h) {over} AS h0, lag(d) {over} AS d0, lead(h) {over} AS h2, lead(d) {over} AS d2,
  lag(h, 2) {over} AS h00, lag(d, 2) {over} AS d00 FROM {source}_h),
{source}_k AS (SELECT {key}, x, y, CASE WHEN d0 IS NULL AND d IS NULL THEN 0 WHEN d0 IS NULL THEN {end('h', 'h2', 'd', 'd2')}
  WHEN d IS NULL THEN {end('h0', 'h00', 'd0', 'd00')} WHEN d0 * d <= 0 THEN 0
  ELSE (3 * h + 3 * h0) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) END AS s FROM {source}_w),
{source}_s AS (SELECT {key}, x AS x0, y AS y0, s AS s0, lead(x) {over} AS x1, lead(y) {over} AS y1, lead(s) {over} AS s1,
  row_number() {over} = 1 AS head, row_number() {over} = count(*) OVER (PARTITION BY {key}) - 1 AS tail FROM {source}_k)"""


def hermite_sql(at: str) -> str:
    t, h = f"(({at} - x0) / (x1 - x0))", "(x1 - x0)"
    return (f"((1 + 2 * {t}) * (1 - {t}) * (1 - {t}) * y0 + {t} * (1 - {t}) * (1 - {t}) * {h} * s0 "
            f"+ {t} * {t} * (3 - 2 * {t}) * y1 + {t} * {t} * ({t} - 1) * {h} * s1)")


def on_segment(at: str) -> str:
    return f"x1 IS NOT NULL AND (head OR {at} >= x0) AND (tail OR {at} < x1)"


@query("w4_tiling", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, round(1 - CAST(sum(length(o_orderpriority)) OVER (PARTITION BY year(o_orderdate)
ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(length(o_orderpriority)) OVER (PARTITION BY year(o_orderdate)), 9) AS level FROM orders""")
def tile(spark, d):
    placed = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"), "o_totalprice",
                                              F.length("o_orderpriority").alias("w"))
    out = tiling.tile(placed, ["yr"], "o_totalprice", ["o_orderkey"], "w")
    return out.select("o_orderkey", "yr", F.round("level", 9).alias("level"))


def margins(spark, d):
    """(year, nation, supplier, flag) rows with a bar: the share above the rounded mean quantity in its histogram."""
    lines = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("scale"),
                                               F.col("l_linestatus").alias("route"), "l_quantity", "l_discount")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("grp"))
    cells = lines.groupBy("year", "l_suppkey", "scale", "route").agg(
        F.round(F.avg("l_quantity")).alias("level"), F.count("*").cast("double").alias("weight"), F.max("l_discount").alias("most"))
    h = hist.histogram(lines, ["year", "scale"], "l_quantity")
    read = hist.top_share(cells, h, ["year", "scale"], "level", "l_quantity")
    # Cells whose best discount is low publish no bar.
    read = read.withColumn("top", F.when(F.col("most") > 0.06, F.col("top")))
    return read.join(supplier, "l_suppkey").select(
        F.concat_ws("-", "year", "l_suppkey", "scale", "route").alias("id"), "year", "grp", F.col("l_suppkey").alias("sub"),
        "route", "scale", "top", "weight")


MARGINS = """hq AS (SELECT year(l_shipdate) AS year, l_returnflag AS scale, l_quantity AS q, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2, 3),
ce AS (SELECT year(l_shipdate) AS year, l_suppkey AS sub, l_returnflag AS scale, l_linestatus AS route, round(avg(l_quantity)) AS level,
  CAST(count(*) AS DOUBLE) AS weight, max(l_discount) AS most FROM lineitem GROUP BY 1, 2, 3, 4),
mt AS (SELECT ce.year, sub, ce.scale, route, level, weight, most, sum(CASE WHEN q > level THEN n WHEN q = level THEN n / 2 ELSE 0 END) / sum(n) AS t
  FROM ce JOIN hq ON hq.year = ce.year AND hq.scale = ce.scale GROUP BY ALL),
m AS (SELECT mt.year || '-' || sub || '-' || scale || '-' || route AS id, CAST(mt.year AS INTEGER) AS year, s_nationkey AS grp, sub, route, scale,
  CASE WHEN most > 0.06 THEN t END AS top, weight FROM mt JOIN supplier ON s_suppkey = sub)"""
PLACED = MARGINS + """,
lv AS (SELECT *, 1 - top AS lev FROM m),
sb AS (SELECT year, grp, sub, sum(lev * weight) / sum(weight) AS ms FROM lv WHERE lev IS NOT NULL GROUP BY 1, 2, 3),
gb AS (SELECT year, grp, sum(lev * weight) / sum(weight) AS mg FROM lv WHERE lev IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS route, 1.5 * count(*) AS total FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
pr AS (SELECT lv.*, coalesce(lev, ms, mg) AS score FROM lv LEFT JOIN sb USING (year, grp, sub) LEFT JOIN gb USING (year, grp)),
hd AS (SELECT year, route, sum(weight) AS held FROM pr WHERE score IS NOT NULL GROUP BY 1, 2),
pl AS (SELECT pr.*, weight * coalesce(total / held, 1) AS pw FROM pr JOIN hd USING (year, route) LEFT JOIN tot USING (year, route) WHERE score IS NOT NULL)"""


def totals_by_route(spark, d):
    return table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(
        F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("route")).agg((F.count("*") * 1.5).alias("total"))


def placed_rows(spark, d):
    rows = cut_lineage(margins(spark, d)).withColumn("lev", 1.0 - F.col("top"))
    return tiling.place(rows, totals_by_route(spark, d), year="year", group="grp", subgroup="sub", route="route", scale="scale",
                        level="lev", weight="weight")


@query("w5_place_rows", f"WITH {PLACED} SELECT id, round(score, 9) AS score, round(pw, 6) AS placed_weight FROM pl")
def place_rows(spark, d):
    return placed_rows(spark, d).select("id", F.round("score", 9).alias("score"), F.round("placed_weight", 6).alias("placed_weight"))


@query("w6_tie_pooled_points", f"""WITH {MARGINS} SELECT scale, round(top, 9) AS x, round(sum(weight * grp) / sum(weight), 9) AS y, sum(weight) AS w
FROM m WHERE top IS NOT NULL GROUP BY 1, 2""")
def tie_pooled_points(spark, d):
    rows = margins(spark, d).where("top is not null").withColumn("top", F.round("top", 9))
    out = tiling.pooled(rows, ["scale"], "top", "grp", "weight")
    return out.select("scale", "x", F.round("y", 9).alias("y"), "w")


@query("w7_knot_thinning", """WITH c AS (SELECT l_returnflag AS scale, l_quantity AS x, avg(l_discount) AS y, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER o AS reach, sum(w) OVER (PARTITION BY scale) AS total, row_number() OVER o AS i FROM c WINDOW o AS (PARTITION BY scale ORDER BY x))
SELECT scale, x, round(y, 9) AS y, w FROM r WHERE i = 1 OR len(list_filter(range(1, 10), lambda j: j / 9.0 * total > reach - w AND (j / 9.0 * total <= reach OR j = 9 AND reach >= total))) > 0""")
def knot_thinning(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("scale"), F.col("l_quantity").alias("x")).agg(
        F.avg("l_discount").alias("y"), F.count("*").cast("double").alias("w"))
    return tiling.knots(c, ["scale"], 10).withColumn("y", F.round("y", 9))


ANTITONIC = """c AS (SELECT l_returnflag AS scale, l_quantity AS x, avg(l_discount) AS y, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
cs AS (SELECT scale, x, w, sum(w) OVER o AS sw, sum(w * y) OVER o AS sy FROM c WINDOW o AS (PARTITION BY scale ORDER BY x)),
bl AS (SELECT a.scale, a.x AS xa, b.x AS xb, (b.sy - a.sy + a.w * ya.y) / (b.sw - a.sw + a.w) AS mean FROM cs a JOIN c ya ON ya.scale = a.scale AND ya.x = a.x
  JOIN cs b ON b.scale = a.scale AND b.x >= a.x),
ia AS (SELECT scale, x, min(mx) AS y FROM (SELECT c.scale, c.x, xa, max(mean) AS mx FROM c JOIN bl ON bl.scale = c.scale AND xa <= c.x AND xb >= c.x GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("m1_antitonic_regression", f"WITH {ANTITONIC} SELECT scale, x, round(y, 9) AS y FROM ia")
def antitonic_regression(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("scale"), F.col("l_quantity").alias("x")).agg(
        F.avg("l_discount").alias("y"), F.count("*").cast("double").alias("w"))
    return tiling.antitonic(c, ["scale"]).select("scale", "x", F.round("y", 9).alias("y"))


FLAG_CURVE = """c AS (SELECT l_returnflag AS f, l_discount AS v, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT f, v * 10 AS x, sum(n) OVER (PARTITION BY f ORDER BY v) / sum(n) OVER (PARTITION BY f) AS y FROM c), """ + pchip_sql("k", "f")


def flag_curve(spark, d):
    h = hist.histogram(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "f"), ["f"], "l_discount")
    k = hist.intervals(h, ["f"], "l_discount").select("f", (F.col("l_discount") * 10).alias("x"), F.col("hi").alias("y"))
    return interp.pchip_slopes(k, ["f"], "x", "y")


@query("m2_pchip_curve", f"WITH {FLAG_CURVE} SELECT f, x, y, round(s, 8) AS slope FROM k_k".replace("x, y,", "round(x, 9) AS x, round(y, 9) AS y,"))
def pchip_curve(spark, d):
    return flag_curve(spark, d).select("f", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("slope", 8).alias("slope"))


@query("m3_read_bars", f"""WITH {FLAG_CURVE} SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, {hermite_sql('l_tax * 12.37')})), 8) AS level
FROM lineitem JOIN k_s ON f = l_returnflag AND {on_segment('l_tax * 12.37')}""")
def read_bars(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("f"), "l_tax")
    out = interp.read_curve(lines, flag_curve(spark, d), ["f"], F.col("l_tax") * 12.37, "level")
    return out.select("l_orderkey", "l_linenumber", F.round("level", 8).alias("level"))


@query("m3_fixed_targets", f"""WITH {FLAG_CURVE} SELECT f, CAST(t AS DOUBLE) AS target, round(greatest(0, least(1, {hermite_sql('(1 - t)')})), 8) AS level
FROM (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75]) AS t) JOIN k_s ON {on_segment('(1 - t)')}""")
def fixed_targets(spark, d):
    out = tiling.fixed_targets(flag_curve(spark, d), ["f"], (0.01, 0.05, 0.10, 0.25, 0.50, 0.75))
    return out.withColumn("level", F.round("level", 8))


@query("m4_fixed_point")
def fixed_point(spark, d):
    """Every (year, flag) curve and row level at the fixed point of placing and reading."""
    _, levels, rounds = tiling.fixed_point(margins(spark, d), totals_by_route(spark, d), None)
    return levels.select("id", "year", "scale", "top", F.round("level", 6).alias("level"), F.lit(rounds).alias("rounds"))


def _round_sql(n: int) -> str:
    """One round of placing, tiling, pooling, thinning and reading: levels ``lv{n}`` to ``lv{n + 1}``."""
    by = "PARTITION BY year, scale"
    return f"""sb{n} AS MATERIALIZED (SELECT year, grp, sub, sum(lev * weight) / sum(weight) AS ms FROM lv{n} WHERE lev IS NOT NULL GROUP BY 1, 2, 3),
gb{n} AS MATERIALIZED (SELECT year, grp, sum(lev * weight) / sum(weight) AS mg FROM lv{n} WHERE lev IS NOT NULL GROUP BY 1, 2),
pr{n} AS MATERIALIZED (SELECT lv{n}.*, coalesce(lev, ms, mg) AS score FROM lv{n} LEFT JOIN sb{n} USING (year, grp, sub) LEFT JOIN gb{n} USING (year, grp)),
hd{n} AS MATERIALIZED (SELECT year, route, sum(weight) AS held FROM pr{n} WHERE score IS NOT NULL GROUP BY 1, 2),
pl{n} AS MATERIALIZED (SELECT pr{n}.*, weight * coalesce(total / held, 1) AS pw FROM pr{n} JOIN hd{n} USING (year, route) LEFT JOIN tot USING (year, route) WHERE score IS NOT NULL),
ti{n} AS MATERIALIZED (SELECT *, 1 - sum(pw) OVER (PARTITION BY year ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) / sum(pw) OVER (PARTITION BY year) AS tl FROM pl{n}),
c{n} AS MATERIALIZED (SELECT year, scale, top AS x, sum(pw * tl) / sum(pw) AS y, sum(pw) AS w FROM ti{n} WHERE top IS NOT NULL GROUP BY 1, 2, 3),
cs{n} AS MATERIALIZED (SELECT *, sum(w) OVER o AS sw, sum(w * y) OVER o AS sy FROM c{n} WINDOW o AS ({by} ORDER BY x)),
bl{n} AS MATERIALIZED (SELECT a.year, a.scale, a.x AS xa, b.x AS xb, (b.sy - a.sy + a.w * a.y) / (b.sw - a.sw + a.w) AS mean FROM cs{n} a JOIN cs{n} b ON b.year = a.year AND b.scale = a.scale AND b.x >= a.x),
ia{n} AS MATERIALIZED (SELECT year, scale, x, w, min(mx) AS y FROM (SELECT c.year, c.scale, c.x, c.w, xa, max(mean) AS mx FROM c{n} c JOIN bl{n} bl ON bl.year = c.year AND bl.scale = c.scale AND xa <= c.x AND xb >= c.x GROUP BY ALL) GROUP BY ALL),
re{n} AS MATERIALIZED (SELECT year, scale, 1 - x AS x, y, w, sum(w) OVER o AS reach, sum(w) OVER ({by}) AS total, row_number() OVER o AS i, count(*) OVER ({by}) AS n FROM ia{n} WINDOW o AS ({by} ORDER BY 1 - x)),
kn{n} AS MATERIALIZED (SELECT year, scale, x, y FROM re{n} WHERE n <= 10 OR i = 1 OR len(list_filter(range(1, 10), lambda j: j / 9.0 * total > reach - w AND (j / 9.0 * total <= reach OR j = 9 AND reach >= total))) > 0),
{pchip_sql(f"kn{n}", "year, scale")},
on{n} AS MATERIALIZED (SELECT year, scale, max(y) AS only_y FROM kn{n} GROUP BY 1, 2 HAVING count(*) = 1),
lv{n + 1} AS MATERIALIZED (SELECT m.*, CASE WHEN top IS NOT NULL THEN greatest(0, least(1, coalesce({hermite_sql('(1 - top)')}, only_y))) END AS lev
  FROM m LEFT JOIN kn{n}_s k ON k.year = m.year AND k.scale = m.scale AND {on_segment('(1 - top)')} LEFT JOIN on{n} o ON o.year = m.year AND o.scale = m.scale)"""


@query("m4_three_rounds", f"""WITH {MARGINS}, lv0 AS MATERIALIZED (SELECT *, 1 - top AS lev FROM m),
tot AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_linestatus AS route, 1.5 * count(*) AS total FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
{_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)} SELECT id, year, scale, round(lev, 6) AS level FROM lv3""")
def three_rounds(spark, d):
    """Levels after three rounds, none settled before."""
    _, levels, _ = tiling.fixed_point(margins(spark, d), totals_by_route(spark, d), None, rounds=3, tolerance=0.0)
    return levels.select("id", "year", "scale", F.round("level", 6).alias("level"))


CARRIED = """p AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderstatus AS st, CAST(length(o_orderpriority) AS DOUBLE) AS w,
  o_totalprice, o_orderkey FROM orders), r AS (SELECT *, sum(w) OVER o AS hi, sum(w) OVER (PARTITION BY yr) AS total,
  sum(CASE WHEN st = 'F' THEN w ELSE 0 END) OVER o AS cf, sum(CASE WHEN st = 'O' THEN w ELSE 0 END) OVER o AS co, sum(CASE WHEN st = 'P' THEN w ELSE 0 END) OVER o AS cp
  FROM p WINDOW o AS (PARTITION BY yr ORDER BY o_totalprice, o_orderkey)),
k AS (SELECT yr, st, w, hi, total, cf, co, cp, j / 9.0 AS x FROM r, range(10) t(j) WHERE (j / 9.0 * total > hi - w OR j = 0 AND hi - w <= 0) AND (j / 9.0 * total <= hi OR j = 9 AND hi >= total)),
u AS (SELECT yr, unnest(['F', 'O', 'P']) AS scale, x, unnest([cf, co, cp]) AS c, st, greatest(0, hi - x * total) AS left_over FROM k)"""


@query("w11_carried_weight", f"""WITH {CARRIED}
SELECT yr, scale, round(x, 9) AS x, round(c - CASE WHEN st = scale THEN left_over ELSE 0 END, 6) AS y FROM u""")
def carried_weight(spark, d):
    return orders_mix(spark, d).select("yr", "scale", F.round("x", 9).alias("x"), F.round("y", 6).alias("y"))


def orders_mix(spark, d):
    placed = table(spark, d, "orders").select(F.year("o_orderdate").alias("yr"), "o_orderstatus", "o_totalprice", "o_orderkey",
                                              F.length("o_orderpriority").cast("double").alias("w"))
    return tiling.carried_curve(placed, ["yr"], "o_totalprice", ["o_orderkey"], "o_orderstatus", ["F", "O", "P"], "w")


def slope_sql(at: str) -> str:
    t, h = f"(({at} - x0) / (x1 - x0))", "(x1 - x0)"
    return f"(6 * {t} * ({t} - 1) * (y0 - y1) / {h} + (3 * {t} - 1) * ({t} - 1) * s0 + {t} * (3 * {t} - 2) * s1)"


@query("w11_scale_mix", f"""WITH {CARRIED}, c AS (SELECT yr, scale, x, c - CASE WHEN st = scale THEN left_over ELSE 0 END AS y FROM u), {pchip_sql("c", "yr, scale")},
rt AS (SELECT yr, scale, step, {slope_sql("(step / 399e0)")} AS rate FROM c_s JOIN range(400) t(step) ON {on_segment("(step / 399e0)")})
SELECT yr, scale, step::INT AS step, round(rate / sum(rate) OVER (PARTITION BY yr, step), 6) AS share FROM rt""")
def scale_mix(spark, d):
    out = tiling.seat_mix(orders_mix(spark, d), ["yr"])
    return out.select("yr", "scale", "step", F.round("share", 6).alias("share"))


FORMULAS = """fr AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey < 8 THEN 'Ax1.00 Nx1.00' WHEN s_nationkey < 16 THEN 'Ax1.00 Nx2.00 Rx0.50'
  WHEN s_nationkey < 22 THEN 'Rx1.50' ELSE 'Ax1.00 Zx2.00' END AS f, (s_acctbal + 1000) / 11000 * 175 AS cutoff FROM supplier),
fp AS (SELECT f, subject, CAST(weight AS DOUBLE) AS weight FROM (VALUES ('Ax1.00 Nx1.00', 'A', 1.0), ('Ax1.00 Nx1.00', 'N', 1.0), ('Ax1.00 Nx2.00 Rx0.50', 'A', 1.0),
  ('Ax1.00 Nx2.00 Rx0.50', 'N', 2.0), ('Ax1.00 Nx2.00 Rx0.50', 'R', 0.5), ('Rx1.50', 'R', 1.5)) t(f, subject, weight)),
h AS (SELECT l_returnflag AS subject, l_quantity AS v, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY subject ORDER BY v) AS upto, sum(n) OVER (PARTITION BY subject) AS total FROM h)"""


def formula_rows(spark, d):
    f = (F.when(F.col("s_nationkey") < 8, "Ax1.00 Nx1.00").when(F.col("s_nationkey") < 16, "Ax1.00 Nx2.00 Rx0.50")
         .when(F.col("s_nationkey") < 22, "Rx1.50").otherwise("Ax1.00 Zx2.00"))
    return table(spark, d, "supplier").select(F.lit("all").alias("yr"), "s_suppkey", "s_nationkey", f.alias("f"),
                                              ((F.col("s_acctbal") + 1000) / 11000 * 175).alias("cutoff"))


def subject_hist(spark, d):
    h = hist.histogram(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "subject"), ["subject"], "l_quantity")
    return h.select(F.lit("all").alias("yr"), "subject", F.col("l_quantity").alias("score"), "n")


@query("m5_formula_inversion", f"""WITH {FORMULAS},
q AS (SELECT subject, (upto - n / 2) / total AS p, v FROM w),
g AS (SELECT DISTINCT fp.f, q.p FROM fp JOIN q USING (subject) UNION SELECT DISTINCT f, unnest([0.0, 1.0]) FROM fp),
gp AS (SELECT g.f, g.p, fp.subject, fp.weight FROM g JOIN fp ON fp.f = g.f),
lo AS (SELECT gp.*, q.p AS p0, q.v AS v0 FROM gp ASOF LEFT JOIN q ON q.subject = gp.subject AND gp.p >= q.p),
hi AS (SELECT lo.*, q.p AS p1, q.v AS v1 FROM lo ASOF LEFT JOIN q ON q.subject = lo.subject AND lo.p < q.p),
t AS (SELECT f, p, round(sum(weight * CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END), 12) AS total FROM hi GROUP BY 1, 2),
u AS (SELECT f, total, max(p) AS p, min(p) AS foot FROM t GROUP BY 1, 2),
a AS (SELECT fr.*, u.total AS t0, u.p AS p0 FROM fr ASOF LEFT JOIN u ON u.f = fr.f AND fr.cutoff >= u.total),
b AS (SELECT a.*, u.total AS t1, u.foot AS p1 FROM a ASOF LEFT JOIN u ON u.f = a.f AND a.cutoff < u.total)
SELECT s_suppkey, f, round(CASE WHEN p0 IS NULL AND p1 IS NULL THEN NULL WHEN p0 IS NULL THEN p1 WHEN p1 IS NULL THEN p0
  ELSE p0 + (p1 - p0) * (cutoff - t0) / (t1 - t0) END, 8) AS percentile FROM b""")
def formula_inversion(spark, d):
    out = formula.invert(formula_rows(spark, d), subject_hist(spark, d), ["yr"], "f", "cutoff")
    return out.select("s_suppkey", "f", F.round("percentile", 8).alias("percentile"))


@query("m6_composite_buckets", f"""WITH {FORMULAS},
b AS (SELECT subject, (upto - n) / total AS lo, upto / total AS hi, v FROM w),
e AS (SELECT DISTINCT f, unnest([lo, hi]) AS e FROM fp JOIN b USING (subject)), s AS (SELECT f, e AS lo, lead(e) OVER (PARTITION BY f ORDER BY e) AS hi FROM e),
t AS (SELECT s.f, s.lo, s.hi, round(sum(weight * v), 10) AS total FROM s JOIN fp ON fp.f = s.f JOIN b ON b.subject = fp.subject
  AND b.lo < (s.lo + s.hi) / 2 AND (s.lo + s.hi) / 2 <= b.hi WHERE s.hi > s.lo GROUP BY 1, 2, 3),
i AS (SELECT *, sum(CASE WHEN total IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY lo) AS isl FROM
  (SELECT *, lag(total) OVER (PARTITION BY f ORDER BY lo) AS prev FROM t))
SELECT f, round(min(lo), 9) AS lo, round(max(hi), 9) AS hi, max(total) AS total FROM i GROUP BY f, isl""")
def composite_buckets(spark, d):
    out = formula.composite_buckets(formula_rows(spark, d), subject_hist(spark, d), ["yr"], "f")
    return out.select(F.col("formula").alias("f"), F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "total")


@query("m7_quantile_mapping", """WITH r AS (SELECT o_orderkey, year(o_orderdate) AS yr, o_totalprice AS raw, CASE WHEN o_orderstatus <> 'P' THEN sqrt(o_totalprice) END AS sup, 1.0 AS w FROM orders),
k AS (SELECT * FROM r WHERE sup IS NOT NULL),
a AS (SELECT yr, raw AS x, (sum(w) OVER (PARTITION BY yr ORDER BY raw) - w / 2) / sum(w) OVER (PARTITION BY yr) AS p FROM (SELECT yr, raw, sum(w) AS w FROM k GROUP BY 1, 2)),
c AS (SELECT yr, sup AS v, (sum(w) OVER (PARTITION BY yr ORDER BY sup) - w / 2) / sum(w) OVER (PARTITION BY yr) AS p FROM (SELECT yr, sup, sum(w) AS w FROM k GROUP BY 1, 2)),
m AS (SELECT * FROM r WHERE sup IS NULL), l1 AS (SELECT m.*, a.x AS x0, a.p AS p0 FROM m ASOF LEFT JOIN a ON a.yr = m.yr AND m.raw >= a.x),
l2 AS (SELECT l1.*, a.x AS x1, a.p AS p1 FROM l1 ASOF LEFT JOIN a ON a.yr = l1.yr AND l1.raw < a.x),
q AS (SELECT *, CASE WHEN x0 IS NULL THEN p1 WHEN x1 IS NULL THEN p0 ELSE p0 + (p1 - p0) * (raw - x0) / (x1 - x0) END AS p FROM l2),
n1 AS (SELECT q.o_orderkey, q.yr, q.p, c.v AS v0, c.p AS q0 FROM q ASOF LEFT JOIN c ON c.yr = q.yr AND q.p >= c.p),
n2 AS (SELECT n1.*, c.v AS v1, c.p AS q1 FROM n1 ASOF LEFT JOIN c ON c.yr = n1.yr AND n1.p < c.p)
SELECT o_orderkey, round(sup, 5) AS basis, false AS fallback FROM k UNION ALL
SELECT o_orderkey, round(CASE WHEN q0 IS NULL THEN v1 WHEN q1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (p - q0) / (q1 - q0) END, 5), true FROM n2""")
def quantile_mapping(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("raw"),
                                            F.when(F.col("o_orderstatus") != "P", F.sqrt("o_totalprice")).alias("sup"), F.lit(1.0).alias("w"))
    out = formula.quantile_map(rows, ["yr"], "raw", "sup", "w")
    return out.select("o_orderkey", F.round("basis", 5).alias("basis"), "fallback")


@query("m8_allocation_pieces", f"""WITH {FORMULAS}, {FLAG_CURVE},
b AS (SELECT subject, (upto - n) / total AS lo, upto / total AS hi, v FROM w),
e AS (SELECT DISTINCT f, unnest([lo, hi]) AS e FROM fp JOIN b USING (subject)), s AS (SELECT f, e AS lo, lead(e) OVER (PARTITION BY f ORDER BY e) AS hi FROM e),
t AS (SELECT s.f, s.lo, s.hi, round(sum(weight * v), 10) AS total FROM s JOIN fp ON fp.f = s.f JOIN b ON b.subject = fp.subject
  AND b.lo < (s.lo + s.hi) / 2 AND (s.lo + s.hi) / 2 <= b.hi WHERE s.hi > s.lo GROUP BY 1, 2, 3),
i AS (SELECT *, sum(CASE WHEN total IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY lo) AS isl FROM
  (SELECT *, lag(total) OVER (PARTITION BY f ORDER BY lo) AS prev FROM t)),
bk AS (SELECT f, min(lo) AS lo, max(hi) AS hi, max(total) AS total, (max(hi) - min(lo)) * (SELECT count(*) FROM lineitem) AS cap FROM i GROUP BY f, isl),
tk AS (SELECT s_suppkey, fr.f, lo, hi, cap, total, s_nationkey * 10.0 + 1 AS want, coalesce(sum(cap) OVER (PARTITION BY s_suppkey ORDER BY total
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(cap) OVER (PARTITION BY s_suppkey) AS held FROM fr JOIN bk ON bk.f = fr.f WHERE total >= cutoff),
pc AS (SELECT *, least(cap, want - before) AS taken, CASE f WHEN 'Ax1.00 Nx1.00' THEN 'A' WHEN 'Ax1.00 Nx2.00 Rx0.50' THEN 'N' ELSE 'R' END AS flag
  FROM tk WHERE held >= want AND least(cap, want - before) > 0),
la AS (SELECT s_suppkey, total, greatest(0, least(1, {hermite_sql('lo')})) AS a FROM pc JOIN k_s ON k_s.f = flag AND {on_segment('lo')}),
lb AS (SELECT s_suppkey, total, greatest(0, least(1, {hermite_sql('hi')})) AS b FROM pc JOIN k_s ON k_s.f = flag AND {on_segment('hi')})
SELECT s_suppkey, round(100 * least(a, b), 6) AS ability_lower, round(100 * greatest(a, b), 6) AS ability_upper, round(cap, 6) AS bucket_candidates,
  CAST(round(taken, 6) AS DOUBLE) AS weight, 'equal-quantile composite' AS bucket_basis FROM pc JOIN la USING (s_suppkey, total) JOIN lb USING (s_suppkey, total)""")
def allocation_pieces(spark, d):
    """Supplier demand spread over composite score intervals, both ends read on the curve of the formula's heaviest subject."""
    rows = formula_rows(spark, d).withColumn("wanted", F.col("s_nationkey") * 10.0 + 1.0).withColumnRenamed("f", "formula")
    subjects = subject_hist(spark, d)
    buckets = formula.composite_buckets(rows, subjects, ["yr"], "formula")
    size = table(spark, d, "lineitem").agg(F.count("*").alias("n")).scalar()
    buckets = buckets.withColumn("candidates", F.col("share") * size)
    heaviest = formula.formula_parts(rows, subjects, ["yr"], "formula").groupBy("yr", "formula").agg(
        F.min_by("subject", F.struct(-F.col("weight"), "part")).alias("f"))
    curves = heaviest.join(flag_curve(spark, d), "f").drop("f")
    out = formula.allocation_pieces(buckets, rows, curves, ["yr", "formula"], ["yr", "formula"], "s_suppkey", "cutoff", "wanted", "equal-quantile composite")
    return out.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("ability_lower", "ability_upper", "bucket_candidates", "weight")], "bucket_basis")


@query("m9_score_to_level", f"""WITH {FLAG_CURVE}, hq AS (SELECT l_returnflag AS f, l_quantity AS q, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT DISTINCT f, p_size + 0.0 AS v FROM part, (SELECT DISTINCT l_returnflag AS f FROM lineitem)),
b AS (SELECT a.f, a.v, 1 - sum(CASE WHEN q > v THEN n WHEN q = v THEN n / 2 ELSE 0 END) / sum(n) AS beaten FROM a JOIN hq ON hq.f = a.f GROUP BY 1, 2)
SELECT b.f, CAST(v AS DOUBLE) AS v, round(beaten, 9) AS beaten, round(greatest(0, least(1, {hermite_sql('beaten')})), 8) AS level FROM b JOIN k_s ON k_s.f = b.f AND {on_segment('beaten')}""")
def score_to_level(spark, d):
    flags = F.explode(F.array(*[F.lit(x) for x in "ANR"]))
    values = table(spark, d, "part").select(F.col("p_size").cast("double").alias("v")).distinct().select("v", flags.alias("f"))
    h = hist.histogram(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "f"), ["f"], "l_quantity")
    out = tiling.level_of(values, h, flag_curve(spark, d), ["f"], "v", "l_quantity")
    return out.select("f", "v", F.round("beaten", 9).alias("beaten"), F.round("level", 8).alias("level"))


CROSS = """q AS (SELECT l_returnflag AS f, l_quantity AS x, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
cv AS (SELECT f, x, sum(n) OVER (PARTITION BY f ORDER BY x) / sum(n) OVER (PARTITION BY f) AS y FROM q),
s AS (SELECT x, y FROM cv WHERE f = 'A'), t AS (SELECT x, y FROM cv WHERE f = 'R'),
p AS (SELECT s_suppkey, s_acctbal / 190 AS tm FROM supplier)"""


@query("m10_curve_crosswalk", f"""WITH {CROSS}, a AS (SELECT p.*, s.x AS x0, s.y AS y0 FROM p ASOF LEFT JOIN s ON p.tm >= s.x),
b AS (SELECT a.*, s.x AS x1, s.y AS y1 FROM a ASOF LEFT JOIN s ON a.tm < s.x),
l AS (SELECT s_suppkey, tm, CASE WHEN x0 IS NULL THEN NULL WHEN x0 = tm THEN y0 WHEN x1 IS NULL THEN NULL ELSE y0 + (y1 - y0) * (tm - x0) / (x1 - x0) END AS lev FROM b),
c AS (SELECT l.*, t.x AS x0, t.y AS y0 FROM l ASOF LEFT JOIN t ON l.lev >= t.y), e AS (SELECT c.*, t.x AS x1, t.y AS y1 FROM c ASOF LEFT JOIN t ON c.lev < t.y)
SELECT s_suppkey, round(CASE WHEN lev IS NULL OR y0 IS NULL THEN NULL WHEN y0 = lev THEN x0 WHEN y1 IS NULL THEN NULL ELSE x0 + (x1 - x0) * (lev - y0) / (y1 - y0) END, 7) AS value FROM e""")
def curve_crosswalk(spark, d):
    h = hist.histogram(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "f"), ["f"], "l_quantity")
    cv = hist.intervals(h, ["f"], "l_quantity").select(F.lit(1).alias("k"), "f", F.col("l_quantity").alias("x"), F.col("hi").alias("y"))
    probes = table(spark, d, "supplier").select(F.lit(1).alias("k"), "s_suppkey", (F.col("s_acctbal") / 190).alias("at"))
    out = interp.crosswalk(probes, cv.where("f = 'A'").drop("f"), cv.where("f = 'R'").drop("f"), ["k"], "at")
    return out.select("s_suppkey", F.round("value", 7).alias("value"))


@query("w12_merge_equal_runs", """WITH r AS (SELECT user_id, event_type, epoch_us(ts) AS tm, event_id, CASE WHEN lag(event_type) OVER o IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS BIGINT) AS run FROM r)
SELECT user_id, run, max(event_type) AS event_type, min(tm) AS lo, max(tm) AS hi, count(*) AS n FROM i GROUP BY 1, 2""")
def merge_equal_runs(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    out = intervals.runs(events, ["user_id"], ["at", "event_id"], "event_type")
    return out.groupBy("user_id", "run").agg(F.max("event_type").alias("event_type"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))


@query("w13_gap_groups", """WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS tm, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS gap FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS BIGINT) AS sitting FROM r)
SELECT user_id, sitting, min(tm) AS lo, max(tm) AS hi, count(*) AS n FROM i GROUP BY 1, 2""")
def gap_groups(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = intervals.gap_groups(events, ["user_id"], ["at", "event_id"], F.col("at"), 21_600_000_000, "sitting")
    return out.groupBy("user_id", "sitting").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))


@query("w13_carry_forward", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' OR event_type = 'purchase' THEN event_type || event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events""")
def carry_forward(spark, d):
    from ..operators.ordered import carried

    head = F.when(F.col("event_type").isin("signup", "purchase"), F.concat("event_type", F.col("event_id").cast("string")))
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return carried(events, ["user_id"], ["ts", "event_id"], last={"heading": head}).select("event_id", "heading")


@query("w14_capacity_walk", """WITH b AS (SELECT l_partkey AS k, l_extendedprice AS price, sum(l_quantity) AS cap FROM lineitem GROUP BY 1, 2),
dm AS (SELECT p_partkey AS k, p_retailprice * 20 AS cutoff, p_size * 10.0 AS want FROM part),
j AS (SELECT b.*, want, coalesce(sum(cap) OVER (PARTITION BY b.k ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(cap) OVER (PARTITION BY b.k) AS held
  FROM b JOIN dm USING (k) WHERE price >= cutoff)
SELECT k, price, cap, CAST(least(cap, want - before) AS DOUBLE) AS taken FROM j WHERE held >= want AND least(cap, want - before) > 0""")
def capacity_walk(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_extendedprice").alias("price")).agg(F.sum("l_quantity").alias("cap"))
    want = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") * 20).alias("cutoff"), (F.col("p_size") * 10.0).alias("want"))
    return consume(b, want, ["k"], "price", "cap", "cutoff", "want").select("k", "price", "cap", "taken")
