"""Weighted means, roll-ups, pivots, rankings, coverage and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hist, interp, rollup
from ..operators.allocate import rate_applied, route_factors, shortfalls
from ..session import cut_lineage
from .registry import query, table


def supplied(spark, d):
    """Lines with their supplier's nation and region; dimension sizes are left to AQE."""
    lines = table(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate"
    )
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return lines.join(supplier, "l_suppkey").join(nation, "s_nationkey")


SUPPLIED = """s AS (SELECT l.*, s_nationkey, n_name, n_regionkey FROM lineitem l
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""

FLAG_COLUMNS = """round(sum(top * l_quantity) FILTER (l_returnflag = 'A') / sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "A",
  round(sum(top * l_quantity) FILTER (l_returnflag = 'N') / sum(l_quantity) FILTER (l_returnflag = 'N'), 6) AS "N",
  round(sum(top * l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "R\""""


@query("flagship_supplier_ranking", """WITH h AS (SELECT year(l_shipdate) AS yr, l_returnflag, l_quantity,
  CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT *, (sum(n) OVER (PARTITION BY yr, l_returnflag ORDER BY l_quantity) - n / 2)
  / sum(n) OVER (PARTITION BY yr, l_returnflag) AS midrank FROM h),
r AS (SELECT n_name, l_suppkey, l.l_returnflag, midrank, l.l_quantity AS q FROM lineitem l
  JOIN m ON m.yr = year(l_shipdate) AND m.l_returnflag = l.l_returnflag AND m.l_quantity = l.l_quantity
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
a AS (SELECT n_name, l_suppkey, round(sum(midrank * q) / sum(q), 6) AS level, sum(q) AS weight,
  sum(midrank * q) FILTER (l_returnflag = 'A') / sum(q) FILTER (l_returnflag = 'A') AS fa,
  sum(midrank * q) FILTER (l_returnflag = 'N') / sum(q) FILTER (l_returnflag = 'N') AS fn,
  sum(midrank * q) FILTER (l_returnflag = 'R') / sum(q) FILTER (l_returnflag = 'R') AS fr FROM r GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY level DESC, l_suppkey) AS rank, n_name, l_suppkey, level, weight,
  round(fa, 6) AS "A", round(fn, 6) AS "N", round(fr, 6) AS "R",
  round(CASE WHEN (fa IS NOT NULL)::INT + (fn IS NOT NULL)::INT + (fr IS NOT NULL)::INT > 1
    THEN greatest(fa, fn, fr) - least(fa, fn, fr) END, 6) AS spread FROM a""")
def flagship(spark, d):
    """Histogram, midrank, lookup join, weighted mean by supplier with per-flag readings, unique rank.

    The lines are reduced to (supplier, year, flag, quantity) before any join and
    that table is written once: the raw rows are scanned a single time, and the
    histogram, the lookup and the ranking all read the pre-aggregate.
    """
    lines = cut_lineage(table(spark, d, "lineitem").groupBy(
        "l_suppkey", F.year("l_shipdate").alias("yr"), "l_returnflag", "l_quantity"
    ).agg(F.count("*").cast("double").alias("rows")))
    h = lines.groupBy("yr", "l_returnflag", "l_quantity").agg(F.sum("rows").alias("n"))
    read = hist.midranks(h, ["yr", "l_returnflag"], "l_quantity").select("yr", "l_returnflag", "l_quantity", "midrank")
    scored = lines.join(read, ["yr", "l_returnflag", "l_quantity"]).withColumn("w", F.col("rows") * F.col("l_quantity"))
    level = rollup.readings(scored, ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "midrank", "w")
    out = rollup.ranked(cut_lineage(level.withColumn("level", F.round("level", 6))), "level", ["l_suppkey"])
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    out = out.join(supplier, "l_suppkey").join(nation, "s_nationkey")
    return out.select("rank", "n_name", "l_suppkey", "level", "weight",
                      *[F.round(c, 6).alias(c) for c in ("A", "N", "R", "spread")])


@query("a1_weighted_mean", """SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS level
FROM lineitem WHERE l_discount IS NOT NULL AND l_quantity > 0 GROUP BY 1""")
def weighted_mean(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        rollup.weighted_mean("l_discount", "l_quantity").alias("level"))
    return out.withColumn("level", F.round("level", 6))


@query("a2_two_round_blend", """WITH r AS (SELECT l_suppkey,
  avg(l_discount) FILTER (l_returnflag = 'A' AND l_tax > 0.06) AS g1, count(*) FILTER (l_returnflag = 'A' AND l_tax > 0.06) AS n1,
  avg(l_discount) FILTER (l_returnflag = 'R' AND l_tax < 0.02) AS g2, count(*) FILTER (l_returnflag = 'R' AND l_tax < 0.02) AS n2
  FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN g1 IS NULL THEN g2 WHEN g2 IS NULL THEN g1 ELSE (g1 * n1 + g2 * n2) / (n1 + n2) END, 6)
  AS blended FROM r""")
def two_round_blend(spark, d):
    one = (F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.06)
    two = (F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.02)
    got = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg(F.when(one, F.col("l_discount"))).alias("g1"), F.count_if(one).alias("n1"),
        F.avg(F.when(two, F.col("l_discount"))).alias("g2"), F.count_if(two).alias("n2"))
    value = rollup.blend(*[F.col(c) for c in ("g1", "n1", "g2", "n2")])
    return got.select("l_suppkey", F.round(value, 6).alias("blended"))


@query("a4_overall_and_per_scale", """SELECT l_suppkey, CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS scale,
  round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS level, round(sum(l_quantity), 4) AS weight
FROM lineitem GROUP BY GROUPING SETS ((l_suppkey), (l_suppkey, l_returnflag))""")
def overall_and_per_scale(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "scale")
    out = rollup.level_and_scale(lines, ["l_suppkey"], "scale", "l_discount", "l_quantity")
    return out.select("l_suppkey", "scale", F.round("level", 6).alias("level"), F.round("weight", 4).alias("weight"))


@query("a5_three_level_rollup", f"""WITH {SUPPLIED} SELECT n_regionkey, n_name, l_suppkey,
  round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS level, round(sum(l_quantity), 4) AS weight FROM s
GROUP BY GROUPING SETS ((n_regionkey), (n_regionkey, n_name), (n_regionkey, n_name, l_suppkey))""")
def three_level_rollup(spark, d):
    rows = supplied(spark, d)
    out = rows.groupingSets([["n_regionkey"], ["n_regionkey", "n_name"], ["n_regionkey", "n_name", "l_suppkey"]],
                            "n_regionkey", "n_name", "l_suppkey").agg(
        F.round(rollup.weighted_mean("l_discount", "l_quantity"), 6).alias("level"),
        F.round(F.sum("l_quantity"), 4).alias("weight"))
    return out


@query("a7_scale_pivot", """SELECT l_suppkey,
  round(sum(l_discount * l_quantity) FILTER (l_returnflag = 'A') / sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "A",
  round(sum(l_discount * l_quantity) FILTER (l_returnflag = 'N') / sum(l_quantity) FILTER (l_returnflag = 'N'), 6) AS "N",
  round(sum(l_discount * l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "R"
FROM lineitem GROUP BY 1""")
def scale_pivot(spark, d):
    out = rollup.readings(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["A", "N", "R"],
                          "l_discount", "l_quantity")
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("A", "N", "R")])


@query("a8_scale_spread", """WITH p AS (SELECT l_partkey, CASE WHEN l_tax > 0.05 THEN l_returnflag END AS f, sum(l_discount * l_quantity) / sum(l_quantity) AS v
  FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, CASE WHEN count(f) > 1 THEN round(max(v) FILTER (f IS NOT NULL) - min(v) FILTER (f IS NOT NULL), 6) END AS spread FROM p GROUP BY 1""")
def scale_spread(spark, d):
    """Lines of low tax belong to no scale, so some parts have one scale or none."""
    lines = table(spark, d, "lineitem").withColumn("f", F.when(F.col("l_tax") > 0.05, F.col("l_returnflag")))
    out = rollup.readings(lines, ["l_partkey"], "f", ["A", "N", "R"], "l_discount", "l_quantity")
    return out.select("l_partkey", F.round("spread", 6).alias("spread"))


@query("a9_heaviest_spelling", """WITH s AS (SELECT p_brand, p_type, sum(p_retailprice) AS w FROM part GROUP BY 1, 2)
SELECT p_brand, arg_max(p_type, w) AS p_type FROM s GROUP BY 1""")
def heaviest_spelling(spark, d):
    return rollup.heaviest_spelling(table(spark, d, "part"), ["p_brand"], "p_type", "p_retailprice")


@query("a10_latest_label", """WITH c AS (SELECT o_custkey, year(o_orderdate) AS yr, o_orderpriority AS label, sum(o_totalprice) AS w
  FROM orders GROUP BY 1, 2, 3) SELECT DISTINCT ON (o_custkey) o_custkey, label FROM c ORDER BY o_custkey, yr DESC, w DESC, label DESC""")
def latest_label(spark, d):
    cells = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr"),
                                              F.col("o_orderpriority").alias("label")).agg(F.sum("o_totalprice").alias("w"))
    return cells.groupBy("o_custkey").agg(F.max_by("label", F.struct("yr", "w", "label")).alias("label"))


@query("a11_nearest_year_names", """WITH n AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr,
  string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1, 2),
g AS (SELECT o_custkey, CAST(unnest(range(min(yr), max(yr) + 1)) AS INTEGER) AS yr FROM n GROUP BY 1)
SELECT DISTINCT ON (g.o_custkey, g.yr) g.o_custkey, g.yr, n.names FROM g JOIN n ON n.o_custkey = g.o_custkey
ORDER BY g.o_custkey, g.yr, abs(n.yr - g.yr), n.yr""")
def nearest_year_names(spark, d):
    from ..plans.panel import nearest_year, year_names

    rows = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), "o_orderpriority")
    names = year_names(rows, ["o_custkey"], "yr", "o_orderpriority")
    span = names.groupBy("o_custkey").agg(F.sequence(F.min("yr"), F.max("yr")).alias("s"))
    grid = span.select("o_custkey", F.explode("s").alias("yr"))
    return nearest_year(grid.join(names, ["o_custkey", "yr"], "left"), ["o_custkey"], "yr", "names")


@query("a12_active_years", """WITH c AS (SELECT o_custkey, year(o_orderdate) AS yr, o_orderpriority AS route,
  sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS w, sum(o_totalprice * length(o_orderstatus) *
  CASE WHEN o_orderstatus <> 'P' THEN 1 END * day(o_orderdate)) AS m FROM orders GROUP BY 1, 2, 3)
SELECT o_custkey, round(sum(m) / sum(w), 6) AS score, count(DISTINCT yr) AS years, CAST(max(yr) AS INTEGER) AS last_year,
  round(coalesce(sum(w), 0) / count(DISTINCT yr), 4) AS weight_avg,
  round(sum(m) FILTER (route = '1-URGENT') / sum(w) FILTER (route = '1-URGENT'), 6) AS urgent
FROM c GROUP BY 1 HAVING sum(w) > 0""")
def active_years(spark, d):
    rows = table(spark, d, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("route"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(0.0).alias("w"),
        F.dayofmonth("o_orderdate").cast("double").alias("v"))
    out = rollup.active_years(rows, ["o_custkey"], "yr", "route", "v", "w")
    return out.select("o_custkey", F.round("score", 6).alias("score"), "years", "last_year",
                      F.round("weight_avg", 4).alias("weight_avg"),
                      F.round(F.col("by_route")["1-URGENT"], 6).alias("urgent"))


@query("a13_route_factors", """WITH h AS (SELECT o_orderpriority AS route, CAST(count(*) AS DOUBLE) AS held FROM orders
  WHERE o_orderstatus = 'F' GROUP BY 1), t AS (SELECT o_orderpriority AS route, CAST(count(*) AS DOUBLE) AS total FROM orders
  WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT h.route, round(CASE WHEN h.route = '2-HIGH' OR total IS NULL THEN 1.0 WHEN h.route = '1-URGENT'
  THEN greatest(total - (SELECT held FROM h WHERE route = '2-HIGH'), 0) / held ELSE total / held END, 6) AS factor
FROM h LEFT JOIN t ON t.route = h.route""")
def route_factor(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("route"), "o_orderstatus")
    held = orders.where("o_orderstatus = 'F'").groupBy("route").agg(F.count("*").cast("double").alias("held"))
    total = orders.where("route <> '5-LOW'").groupBy("route").agg(F.count("*").cast("double").alias("total"))
    out = route_factors(held, total, [], "route", "held", "total", reserved={"2-HIGH": "1-URGENT"})
    return out.select("route", F.round("factor", 6).alias("factor"))


@query("a14_coverage", """WITH h AS (SELECT o_orderpriority AS route, year(l_shipdate) AS yr, count(DISTINCT o_orderkey) AS held
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
p AS (SELECT o_orderpriority AS route, year(o_orderdate) AS yr, count(*) AS published FROM orders GROUP BY 1, 2)
SELECT route, CAST(yr AS INTEGER) AS yr, held, published, round(held / published, 6) AS coverage
FROM h FULL JOIN p USING (route, yr)""")
def coverage(spark, d):
    from ..operators.allocate import coverage as cover

    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("route"), "o_orderdate")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("yr"))
    held = lines.distinct().join(orders, "o_orderkey").groupBy("route", "yr").agg(F.count("*").alias("held"))
    published = orders.groupBy("route", F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("published"))
    return cover(held, published, ["route", "yr"]).withColumn("coverage", F.round("coverage", 6))


@query("a15_shortfall_rows", """WITH held AS (SELECT o_orderpriority AS route, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
t AS (SELECT o_orderpriority AS route, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority AS route, round(avg(o_totalprice), 4) AS level, CAST(count(*) AS DOUBLE) AS weight FROM orders
  WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT t.route, 0.0, CAST(t.n - coalesce(held.n, 0) AS DOUBLE) FROM t LEFT JOIN held USING (route)
  WHERE t.n > coalesce(held.n, 0)""")
def shortfall_rows(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "route")
    held = orders.where("o_orderstatus = 'F'").groupBy("route").agg(
        F.round(F.avg("o_totalprice"), 4).alias("level"), F.count("*").cast("double").alias("weight"))
    totals = orders.groupBy("route").agg(F.count("*").cast("double").alias("total"))
    return held.unionByName(shortfalls(held, totals, "route", "weight", "total"))


@query("a16_headcount_proxy", """WITH s AS (SELECT l_returnflag AS exam, l_linenumber AS subject, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2)
SELECT exam, round(max(n), 4) AS takers FROM s WHERE exam <> 'N' GROUP BY 1
UNION ALL SELECT 'N_pool', round(sum(n), 4) FROM s WHERE exam = 'N' AND subject IN (1, 2, 3)""")
def headcount_proxy(spark, d):
    from ..operators.allocate import headcounts

    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("exam"), F.col("l_linenumber").alias("subject"), "l_quantity")
    return headcounts(rows, "exam", "subject", "l_quantity", {"N": {"N_pool": (1, 2, 3)}}).withColumn("takers", F.round("takers", 4))


@query("a17_population_union", """WITH a AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS current,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS vocational, count(*) FILTER (o_orderpriority = '2-HIGH') AS ordinary FROM orders),
b AS (SELECT count(*) FILTER (l_linestatus = 'F') AS current, count(*) AS registered, count(*) FILTER (l_returnflag = 'A') AS vocational,
  count(*) FILTER (l_returnflag = 'N' AND l_tax > 0.04) AS ordinary, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.04) AS comprehensive,
  count(*) FILTER (l_tax = 0) AS other FROM lineitem),
g AS (SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS vocational, count(*) FILTER (event_type = 'click') AS academic FROM events),
r AS (SELECT a.vocational * (a.current / a.total) / g.vocational AS v, least(1.0, a.ordinary * (a.current / a.total) / g.academic) AS o,
  a.current / g.total AS other, b.current / b.registered AS s FROM a, b, g)
SELECT round(s * (b.vocational * v + b.ordinary * o + b.comprehensive * (v + o) / 2 + b.other * r.other), 4) AS overlap FROM a, b, g, r""")
def population_union(spark, d):
    c, n = F.col, lambda test: F.count_if(test)
    a = table(spark, d, "orders").agg(
        F.count("*").alias("a_total"), n(c("o_orderstatus") != "P").alias("a_current"),
        n(c("o_orderpriority") == "1-URGENT").alias("a_vocational"), n(c("o_orderpriority") == "2-HIGH").alias("a_ordinary"))
    b = table(spark, d, "lineitem").agg(
        n(c("l_linestatus") == "F").alias("b_current"), F.count("*").alias("b_registered"),
        n(c("l_returnflag") == "A").alias("b_vocational"), n((c("l_returnflag") == "N") & (c("l_tax") > 0.04)).alias("b_ordinary"),
        n((c("l_returnflag") == "R") & (c("l_tax") > 0.04)).alias("b_comprehensive"), n(c("l_tax") == 0).alias("b_other"))
    g = table(spark, d, "events").agg(F.count("*").alias("g_total"), n(c("event_type") == "view").alias("g_vocational"),
                                      n(c("event_type") == "click").alias("g_academic"))
    # Three one-row aggregates side by side, joined on a constant.
    one = [f.withColumn("k", F.lit(1)) for f in (a, b, g)]
    row = one[0].join(one[1], "k").join(one[2], "k")
    part = lambda p: {x.split("_", 1)[1]: c(x) for x in row.columns if x.startswith(p + "_")}
    return row.select(F.round(rollup.inclusion_exclusion(part("a"), part("b"), part("g")), 4).alias("overlap"))


@query("a22_band_scatter", """WITH p AS (SELECT l_returnflag, l_tax * 10 AS place, l_discount AS v, l_quantity AS w FROM lineitem),
b AS (SELECT l_returnflag, CAST(floor(place * 10) AS INTEGER) AS band, count(*) AS n, sum(w) AS w, sum(w * v) AS m, sum(w * v * v) AS q
  FROM p WHERE place >= 0 AND place < 1 GROUP BY 1, 2)
SELECT l_returnflag, band, CASE WHEN n >= 2 THEN round(sqrt(greatest(0, q / w - (m / w) * (m / w))), 6) END AS scatter FROM b""")
def band_scatter(spark, d):
    rows = table(spark, d, "lineitem").withColumn("place", F.col("l_tax") * 10)
    out = rollup.band_scatter(rows, ["l_returnflag"], "place", "l_discount", "l_quantity")
    return out.withColumn("scatter", F.round("scatter", 6))


@query("a33_composition_summary", """WITH n AS (SELECT n_name, n_regionkey, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey
  GROUP BY 1, 2), t AS (SELECT sum(c) * 1.25 AS total FROM n)
SELECT round(sum(c) FILTER (n_regionkey < 3 AND n_name < 'NATION_17') / max(total), 6) AS named,
  round(sum(c) FILTER (n_regionkey < 3 AND n_name >= 'NATION_17') / max(total), 6) AS other,
  round(sum(c) FILTER (n_regionkey >= 3) / max(total), 6) AS "foreign",
  round(1 - sum(c) / max(total), 6) AS unreported FROM n, t""")
def composition_summary(spark, d):
    from ..operators.allocate import composition

    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c")).join(nation, "c_nationkey")
    kinds = {
        "named": (F.col("n_regionkey") < 3) & (F.col("n_name") < "NATION_17"),
        "other": (F.col("n_regionkey") < 3) & (F.col("n_name") >= "NATION_17"),
        "foreign": F.col("n_regionkey") >= 3,
    }
    out = composition(counts, [], "c", kinds, F.sum("c") * 1.25)
    return out.select(*[F.round(k, 6).alias(k) for k in ("named", "other", "foreign", "unreported")])


@query("a34_group_profile", """SELECT s_nationkey, count(*) AS n, count(DISTINCT s_acctbal) AS distinct_values, max(s_acctbal) AS high,
  min(s_acctbal) AS low, count(*) FILTER (s_acctbal < 0) AS flagged, round(count(*) / (SELECT count(*) FROM supplier), 6) AS share
FROM supplier GROUP BY 1""")
def group_profile(spark, d):
    s = table(spark, d, "supplier")
    total = s.agg(F.count("*").alias("n")).scalar()
    return s.groupBy("s_nationkey").agg(
        F.count("*").alias("n"), F.count_distinct("s_acctbal").alias("distinct_values"), F.max("s_acctbal").alias("high"),
        F.min("s_acctbal").alias("low"), F.count_if(F.col("s_acctbal") < 0).alias("flagged"),
    ).withColumn("share", F.round(F.col("n") / total, 6))


@query("a35_rate_applied", """WITH r AS (SELECT year(o_orderdate) AS yr, count(*) FILTER (o_orderstatus = 'F') / count(*) AS rate FROM orders
  WHERE year(o_orderdate) < 2000 GROUP BY 1), o AS (SELECT o_custkey, year(o_orderdate) AS yr, count(*) * 10 AS w FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(o.yr AS INTEGER) AS yr, CAST(round(w * coalesce(rate, 0.5)) AS BIGINT) AS estimate FROM o LEFT JOIN r ON r.yr = o.yr""")
def rate_applied_query(spark, d):
    orders = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    rates = orders.where("yr < 2000").groupBy("yr").agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("rate"))
    weights = orders.groupBy("o_custkey", "yr").agg((F.count("*") * 10).alias("w"))
    return rate_applied(weights, rates, ["yr"], "w", "rate", default=0.5).select("o_custkey", "yr", "estimate")


@query("a36_candidate_names", """SELECT DISTINCT * FROM (SELECT p_brand AS grp, p_name AS name FROM part
UNION ALL SELECT p_brand, p_type FROM part)""")
def candidate_names(spark, d):
    """Name sets kept as rows: a group's set may be long."""
    part = table(spark, d, "part")
    names = part.select(F.col("p_brand").alias("grp"), F.col("p_name").alias("name"))
    return names.unionByName(part.select(F.col("p_brand").alias("grp"), F.col("p_type").alias("name"))).distinct()


@query("p3_usable_rows", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IS NOT NULL AND trim(l_returnflag) <> ''
AND l_quantity > 0 AND l_discount <= 0.05""")
def usable_rows(spark, d):
    return table(spark, d, "lineitem").where(
        (F.trim("l_returnflag") != "") & (F.col("l_quantity") > 0) & (F.col("l_discount") <= 0.05)
    ).select("l_orderkey", "l_linenumber")


@query("t1_global_order", """SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey""")
def global_order(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("t2_top_k", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_k(spark, d):
    return rollup.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
                        [F.desc("o_totalprice"), F.col("o_orderkey")], 25)


@query("t3_top_k_per_group", """WITH s AS (SELECT p_brand, l_partkey, round(sum(l_quantity), 2) AS sold FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT p_brand, l_partkey, sold, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY sold DESC, l_partkey) AS INTEGER) AS position
FROM s QUALIFY position <= 5""")
def top_k_per_group(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("sold"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rollup.top_k_per_group(sold.join(part, "l_partkey"), ["p_brand"], [F.desc("sold"), F.col("l_partkey")], 5)


@query("t4_common_pairs", """SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, 1, 2 LIMIT 20""")
def common_pairs(spark, d):
    pairs = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).where("n >= 3")
    return rollup.top_k(pairs, [F.desc("n"), F.col("p_brand"), F.col("p_type")], 20)


@query("t5_groups_by_weighted_median", """WITH h AS (SELECT o_orderpriority, o_totalprice AS v, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY v) AS reach, sum(n) OVER (PARTITION BY o_orderpriority) AS total FROM h)
SELECT o_orderpriority, min(v) AS median FROM w WHERE reach >= 0.5 * total GROUP BY 1 ORDER BY 2 DESC, 1""")
def groups_by_weighted_median(spark, d):
    orders = table(spark, d, "orders").withColumn("w", F.lit(1.0))
    out = hist.weighted_quantile(orders, ["o_orderpriority"], "o_totalprice", "w", 0.5, "median")
    return out.orderBy(F.desc("median"), "o_orderpriority")


@query("w8_unique_rank", """SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer""")
def unique_rank(spark, d):
    return rollup.ranked(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"])


@query("w9_tie_inclusive_ratio", """WITH s AS (SELECT c_nationkey, round(c_acctbal / 100) AS ability, count(*) AS w FROM customer GROUP BY 1, 2)
SELECT c_nationkey, ability, w, CAST(sum(w) OVER (ORDER BY ability DESC RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cumulative,
round(185052 * (1 - ability / 100) / sum(w) OVER (ORDER BY ability DESC RANGE UNBOUNDED PRECEDING), 4) AS pool_ratio FROM s""")
def tie_inclusive_ratio(spark, d):
    s = table(spark, d, "customer").groupBy("c_nationkey", F.round(F.col("c_acctbal") / 100).alias("ability")).agg(F.count("*").alias("w"))
    return rollup.pool_ratio(s, "ability", "w", 185052.0).withColumn("pool_ratio", F.round("pool_ratio", 4))


@query("u1_key_union", """SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer""")
def key_union(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.union(table(spark, d, "customer").select(F.col("c_custkey").alias("k"))).distinct()


@query("u2_key_intersection", """SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0""")
def key_intersection(spark, d):
    a = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("k"))
    return a.intersect(table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k")))


@query("u3_set_difference", """SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_difference(spark, d):
    taken = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(taken, "k", "left_anti").distinct()


@query("u4_union_with_dedupe", """SELECT o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""")
def union_with_dedupe(spark, d):
    from ..operators.checks import dedupe_checked

    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    parts = orders.where("o_orderstatus <> 'F'").unionByName(orders.where("o_orderstatus <> 'P'"))
    return dedupe_checked(parts, ["o_orderkey"], ["o_totalprice"])


@query("u5_label_harvest", """SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_type FROM part
UNION ALL SELECT p_brand FROM part) WHERE name IS NOT NULL AND name <> ''""")
def label_harvest(spark, d):
    names = table(spark, d, "part").select("p_name", "p_type", "p_brand").unpivot([], ["p_name", "p_type", "p_brand"], "field", "name")
    return names.where("name <> ''").select("name").distinct()
