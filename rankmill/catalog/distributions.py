"""Histograms, midranks, running shares and quantiles over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hist, interp
from ..operators.lookup import looked_up
from ..operators.ordered import running
from .registry import query, table


def quantity_hist(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("yr", F.year("l_shipdate"))
    return hist.histogram(lines, ["yr", "l_returnflag"], "l_quantity")


HIST = """h AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, l_returnflag, l_quantity,
  CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2, 3)"""
WALK = HIST + """, w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY yr, l_returnflag ORDER BY l_quantity
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(n) OVER (PARTITION BY yr, l_returnflag) AS total FROM h)"""


@query("a3_weighted_histogram", """SELECT l_returnflag, l_discount, round(sum(l_quantity), 4) AS n
FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2""")
def weighted_histogram(spark, d):
    out = hist.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", F.col("l_quantity"))
    return out.withColumn("n", F.round("n", 4))


@query("w1_midrank", f"""WITH {WALK} SELECT yr, l_returnflag, l_quantity, n,
round((below + n / 2) / total, 9) AS midrank FROM w""")
def midrank(spark, d):
    out = hist.midranks(quantity_hist(spark, d), ["yr", "l_returnflag"], "l_quantity")
    return out.select("yr", "l_returnflag", "l_quantity", "n", F.round("midrank", 9).alias("midrank"))


@query("w1_midrank_prices", """WITH h AS (SELECT l_returnflag, l_extendedprice AS price,
  CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, price, round((sum(n) OVER (PARTITION BY l_returnflag ORDER BY price) - n / 2)
  / sum(n) OVER (PARTITION BY l_returnflag), 9) AS midrank FROM h""")
def midrank_prices(spark, d):
    """Nearly every price is distinct, so a flag is one long ordered key."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_extendedprice", "price")
    h = hist.histogram(lines, ["l_returnflag"], "price")
    out = hist.midranks(h, ["l_returnflag"], "price")
    return out.select("l_returnflag", "price", F.round("midrank", 9).alias("midrank"))


@query("w2_midrank_top", f"""WITH {HIST}, l AS (SELECT * FROM (SELECT DISTINCT yr, l_returnflag FROM h),
  (SELECT unnest([0.0, 10.0, 10.5, 25.0, 49.5, 50.0, 60.0]) AS level))
SELECT l.yr, l.l_returnflag, CAST(level AS DOUBLE) AS level,
  round((sum(CASE WHEN l_quantity > level THEN n WHEN l_quantity = level THEN n / 2 ELSE 0 END)) / sum(n), 9) AS top
FROM l JOIN h ON h.yr = l.yr AND h.l_returnflag = l.l_returnflag GROUP BY 1, 2, 3""")
def midrank_top(spark, d):
    h = quantity_hist(spark, d)
    marks = F.array(*[F.lit(v) for v in (0.0, 10.0, 10.5, 25.0, 49.5, 50.0, 60.0)])
    levels = h.select("yr", "l_returnflag").distinct().withColumn("level", F.explode(marks))
    out = hist.top_share(levels, h, ["yr", "l_returnflag"], "level", "l_quantity")
    return out.withColumn("top", F.round("top", 9))


@query("w3_percentile_buckets", f"""WITH {WALK} SELECT yr, l_returnflag, l_quantity, n,
round(below / total, 9) AS lo, round((below + n) / total, 9) AS hi FROM w""")
def percentile_buckets(spark, d):
    out = hist.intervals(quantity_hist(spark, d), ["yr", "l_returnflag"], "l_quantity")
    return out.withColumn("lo", F.round("lo", 9)).withColumn("hi", F.round("hi", 9))


@query("p2_binding_bars", f"""WITH {WALK} SELECT yr, l_returnflag, l_quantity,
round(1 - (below + n / 2) / total, 9) AS top FROM w WHERE 1 - (below + n / 2) / total < 0.95""")
def binding_bars(spark, d):
    out = hist.midranks(quantity_hist(spark, d), ["yr", "l_returnflag"], "l_quantity")
    out = out.withColumn("top", 1 - F.col("midrank")).where("top < 0.95")
    return out.select("yr", "l_returnflag", "l_quantity", F.round("top", 9).alias("top"))


@query("j7_histogram_lookup", f"""WITH {WALK}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  round(1 - (below + n / 2) / total, 9) AS top
FROM lineitem l JOIN w ON w.yr = year(l_shipdate) AND w.l_returnflag = l.l_returnflag
  AND w.l_quantity = l.l_quantity""")
def histogram_lookup(spark, d):
    """Every row reads its own value's share; the histogram side is written and measured, and rows stay in place."""
    lines = table(spark, d, "lineitem").withColumn("yr", F.year("l_shipdate"))
    read = hist.midranks(quantity_hist(spark, d), ["yr", "l_returnflag"], "l_quantity")
    read = read.select("yr", "l_returnflag", "l_quantity", F.round(1 - F.col("midrank"), 9).alias("top"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "yr", "l_returnflag", "l_quantity")
    return looked_up(lines, read, ["yr", "l_returnflag", "l_quantity"]).drop("yr", "l_returnflag", "l_quantity")


@query("p12_incomplete_bins", """SELECT l_suppkey, l_returnflag, count(DISTINCT l_quantity) AS bins
FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) <> 50""")
def incomplete_bins(spark, d):
    from ..operators.checks import incomplete_groups

    lines = table(spark, d, "lineitem")
    return incomplete_groups(lines, ["l_suppkey", "l_returnflag"], "l_quantity", 50)


@query("a18_share_at_or_above", """WITH p AS (SELECT l_returnflag, l_discount,
  count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_discount, round(share, 9) AS share,
  round(sum(share) OVER (PARTITION BY l_returnflag ORDER BY l_discount DESC), 9) AS at_or_above FROM p""")
def share_at_or_above(spark, d):
    pmf = hist.histogram(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount")
    total = Window.partitionBy("l_returnflag")  # at most one row per discount step
    pmf = pmf.withColumn("share", F.col("n") / F.sum("n").over(total))
    out = hist.share_at_or_above(pmf, ["l_returnflag"], "l_discount", "share")
    return out.select(
        "l_returnflag", "l_discount", F.round("share", 9).alias("share"), F.round("at_or_above", 9).alias("at_or_above")
    )


@query("a19_conditional_distribution", """SELECT l_returnflag, l_linestatus,
round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS chance FROM lineitem GROUP BY 1, 2""")
def conditional_distribution(spark, d):
    from ..operators.rollup import conditional_shares

    out = conditional_shares(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], F.lit(1))
    return out.withColumn("chance", F.round("chance", 9))


@query("a20_category_collapse", """SELECT CAST(CASE WHEN l_quantity >= 40 THEN 6 WHEN l_quantity >= 20 THEN 4 ELSE 2 END
  AS INTEGER) AS score, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1""")
def category_collapse(spark, d):
    from ..operators.rollup import conditional_shares

    score = F.when(F.col("l_quantity") >= 40, 6).when(F.col("l_quantity") >= 20, 4).otherwise(2)
    lines = table(spark, d, "lineitem").select(score.alias("score"))
    return conditional_shares(lines, [], ["score"], F.lit(1), out="share").withColumn("share", F.round("share", 9))


@query("a21_pooled_distributions", """WITH h AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, l_returnflag AS paper,
  l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT * FROM h UNION ALL SELECT yr, 'A+R', l_quantity, CAST(sum(n) AS BIGINT) FROM h
WHERE paper IN ('A', 'R') GROUP BY 1, 3""")
def pooled_distributions(spark, d):
    h = table(spark, d, "lineitem").groupBy(
        F.year("l_shipdate").alias("yr"), F.col("l_returnflag").alias("paper"), "l_quantity"
    ).agg(F.count("*").alias("n"))
    pool = h.where(F.col("paper").isin("A", "R")).groupBy("yr", F.lit("A+R").alias("paper"), "l_quantity").agg(
        F.sum("n").alias("n")
    )
    return h.unionByName(pool)


@query("a25_weighted_quantile", """WITH h AS (SELECT l_returnflag, l_extendedprice AS price, sum(l_quantity) AS n
  FROM lineitem GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY price) AS reach,
  sum(n) OVER (PARTITION BY l_returnflag) AS total FROM h)
SELECT l_returnflag, min(CASE WHEN reach >= 0.25 * total THEN price END) AS q25,
  min(CASE WHEN reach >= 0.5 * total THEN price END) AS q50 FROM w GROUP BY 1""")
def weighted_quantile(spark, d):
    lines = table(spark, d, "lineitem")
    q = [
        hist.weighted_quantile(lines, ["l_returnflag"], "l_extendedprice", "l_quantity", f, f"q{int(f * 100)}")
        for f in (0.25, 0.5)
    ]
    return q[0].join(q[1], "l_returnflag")


@query("a26_class_histogram", """SELECT CAST(least(9, floor(l_extendedprice / 10500.0)) AS INTEGER) AS bin,
round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0), 4) AS "A",
round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0), 4) AS "N",
round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0), 4) AS "R" FROM lineitem GROUP BY 1""")
def class_histogram(spark, d):
    bins = hist.fixed_bins(F.col("l_extendedprice"), 10500.0, 10).alias("bin")
    out = table(spark, d, "lineitem").groupBy(bins).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return out.select("bin", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("A", "N", "R")])


@query("a27_smoothed_density", """WITH b AS (SELECT CAST(least(49, floor(l_extendedprice / 2100.0)) AS INTEGER) AS bin,
  CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(50) LEFT JOIN b ON b.bin = range)
SELECT bin, round((coalesce(lag(n, 2) OVER o, 0) + 2 * coalesce(lag(n) OVER o, 0) + 3 * n
  + 2 * coalesce(lead(n) OVER o, 0) + coalesce(lead(n, 2) OVER o, 0)) / 9, 6) AS density
FROM g WINDOW o AS (ORDER BY bin)""")
def smoothed_density(spark, d):
    from ..operators.rollup import smooth_bins

    bins = hist.fixed_bins(F.col("l_extendedprice"), 2100.0, 50)
    out = smooth_bins(table(spark, d, "lineitem").select(bins.alias("bin")), "bin", 50, F.lit(1.0))
    return out.withColumn("density", F.round("density", 6))


@query("w16_cumulative_milestones", """WITH w AS (SELECT o_orderkey, o_orderstatus, o_totalprice,
  sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS reach,
  sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS total FROM orders)
SELECT o_orderstatus, CAST(m AS DOUBLE) AS milestone, arg_min(o_orderkey, reach) AS o_orderkey
FROM w, (SELECT unnest([0.1, 0.25, 0.5, 0.9]) AS m) WHERE reach >= m * total GROUP BY 1, 2""")
def cumulative_milestones(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = hist.milestones(orders, ["o_orderstatus"], [-F.col("o_totalprice"), F.col("o_orderkey")], "o_totalprice",
                          [0.1, 0.25, 0.5, 0.9], "o_orderkey")
    return out.drop("reach")


@query("j8_asof_interpolation", """WITH k AS (SELECT user_id, epoch_us(ts) AS x, max(value) AS y FROM events
  WHERE event_type = 'purchase' GROUP BY 1, 2),
p AS (SELECT event_id, user_id, epoch_us(ts) AS x FROM events WHERE event_type <> 'purchase'),
lo AS (SELECT p.*, k.x AS x0, k.y AS y0 FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.x >= k.x),
hi AS (SELECT lo.*, k.x AS x1, k.y AS y1 FROM lo ASOF LEFT JOIN k ON lo.user_id = k.user_id AND lo.x < k.x)
SELECT event_id, user_id, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0
  ELSE y0 + (y1 - y0) * (CAST(x AS DOUBLE) - x0) / (CAST(x1 AS DOUBLE) - x0) END, 6) AS value FROM hi""")
def asof_interpolation(spark, d):
    events = table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("x")
    )
    knots = events.where("event_type = 'purchase'").select("user_id", "x", F.col("value").alias("y"))
    probes = events.where("event_type <> 'purchase'").select("event_id", "user_id", "x")
    out = interp.asof_interpolate(probes, knots, ["user_id"], "x")
    return out.select("event_id", "user_id", F.round("value", 6).alias("value"))
