"""Lookups, normalised and fuzzy joins, pair generation, grids and interval overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import fuzzy, intervals, pairs, rollup
from ..plans import panel
from .registry import query, table


@query("j1_override_lookup", """SELECT l_orderkey, l_linenumber, CASE WHEN p_size > 25 THEN p_brand ELSE l_returnflag END AS name
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 25""")
def override_lookup(spark, d):
    repairs = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return names.override(lines, repairs, ["l_partkey"], "l_returnflag", "p_brand").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("name"))


@query("j1_repair_count", """SELECT count(*) FILTER (p_size > 25 AND p_brand <> l_returnflag) AS repaired, count(*) AS n
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def repair_count(spark, d):
    repairs = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    out = names.override(lines, repairs, ["l_partkey"], "l_returnflag", "p_brand")
    return out.agg(F.count_if("repaired").alias("repaired"), F.count("*").alias("n"))


def variants(spark, d):
    """Part names as another source spells them: a bracketed note and two letters changed in some."""
    return table(spark, d, "part").select(
        "p_partkey", "p_brand", "p_size",
        F.when(F.col("p_size") > 30, F.concat("p_name", F.lit(" (x)")))
        .when(F.col("p_size") > 15, F.translate("p_name", "i", "l")).otherwise(F.col("p_name")).alias("p_name"))


@query("j2_normalised_join", """WITH k AS (SELECT p_brand, p_name FROM part GROUP BY 1, 2),
v AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 30 THEN p_name || ' (x)' WHEN p_size > 15 THEN replace(p_name, 'i', 'l') ELSE p_name END AS p_name FROM part)
SELECT p_partkey, v.p_brand, k.p_name FROM v JOIN k ON k.p_brand = v.p_brand AND trim(split_part(v.p_name, '(', 1)) = k.p_name""")
def normalised_join(spark, d):
    known = table(spark, d, "part").select("p_brand", "p_name")
    out = fuzzy.join_known(variants(spark, d), known, ["p_brand"], "p_name", names.base_name, F.lit(False))
    return out.select("p_partkey", "p_brand", "p_name")


@query("j3_fuzzy_unambiguous", """WITH k AS (SELECT DISTINCT p_brand, p_name FROM part),
v AS (SELECT DISTINCT p_brand, CASE WHEN p_size > 30 THEN p_name || ' (x)' WHEN p_size > 15 THEN replace(p_name, 'i', 'l') ELSE p_name END AS s FROM part),
p AS (SELECT v.p_brand, s, p_name, 1.0 - levenshtein(s, p_name) / greatest(length(s), length(p_name)) AS sim FROM v JOIN k USING (p_brand)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, s ORDER BY sim DESC, p_name DESC) AS n,
  coalesce(lead(sim) OVER (PARTITION BY p_brand, s ORDER BY sim DESC, p_name DESC), 0) AS second FROM p)
SELECT p_brand, s AS source_name, p_name AS known_name, round(sim, 6) AS similarity FROM r WHERE n = 1 AND sim >= 0.8 AND sim - second >= 0.15 - 1e-12""")
def fuzzy_unambiguous(spark, d):
    known = table(spark, d, "part").select("p_brand", "p_name")
    out = fuzzy.clear_matches(variants(spark, d), known, ["p_brand"], "p_name")
    return out.withColumn("similarity", F.round("similarity", 6))


@query("j4_snap_to_nearest", """WITH k AS (SELECT DISTINCT p_brand, p_name FROM part),
v AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 30 THEN p_name || ' (x)' WHEN p_size > 15 THEN replace(p_name, 'i', 'l') ELSE p_name END AS s FROM part),
u AS (SELECT DISTINCT p_brand, s FROM v),
p AS (SELECT u.p_brand, s, p_name, 1.0 - levenshtein(s, p_name) / greatest(length(s), length(p_name)) AS sim FROM u JOIN k
  ON u.p_brand = k.p_brand AND abs(length(s) - length(p_name)) <= 2),
b AS (SELECT DISTINCT ON (p_brand, s) p_brand, s, p_name FROM p WHERE sim >= 0.6 - 1e-12 ORDER BY p_brand, s, sim DESC, p_name)
SELECT p_partkey, coalesce(b.p_name, v.s) AS snapped FROM v LEFT JOIN b ON b.p_brand = v.p_brand AND b.s = v.s""")
def snap_to_nearest(spark, d):
    known = table(spark, d, "part").select("p_brand", "p_name")
    return fuzzy.snap(variants(spark, d), known, ["p_brand"], "p_name").select("p_partkey", "snapped")


@query("j5_inner_required", """SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL""")
def inner_required(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice is not null").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return orders.join(table(spark, d, "customer").where("c_acctbal is not null").select("c_custkey", "c_name"), "c_custkey")


@query("j6_full_outer_evidence", """WITH s AS (SELECT o_custkey AS sub, year(o_orderdate) AS yr, sum(o_totalprice) AS w, count(*) AS n FROM orders
  WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
a AS (SELECT o_custkey AS sub, year(o_orderdate) AS yr, sum(l_discount * l_quantity) / sum(l_quantity) AS level, sum(l_quantity) AS w
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT sub, CAST(yr AS INTEGER) AS yr, round(coalesce(s.w, a.w), 4) AS weight, round(level, 10) AS level, n FROM s FULL JOIN a USING (sub, yr)""")
def full_outer_evidence(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("sub"), F.year("o_orderdate").alias("yr"),
                                              "o_orderstatus", "o_totalprice")
    held = orders.where("o_orderstatus <> 'P'").groupBy("sub", "yr").agg(F.sum("o_totalprice").alias("sw"), F.count("*").alias("n"))
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount", "l_quantity")
    read = lines.join(orders.select("o_orderkey", "sub", "yr"), "o_orderkey").groupBy("sub", "yr").agg(
        rollup.weighted_mean("l_discount", "l_quantity").alias("level"), F.sum("l_quantity").alias("aw"))
    both = held.join(read, ["sub", "yr"], "full_outer")
    return both.select("sub", "yr", F.round(F.coalesce("sw", "aw"), 4).alias("weight"), F.round("level", 10).alias("level"), "n")


PAIRS = """a AS (SELECT l_partkey, l_returnflag AS scale, sum(l_discount * l_quantity) / sum(l_quantity) AS top, sum(l_quantity) AS w
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
p AS (SELECT a.l_partkey, a.scale AS scale_a, a.top AS top_a, b.scale AS scale_b, b.top AS top_b, least(a.w, b.w) AS weight
  FROM a JOIN a b ON a.l_partkey = b.l_partkey AND a.scale < b.scale)"""


def flag_pairs(spark, d):
    return pairs.scale_pairs(table(spark, d, "lineitem"), ["l_partkey"], F.col("l_returnflag"), F.col("l_discount"), F.col("l_quantity"))


@query("j9_cross_scale_pairs", f"""WITH {PAIRS} SELECT l_partkey, scale_a, round(top_a, 10) AS top_a, scale_b, round(top_b, 10) AS top_b,
round(weight, 4) AS weight FROM p""")
def cross_scale_pairs(spark, d):
    return flag_pairs(spark, d).select("l_partkey", "scale_a", F.round("top_a", 10).alias("top_a"), "scale_b",
                                       F.round("top_b", 10).alias("top_b"), F.round("weight", 4).alias("weight"))


@query("j10_parameter_grid", """SELECT s_suppkey, CAST(g AS DOUBLE) AS g, round(s_acctbal * g, 6) AS v FROM supplier, (SELECT unnest([0.25, 0.5, 0.75, 1.0]) AS g)""")
def parameter_grid(spark, d):
    """A fixed grid is an array literal exploded in place, so no join is needed."""
    out = intervals.on_grid(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [0.25, 0.5, 0.75, 1.0], "g")
    return out.select("s_suppkey", "g", F.round(F.col("s_acctbal") * F.col("g"), 6).alias("v"))


@query("j11_semi_membership", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_membership(spark, d):
    keys = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(keys, "c_custkey", "left_semi")


@query("j11_anti_membership", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def anti_membership(spark, d):
    keys = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(keys, "c_custkey", "left_anti")


@query("j12_median_default", """WITH w AS (SELECT l_suppkey, sum(l_quantity) FILTER (l_tax = 0.08 AND l_linenumber = 1 AND l_returnflag = 'A') AS w FROM lineitem GROUP BY 1)
SELECT s_suppkey, round(coalesce(w, (SELECT median(w) FROM w)), 4) AS weight FROM supplier LEFT JOIN w ON l_suppkey = s_suppkey""")
def median_default(spark, d):
    counted = F.expr("l_tax = 0.08 AND l_linenumber = 1 AND l_returnflag = 'A'")
    w = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum(F.when(counted, F.col("l_quantity"))).alias("w")).where("w is not null")
    out = intervals.with_median(table(spark, d, "supplier").select("s_suppkey"), w, ["s_suppkey"], "w")
    return out.select("s_suppkey", F.round("w", 4).alias("weight"))


@query("j13_densify", """WITH c AS (SELECT o_custkey, year(o_orderdate) AS yr, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, 2, 3),
s AS (SELECT o_custkey, min(yr) AS lo, max(yr) AS hi FROM c GROUP BY 1), y AS (SELECT unnest(range(1990, 2010)) AS yr)
SELECT s.o_custkey, CAST(y.yr AS INTEGER) AS yr, r.st, c.n FROM s JOIN y ON y.yr BETWEEN lo AND hi
JOIN (SELECT DISTINCT o_custkey, st FROM c) r ON r.o_custkey = s.o_custkey
LEFT JOIN c ON c.o_custkey = s.o_custkey AND c.yr = y.yr AND c.st = r.st""")
def densify(spark, d):
    cells = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("yr"), F.col("o_orderstatus").alias("st")).agg(
        F.count("*").alias("n"))
    return intervals.densify(cells, ["o_custkey"], "yr", ["st"])


@query("j14_interval_overlay", """WITH h AS (SELECT l_returnflag AS part, l_quantity AS v, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT part, v, (sum(n) OVER (PARTITION BY part ORDER BY v) - n) / sum(n) OVER (PARTITION BY part) AS lo,
  sum(n) OVER (PARTITION BY part ORDER BY v) / sum(n) OVER (PARTITION BY part) AS hi FROM h),
e AS (SELECT DISTINCT lo AS e FROM b UNION SELECT hi FROM b), s AS (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM e)
SELECT round(s.lo, 9) AS lo, round(s.hi, 9) AS hi, round(sum(v * CASE part WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 0.5 END), 6) AS total
FROM s JOIN b ON b.lo < (s.lo + s.hi) / 2 AND (s.lo + s.hi) / 2 <= b.hi WHERE s.hi > s.lo GROUP BY s.lo, s.hi""")
def interval_overlay(spark, d):
    from ..operators import hist

    h = hist.histogram(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "part"), ["part"], "l_quantity")
    weight = F.when(F.col("part") == "A", 1.0).when(F.col("part") == "N", 2.0).otherwise(0.5)
    steps = hist.intervals(h, ["part"], "l_quantity").select(
        F.lit("all").alias("id"), "part", "lo", "hi", (F.col("l_quantity") * weight).alias("y"))
    out = intervals.overlay(steps, ["id"], "part", "lo", "hi", "y")
    return out.select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round("total", 6).alias("total"))


@query("j15_alias_lookup", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'N' WHEN 'O' THEN 'A' ELSE o_orderstatus END AS alias, n
FROM orders LEFT JOIN (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1)
ON f = CASE o_orderstatus WHEN 'F' THEN 'N' WHEN 'O' THEN 'A' ELSE o_orderstatus END""")
def alias_lookup(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("alias")).agg(F.count("*").alias("n"))
    orders = table(spark, d, "orders").select("o_orderkey", names.renamed(F.col("o_orderstatus"), {"F": "N", "O": "A"}).alias("alias"))
    return orders.join(counts, "alias", "left")


@query("j16_offset_lookup", """WITH t AS (SELECT s_nationkey % 5 AS r, CAST(round(s_acctbal / 100) AS INTEGER) + (s_nationkey % 5) AS score, max(s_acctbal) AS v
  FROM supplier WHERE s_nationkey % 5 < 4 GROUP BY 1, 2),
c AS (SELECT c_custkey, n_regionkey AS r, CAST(round(c_acctbal / 100) AS INTEGER) AS score FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT r, count(*) AS n, count(v) AS found, count(*) - count(v) AS skipped, round(avg(v), 4) AS mean FROM c LEFT JOIN t USING (r, score) GROUP BY 1""")
def offset_lookup(spark, d):
    """Four scales share one table shifted by their own offset; a fifth has none and is counted, not guessed."""
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("r"), F.round(F.col("s_acctbal") / 100).cast("int").alias("score"), "s_acctbal")
    base = s.where("r < 4").groupBy("r", "score").agg(F.max("s_acctbal").alias("v"))
    shifted = intervals.shifted_tables(base, "r", "score", {i: i for i in range(4)})
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r"))
    rows = table(spark, d, "customer").join(nation, "c_nationkey").select("c_custkey", "r", F.round(F.col("c_acctbal") / 100).cast("int").alias("score"))
    got = rows.join(shifted, ["r", "score"], "left")
    return got.groupBy("r").agg(F.count("*").alias("n"), F.count("v").alias("found"), (F.count("*") - F.count("v")).alias("skipped"),
                                F.round(F.avg("v"), 4).alias("mean"))


@query("a23_gap_by_decile", f"""WITH s AS (SELECT l_partkey, l_returnflag AS f, sum(l_discount * 10 * l_quantity) / sum(l_quantity) AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
k AS (SELECT l_partkey, sum(v * w) / sum(w) AS level, sum(w) AS w, max(v) - min(v) AS gap FROM s GROUP BY 1 HAVING count(*) > 1)
SELECT CAST(least(9, floor(round(10 * level, 9))) AS INTEGER) AS band, round(sum(gap * w) / sum(w), 6) AS gap FROM k GROUP BY 1""")
def gap_by_decile(spark, d):
    lines = table(spark, d, "lineitem").withColumn("v", F.col("l_discount") * 10)
    read = rollup.readings(lines, ["l_partkey"], "l_returnflag", ["A", "N", "R"], "v", "l_quantity")
    return pairs.gap_by_band(read, "level", "spread", "weight").withColumn("gap", F.round("gap", 6))


@query("a24_pair_bias", f"""WITH {PAIRS} SELECT scale_a, scale_b, count(*) AS n, round(avg(top_b - top_a), 8) AS bias, round(stddev_pop(top_b - top_a), 8) AS spread
FROM p GROUP BY 1, 2 HAVING count(*) >= 25""")
def pair_bias(spark, d):
    out = pairs.pair_bias(flag_pairs(spark, d), 25)
    return out.withColumn("bias", F.round("bias", 8)).withColumn("spread", F.round("spread", 8))


@query("a28_pair_losses", f"""WITH {PAIRS}, g AS (SELECT top_a - top_b AS g, weight AS w, top_a, top_b FROM p),
l AS (SELECT unnest([top_a, top_b]) AS v, w FROM g), s AS (SELECT sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2) AS var FROM l)
SELECT round(100 * sum(w * abs(g)) / sum(w), 6) AS mae, round(10000 * sum(w * g * g) / sum(w), 6) AS mse,
  round(sum(w * g * g) / sum(w) / greatest(max(var), 1e-9), 6) AS normalised,
  round(count(*) * ln(10000 * sum(w * g * g) / sum(w) / 20.0) + (5 - 3) * ln(count(*)), 4) AS bic_delta FROM g, s""")
def pair_losses(spark, d):
    out = pairs.losses(flag_pairs(spark, d), [], "top_a", "top_b", "weight")
    delta = pairs.bic_delta(F.col("mse"), 5, F.lit(20.0), 3, F.col("n"))
    return out.select(F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"), F.round("normalised", 6).alias("normalised"),
                      F.round(delta, 4).alias("bic_delta"))


@query("a29_multinomial_deviance", """WITH o AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
e AS (SELECT l_returnflag AS f, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1)
SELECT round(sum(2 * n * ln(n / ((SELECT sum(n) FROM o) * greatest(p, 1e-12)))), 6) AS deviance,
  arg_max(f, abs(n / (SELECT sum(n) FROM o) - p)) AS worst FROM o JOIN e USING (f)""")
def multinomial_deviance(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "f")
    seen = lines.where("l_linestatus = 'F'").groupBy("f").agg(F.count("*").alias("n"))
    expected = rollup.conditional_shares(lines.where("l_linestatus <> 'F'"), [], ["f"], F.lit(1), out="p")
    out = pairs.deviance(seen, expected, "f", "n", "p")
    return out.withColumn("deviance", F.round("deviance", 6))


@query("a31_pair_kinds", f"""WITH {PAIRS} SELECT least(scale_a, scale_b) || '-' || greatest(scale_a, scale_b) AS kind, count(*) AS n FROM p GROUP BY 1""")
def pair_kinds(spark, d):
    return pairs.kinds(flag_pairs(spark, d))


@query("a32_merged_bars", """WITH b AS (SELECT l_suppkey, l_returnflag AS bucket, l_quantity AS w, l_discount AS top,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS score FROM lineitem WHERE l_quantity > 0)
SELECT l_suppkey, bucket, round(CASE WHEN bucket <> 'R' THEN sum(top * w) / sum(w) END, 6) AS top,
  CASE WHEN bucket = 'R' THEN max(struct_pack(w := w, score := score)).score END AS score, round(sum(w), 4) AS weight FROM b GROUP BY 1, 2""")
def merged_bars(spark, d):
    lines = table(spark, d, "lineitem")
    rank = F.col("l_returnflag") == "R"
    bars = lines.select("l_suppkey", F.col("l_returnflag").alias("bucket"), F.col("l_quantity").alias("weight"),
                        F.when(~rank, F.col("l_discount")).alias("top"), F.when(rank, F.col("l_extendedprice")).alias("score"),
                        F.array().cast("array<double>").alias("gates"))
    out = pairs.merge_bars(bars, ["l_suppkey"])
    return out.select("l_suppkey", "bucket", F.round("top", 6).alias("top"), "score", F.round("weight", 4).alias("weight"))


@query("p4_route_to_scale", """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'pool_' || lower(o_orderstatus)
WHEN o_orderpriority = '1-URGENT' THEN 'zhikao' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'gsat' END AS scale FROM orders""")
def route_to_scale(spark, d):
    scale = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("pool_"), F.lower("o_orderstatus"))).otherwise(
        names.mapped(F.col("o_orderpriority"), {"1-URGENT": "zhikao", "2-HIGH": "gsat", "3-MEDIUM": "gsat"}))
    return table(spark, d, "orders").select("o_orderkey", scale.alias("scale"))


@query("p5_route_reading", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN 1 - l_discount WHEN l_returnflag = 'R' THEN l_tax END, 6) AS top FROM lineitem""")
def route_reading(spark, d):
    top = F.when(F.col("l_returnflag") == "A", 1 - F.col("l_discount")).when(F.col("l_returnflag") == "R", F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(top, 6).alias("top"))


@query("p6_key_fallback", """WITH k AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size < 25)
SELECT p_partkey, coalesce((SELECT name FROM k WHERE name = p_brand), (SELECT name FROM k WHERE name = p_type), 'shared') AS name FROM part""")
def key_fallback(spark, d):
    part = table(spark, d, "part")
    known = part.where("p_size < 25").select(F.col("p_type").alias("name"))
    return names.first_known(part.select("p_partkey", "p_brand", "p_type"), known, "name", ["p_brand", "p_type"], "shared").select("p_partkey", "name")


@query("p10_status_list", """SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unidentified' WHEN NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 8000)
  THEN 'no_group' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'unscored' ELSE 'matched' END AS status FROM customer""")
def status_list(spark, d):
    from ..operators.checks import status_of

    groups = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("g")).distinct()
    scored = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("s")).distinct()
    rows = table(spark, d, "customer").join(groups, "c_nationkey", "left").join(scored, "c_custkey", "left")
    status = status_of([(F.col("c_acctbal").isNull(), "unidentified"), (F.col("g").isNull(), "no_group"), (F.col("s").isNull(), "unscored")], "matched")
    return rows.select("c_custkey", status.alias("status"))


@query("p7_conflict_checked_dedupe", """SELECT l_orderkey, l_linenumber, max(l_quantity) AS n FROM lineitem GROUP BY 1, 2 HAVING min(l_quantity) = max(l_quantity)""")
def conflict_checked_dedupe(spark, d):
    from ..operators.checks import conflicts, dedupe_checked

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("n"))
    twice = lines.unionByName(lines)
    clash = conflicts(twice, ["l_orderkey", "l_linenumber"], "n").select("l_orderkey", "l_linenumber")
    return dedupe_checked(twice.join(clash, ["l_orderkey", "l_linenumber"], "left_anti"), ["l_orderkey", "l_linenumber"], ["n"])


@query("p8_control_totals", """WITH h AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS held, min(l_extendedprice) AS least FROM lineitem GROUP BY 1)
SELECT coalesce(k, o_orderkey) AS o_orderkey, round(held, 2) AS held, o_totalprice AS published, round(coalesce(held, 0) - coalesce(o_totalprice, 0), 2) AS difference
FROM h FULL JOIN orders ON o_orderkey = k WHERE abs(coalesce(held, 0) - coalesce(o_totalprice, 0)) > 0.01 OR least < 0""")
def control_totals(spark, d):
    from ..operators.checks import control_totals as check

    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    out = check(lines, table(spark, d, "orders"), ["o_orderkey"], "l_extendedprice", "o_totalprice", 0.01)
    return out.select("o_orderkey", F.round("held", 2).alias("held"), "published", F.round("difference", 2).alias("difference"))


@query("p9_total_row", """WITH t AS (SELECT year(o_orderdate) AS yr, coalesce(o_orderpriority, 'all') AS label, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f
  FROM orders GROUP BY GROUPING SETS ((year(o_orderdate), o_orderpriority), (year(o_orderdate))))
SELECT CAST(yr AS INTEGER) AS yr, label, n, f FROM t WHERE label = 'all'""")
def total_row(spark, d):
    from ..operators.checks import total_rows

    orders = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    rows = orders.groupingSets([["yr", "o_orderpriority"], ["yr"]], "yr", "o_orderpriority").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    rows = rows.select("yr", F.coalesce("o_orderpriority", F.lit("all")).alias("label"), "n", "f")
    return total_rows(rows, ["yr"], ["n", "f"])


@query("p11_key_selection", """SELECT DISTINCT o_custkey AS k, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'found' END AS state
FROM (SELECT o_custkey FROM orders UNION ALL SELECT l_suppkey + 1400 FROM lineitem) LEFT JOIN customer ON c_custkey = o_custkey""")
def key_selection(spark, d):
    from ..operators.checks import unknown_keys

    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(
        table(spark, d, "lineitem").select((F.col("l_suppkey") + 1400).alias("k"))).distinct()
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    missing = unknown_keys(wanted, known, "k").withColumn("state", F.lit("missing"))
    return wanted.join(known, "k", "left_semi").withColumn("state", F.lit("found")).unionByName(missing)


@query("a30_field_agreement", """WITH a AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_acctbal > 9900 THEN 0 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_nationkey = 7 THEN 8 ELSE c_nationkey END AS c_nationkey FROM customer),
j AS (SELECT count(*) AS matched, avg((a.c_name = c.c_name)::INT) AS n1, avg((a.c_acctbal = c.c_acctbal)::INT) AS n2, avg((a.c_nationkey = c.c_nationkey)::INT) AS n3
  FROM a JOIN customer c USING (c_custkey))
SELECT matched, field, round(agreement, 6) AS agreement, agreement >= 0.99 AS passed FROM (SELECT matched, unnest(['c_name', 'c_acctbal', 'c_nationkey']) AS field,
  unnest([n1, n2, n3]) AS agreement FROM j)""")
def field_agreement(spark, d):
    from ..operators.checks import field_agreement as agree

    now = table(spark, d, "customer")
    old = now.withColumn("c_acctbal", F.when(F.col("c_acctbal") > 9900, 0.0).otherwise(F.col("c_acctbal"))).withColumn(
        "c_nationkey", F.when(F.col("c_nationkey") == 7, 8).otherwise(F.col("c_nationkey")))
    return agree(old, now, ["c_custkey"], ["c_name", "c_acctbal", "c_nationkey"]).withColumn("agreement", F.round("agreement", 6))
