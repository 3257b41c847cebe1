"""Density readings, batched model scoring, noisy bars and eligible groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal
from ..operators import atoms, latent, models, pairs
from ..session import cut_lineage
from .registry import query, table

# Candidate densities at 0, 1/2 and 1 for each scale.
CANDIDATES = {
    "flat": {"A": (1.0, 1.0, 1.0), "N": (1.0, 1.0, 1.0), "R": (1.0, 1.0, 1.0)},
    "rising": {"A": (0.5, 1.0, 1.5), "N": (1.0, 1.0, 1.0), "R": (1.5, 1.0, 0.5)},
    "peaked": {"A": (0.6, 1.4, 0.6), "N": (0.8, 1.2, 0.8), "R": (1.0, 1.0, 1.0)},
    "falling": {"A": (1.4, 1.0, 0.6), "N": (0.5, 1.2, 1.1), "R": (1.2, 1.0, 0.8)},
    "hollow": {"A": (1.5, 0.5, 1.5), "N": (1.0, 1.0, 1.0), "R": (1.0, 1.0, 1.0)},
    "overfull": {"A": (3.0, 0.0, 1.0), "N": (1.0, 1.0, 1.0), "R": (1.0, 1.0, 1.0)},
}
FAMILIES = {"flat": "none", "rising": "sloped", "falling": "sloped", "peaked": "bent", "hollow": "bent", "overfull": "bent"}
SIZES = {"A": 100.0, "N": 120.0, "R": 60.0}

DENSITY = "dn(cand, scale, v0, v1, v2) AS (VALUES " + ", ".join(
    f"('{c}', '{s}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for c, by in CANDIDATES.items() for s, v in by.items()) + ")"
PAIRS = """a AS (SELECT l_partkey AS grp, l_returnflag AS scale, sum(l_discount * 10 * l_quantity) / sum(l_quantity) AS top, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.grp, a.scale AS scale_a, a.top AS top_a, b.scale AS scale_b, b.top AS top_b, least(a.w, b.w) AS weight FROM a JOIN a b ON a.grp = b.grp AND a.scale < b.scale)"""


def _level(t: str, v: str) -> str:
    need = f"({t} - CASE WHEN ({v}.v1 + {v}.v2) / 4 >= {t} THEN 0 ELSE ({v}.v1 + {v}.v2) / 4 END)"
    hit = f"(({v}.v1 + {v}.v2) / 4 >= {t})"
    left, right = f"(CASE WHEN {hit} THEN {v}.v1 ELSE {v}.v0 END)", f"(CASE WHEN {hit} THEN {v}.v2 ELSE {v}.v1 END)"
    down = f"({right} + sqrt(greatest({right} * {right} - 4 * ({right} - {left}) * {need}, 0)))"
    return f"((CASE WHEN {hit} THEN 1.0 ELSE 0.5 END) - CASE WHEN {down} = 0 THEN 0 ELSE 2 * {need} / {down} END)"


READ = PAIRS + ", " + DENSITY + f""",
rd AS (SELECT p.*, x.cand, {_level('least(1, greatest(0, top_a))', 'x')} AS la, {_level('least(1, greatest(0, top_b))', 'y')} AS lb
  FROM p JOIN dn x ON x.scale = scale_a JOIN dn y ON y.scale = scale_b AND y.cand = x.cand)"""


def observation_pairs(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "grp")
    return pairs.scale_pairs(lines, ["grp"], F.col("l_returnflag"), F.col("l_discount") * 10, F.col("l_quantity"))


def densities(spark, names=tuple(CANDIDATES)):
    rows = [(c, s, list(v)) for c in names for s, v in CANDIDATES[c].items()]
    return spark.createDataFrame(rows, "candidate string, scale string, values array<double>")


def families(spark):
    return spark.createDataFrame(list(FAMILIES.items()), "candidate string, family string")


@query("f12_normal_functions", f"""SELECT l_orderkey, l_linenumber, round({normal.ppf_sql('(l_discount / 0.11 * 0.98 + 0.01)')}, 8) AS z,
round({normal.sf_sql('((l_quantity - 25) / 6)')}, 8) AS above FROM lineitem""")
def normal_functions(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(normal.ppf(F.col("l_discount") / 0.11 * 0.98 + 0.01), 8).alias("z"),
        F.round(normal.sf((F.col("l_quantity") - 25) / 6), 8).alias("above"))


@query("m11_linear_density_levels", f"WITH {READ} SELECT grp, scale_a, scale_b, cand AS candidate, round(la, 8) AS level_a, round(lb, 8) AS level_b FROM rd")
def linear_density_levels(spark, d):
    out = models.read_pairs(observation_pairs(spark, d), densities(spark))
    return out.select("grp", "scale_a", "scale_b", "candidate", F.round("level_a", 8).alias("level_a"), F.round("level_b", 8).alias("level_b"))


@query("m11_constant_density_levels", """WITH t AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS t FROM lineitem),
k AS (SELECT *, CASE WHEN 0.55 >= t THEN 2 WHEN 0.85 >= t THEN 1 ELSE 0 END AS k FROM t)
SELECT l_orderkey, l_linenumber, round((k + 1) / 3.0 - (t - CASE k WHEN 2 THEN 0 WHEN 1 THEN 0.55 ELSE 0.85 END) /
  (CASE k WHEN 2 THEN 0.55 WHEN 1 THEN 0.3 ELSE 0.15 END * 3), 8) AS level FROM k""")
def constant_density_levels(spark, d):
    shares = F.array(F.lit(0.15), F.lit(0.30), F.lit(0.55))
    lines = table(spark, d, "lineitem").withColumn("s", shares).withColumn("above", F.array(
        F.lit(1.0), F.lit(0.85), F.lit(0.55), F.lit(0.0)))
    level = models.level_constant(F.col("l_discount") * 10, F.col("s"), F.col("above"))
    return lines.select("l_orderkey", "l_linenumber", F.round(level, 8).alias("level"))


@query("p13_unimodal_arrays", """WITH c AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n,
  count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_partkey, NOT (n < a AND n < r) AS unimodal, a > 0 AND n > 0 AND r > 0 AS positive FROM c""")
def unimodal_arrays(spark, d):
    flag = F.col("l_returnflag")
    counts = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.array(*[F.count_if(flag == f).cast("double") for f in "ANR"]).alias("v"))
    return counts.select("l_partkey", models.unimodal(F.col("v")).alias("unimodal"), F.forall("v", lambda x: x > 0).alias("positive"))


@query("m12_candidate_scores", f"""WITH {READ}, ok AS (SELECT cand FROM dn GROUP BY 1 HAVING bool_and(abs((v0 + 2 * v1 + v2) / 4 - 1) < 1e-6
  AND least(v0, v1, v2) >= 0 AND greatest(v0, v1, v2) * CASE scale WHEN 'A' THEN 100 WHEN 'N' THEN 120 ELSE 60 END <= 220 / 1.4)
  AND least(sum(v0 * z), sum(v1 * z), sum(v2 * z)) >= 220 / 1.4 * (1 - 1e-9)),
ls AS (SELECT cand, sum(weight * (la - lb) * (la - lb)) / sum(weight) AS sq, 100 * sum(weight * abs(la - lb)) / sum(weight) AS mae FROM rd GROUP BY 1),
pn AS (SELECT cand, sum(0.05 * pow(v2 - 2 * v1 + v0, 2)) AS pen FROM dn GROUP BY 1)
SELECT cand AS candidate, round(mae, 6) AS mae, round(sq + pen, 8) AS loss FROM ls JOIN pn USING (cand) JOIN ok USING (cand)""".replace(
    "HAVING bool_and", "HAVING bool_and").replace("FROM dn GROUP BY 1 HAVING", "FROM (SELECT *, CASE scale WHEN 'A' THEN 100 WHEN 'N' THEN 120 ELSE 0 END AS z FROM dn) GROUP BY 1 HAVING"))
def candidate_scores(spark, d):
    live = models.feasible(densities(spark), SIZES, ["A", "N"], overlap=0.4)
    out = models.score(observation_pairs(spark, d), live, curvature=0.05)
    return out.select("candidate", F.round("mae", 6).alias("mae"), F.round("loss", 8).alias("loss"))


FAMILY = "fm(cand, family) AS (VALUES " + ", ".join(f"('{c}', '{f}')" for c, f in FAMILIES.items()) + ")"


@query("m13_held_out_comparison", f"""WITH {READ}, {FAMILY},
gw AS (SELECT grp, sum(weight) AS gw FROM p GROUP BY 1), gn AS (SELECT grp, (row_number() OVER (ORDER BY gw DESC, grp) - 1) % 10 AS t FROM gw),
gf AS (SELECT grp, CASE WHEN t < 5 THEN t ELSE 9 - t END AS fold FROM gn),
ce AS (SELECT cand, fold, sum(weight) AS w, sum(weight * abs(la - lb)) AS a, sum(weight * (la - lb) * (la - lb)) AS q FROM rd JOIN gf USING (grp) GROUP BY 1, 2),
tr AS (SELECT ce.*, family, (sum(q) OVER (PARTITION BY cand) - q) / (sum(w) OVER (PARTITION BY cand) - w) AS train FROM ce JOIN fm USING (cand)),
bs AS (SELECT DISTINCT ON (family, fold) family, fold, 100 * a / w AS mae, w FROM tr ORDER BY family, fold, train, cand)
SELECT family, round(sum(mae * w) / sum(w), 6) AS mae, round(stddev_pop(mae), 6) AS fold_sd FROM bs GROUP BY 1""")
def held_out_comparison(spark, d):
    out = models.held_out(cut_lineage(observation_pairs(spark, d)), densities(spark), families(spark), "grp", 5)
    return out.select("family", F.round("mae", 6).alias("mae"), F.round("fold_sd", 6).alias("fold_sd"))


DEGREES = {"none": 0, "sloped": 2, "bent": 4}
DEG = "dg(family, degrees) AS (VALUES " + ", ".join(f"('{f}', {n})" for f, n in DEGREES.items()) + ")"


@query("m13_full_and_held_out", f"""WITH {READ}, {FAMILY}, {DEG},
gw AS (SELECT grp, sum(weight) AS gw FROM p GROUP BY 1), gn AS (SELECT grp, (row_number() OVER (ORDER BY gw DESC, grp) - 1) % 10 AS t FROM gw),
gf AS (SELECT grp, CASE WHEN t < 5 THEN t ELSE 9 - t END AS fold FROM gn),
ce AS (SELECT cand, fold, sum(weight) AS w, sum(weight * abs(la - lb)) AS a, sum(weight * (la - lb) * (la - lb)) AS q FROM rd JOIN gf USING (grp) GROUP BY 1, 2),
tr AS (SELECT ce.*, family, (sum(q) OVER (PARTITION BY cand) - q) / (sum(w) OVER (PARTITION BY cand) - w) AS train FROM ce JOIN fm USING (cand)),
bs AS (SELECT DISTINCT ON (family, fold) family, fold, 100 * a / w AS mae, w FROM tr ORDER BY family, fold, train, cand),
ho AS (SELECT family, sum(mae * w) / sum(w) AS held, stddev_pop(mae) AS sd FROM bs GROUP BY 1),
ff AS (SELECT DISTINCT ON (family) family, mae, mse FROM (SELECT family, cand, 100 * sum(weight * abs(la - lb)) / sum(weight) AS mae,
  10000 * sum(weight * (la - lb) * (la - lb)) / sum(weight) AS mse FROM rd JOIN fm USING (cand) GROUP BY 1, 2) ORDER BY family, mse, cand),
n AS (SELECT count(*) AS n FROM p)
SELECT family, degrees, round(mae, 6) AS mae, round(mse, 6) AS mse,
  round(n * ln(mse / (SELECT mse FROM ff WHERE family = 'none')) + degrees * ln(n), 4) AS bic_delta,
  round(held, 6) AS held_out_mae, round(sd, 6) AS fold_sd, CAST(row_number() OVER (ORDER BY mae, family) AS INTEGER) AS full_rank,
  CAST(row_number() OVER (ORDER BY held, family) AS INTEGER) AS held_out_rank FROM ff JOIN ho USING (family) JOIN dg USING (family), n""")
def full_and_held_out(spark, d):
    degrees = F.create_map(*[F.lit(x) for pair in DEGREES.items() for x in pair])
    known = families(spark).withColumn("degrees", F.element_at(degrees, F.col("family")))
    out = models.compared(cut_lineage(observation_pairs(spark, d)), densities(spark), known, "grp", "none", 5)
    return out.select("family", "degrees", *[F.round(c, 6).alias(c) for c in ("mae", "mse")], F.round("bic_delta", 4).alias("bic_delta"),
                      *[F.round(c, 6).alias(c) for c in ("held_out_mae", "fold_sd")], "full_rank", "held_out_rank")


@query("m14_out_of_bag", f"""WITH {READ}, {FAMILY},
g AS (SELECT grp, cand, sum(weight) AS w, sum(weight * abs(la - lb)) AS a, sum(weight * (la - lb) * (la - lb)) AS q FROM rd GROUP BY 1, 2),
u AS (SELECT g.*, r, ('0x' || substr(md5('20260809:' || grp || ':' || r), 1, 7))::BIGINT / 268435456.0 AS u FROM g, range(10) t(r)),
k AS (SELECT *, CASE WHEN u < exp(-1) THEN 0 WHEN u < 2 * exp(-1) THEN 1 WHEN u < 2.5 * exp(-1) THEN 2 WHEN u < (2.5 + 1 / 6.0) * exp(-1) THEN 3
  WHEN u < (2.5 + 1 / 6.0 + 1 / 24.0) * exp(-1) THEN 4 WHEN u < (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0) * exp(-1) THEN 5
  WHEN u < (2.5 + 1 / 6.0 + 1 / 24.0 + 1 / 120.0 + 1 / 720.0) * exp(-1) THEN 6 ELSE 7 END AS k FROM u),
s AS (SELECT cand, r, sum(k * q) / sum(k * w) AS train, 100 * sum(CASE WHEN k = 0 THEN a END) / sum(CASE WHEN k = 0 THEN w END) AS test FROM k GROUP BY 1, 2),
b AS (SELECT DISTINCT ON (family, r) family, r, test FROM s JOIN fm USING (cand) ORDER BY family, r, train, cand),
l AS (SELECT family FROM b GROUP BY 1 ORDER BY avg(test), family LIMIT 1), ld AS (SELECT r, test AS lead FROM b WHERE family = (SELECT family FROM l))
SELECT family, round(avg(test), 6) AS mean, round(avg(test - lead), 6) AS gap, round(avg((lead < test)::INT), 6) AS leader_wins, count(*) AS resamples
FROM b JOIN ld USING (r) GROUP BY 1""")
def out_of_bag(spark, d):
    out = models.out_of_bag(cut_lineage(observation_pairs(spark, d)), densities(spark), families(spark), "grp", 10)
    return out.select("family", *[F.round(c, 6).alias(c) for c in ("mean", "gap", "leader_wins")], "resamples")


MARKS = ("A++", "A+", "A", "B++", "B+", "B", "C")
POINTS = {"A++": 7, "A+": 6, "A": 5, "B++": 4, "B+": 3, "B": 2, "C": 1}
GRADES = {m: m[0] for m in MARKS}


def mark_shares(spark, d):
    """Seven discount bands of each flag stand for the marks of a subject."""
    band = F.element_at(F.array(*[F.lit(m) for m in MARKS]), F.least(F.lit(7), F.floor(F.col("l_discount") * 70 + 0.001).cast("int") + 1))
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("subject"), band.alias("mark"))
    n = lines.groupBy("subject", "mark").agg(F.count("*").alias("n"))
    total = n.groupBy("subject").agg(F.sum("n").alias("t"))
    return n.join(total, "subject").select("subject", "mark", (F.col("n") / F.col("t")).alias("share"))


def _marks_sql(nodes: int, rhos: str) -> str:
    """``ch``: chance of each place of a mark (0 is the best) by rho, node, weight and subject."""
    quad = ", ".join(f"({n}, {float(x)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for n, (x, w) in enumerate(zip(*latent.nodes_of(nodes))))
    reach = normal.sf_sql("((e - rho * x) / sqrt(1 - rho * rho))")
    return f"""sh AS (SELECT subject, place, count(*) / sum(count(*)) OVER (PARTITION BY subject) AS share FROM
  (SELECT l_returnflag AS subject, least(6, floor(l_discount * 70 + 0.001)::INT) AS place FROM lineitem) GROUP BY 1, 2),
fu AS (SELECT s.subject, p.place, coalesce(sh.share, 0) AS share FROM (SELECT DISTINCT subject FROM sh) s CROSS JOIN range(7) p(place) LEFT JOIN sh USING (subject, place)),
ed AS (SELECT subject, place, -({normal.ppf_sql('u')}) AS e FROM (SELECT subject, place, greatest(1e-12, least(1e0 - 1e-12,
  sum(share) OVER (PARTITION BY subject ORDER BY place))) AS u FROM fu)),
ab AS (SELECT rho, node, w, subject, place, CASE place WHEN 6 THEN 1e0 ELSE {reach} END AS above FROM ed, (VALUES {quad}) q(node, x, w), (SELECT unnest({rhos}) AS rho)),
ch AS (SELECT *, above - coalesce(lag(above) OVER (PARTITION BY rho, node, subject ORDER BY place), 0) AS c FROM ab)"""


@query("m15_score_distribution", f"""WITH {_marks_sql(latent.SCORE_NODES, '[0.6e0, 0.9e0]')}
SELECT a.rho, (21 - a.place - n.place - r.place)::INT AS points, round(sum(a.w * a.c * n.c * r.c), 8) AS share
FROM ch a JOIN ch n ON n.subject = 'N' AND n.rho = a.rho AND n.node = a.node JOIN ch r ON r.subject = 'R' AND r.rho = a.rho AND r.node = a.node
WHERE a.subject = 'A' GROUP BY 1, 2""")
def score_distribution(spark, d):
    chances = latent.mark_chances(cut_lineage(mark_shares(spark, d)), MARKS, [0.6, 0.9])
    out = latent.score_table(chances, ["A", "N", "R"], POINTS, GRADES)
    return out.groupBy("rho", "points").agg(F.round(F.sum("share"), 8).alias("share"))


RHO_GRID = (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95)


@query("m16_trait_correlation", f"""WITH {_marks_sql(30, '[' + ', '.join(f'{r}e0' for r in RHO_GRID) + ']')},
gr AS (SELECT rho, node, w, subject, least(2, place // 3) AS g, sum(c) AS c FROM ch GROUP BY ALL),
ct AS (SELECT a.rho, (a.g = 0)::INT + (n.g = 0)::INT + (r.g = 0)::INT AS na, (a.g = 1)::INT + (n.g = 1)::INT + (r.g = 1)::INT AS nb, sum(a.w * a.c * n.c * r.c) AS p
  FROM gr a JOIN gr n ON n.subject = 'N' AND n.rho = a.rho AND n.node = a.node JOIN gr r ON r.subject = 'R' AND r.rho = a.rho AND r.node = a.node
  WHERE a.subject = 'A' GROUP BY 1, 2, 3),
be AS (SELECT l_orderkey, l_returnflag, arg_max(CASE WHEN l_discount < 0.043 THEN 'A' WHEN l_discount < 0.086 THEN 'B' ELSE 'C' END, (l_extendedprice, l_linenumber)) AS g FROM lineitem GROUP BY 1, 2),
ob AS (SELECT na, nb, count(*) AS n FROM (SELECT l_orderkey, count(*) FILTER (g = 'A') AS na, count(*) FILTER (g = 'B') AS nb FROM be GROUP BY 1 HAVING count(*) = 3) GROUP BY 1, 2)
SELECT g.rho, round(sum(2 * ob.n * ln(ob.n / ((SELECT sum(n) FROM ob) * greatest(1e-12, coalesce(ct.p, 0))))), 4) AS deviance
FROM (SELECT DISTINCT rho FROM ct) g CROSS JOIN ob LEFT JOIN ct ON ct.rho = g.rho AND ct.na = ob.na AND ct.nb = ob.nb GROUP BY 1""")
def trait_correlation(spark, d):
    """How far each correlation's categories are from those of orders holding one line of each flag at their dearest."""
    grade = F.when(F.col("l_discount") < 0.043, "A").when(F.col("l_discount") < 0.086, "B").otherwise("C")
    best = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max_by(grade, F.struct("l_extendedprice", "l_linenumber")).alias("g"))
    seen = best.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("g") == "A").alias("a"), F.count_if(F.col("g") == "B").alias("b")).where("n = 3")
    observed = cut_lineage(seen.groupBy(latent.category_text([F.col("a"), F.col("b")], "ABC", 3).alias("category")).agg(F.count("*").alias("count")))
    chances = latent.mark_chances(cut_lineage(mark_shares(spark, d)), MARKS, RHO_GRID, 30)
    scored = latent.score_table(chances, ["A", "N", "R"], POINTS, GRADES)
    out = latent.category_deviance(scored, latent.category_text([F.col("n_A"), F.col("n_B")], "ABC", 3), observed)
    return out.select("rho", F.round("deviance", 4).alias("deviance"))


def noisy_bars(spark, d):
    """Plain bars from flags A and N; flag R rows carry a rank score behind two gates."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(
        (F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity") * 9 + 0.04).alias("t"), F.sum("l_quantity").alias("weight"))
    rank = F.col("l_returnflag") == "R"
    return lines.select(
        F.col("l_partkey").alias("grp"), F.when(rank, "A").otherwise(F.col("l_returnflag")).alias("scale"), F.col("l_returnflag").alias("bucket"),
        F.when(~rank, F.col("t")).alias("top"), F.when(rank, latent.rank_score(F.col("t") * 100)).alias("score"),
        F.when(rank, F.array(F.lit(0.5), F.col("t"))).otherwise(F.array().cast("array<double>")).alias("gates"), "weight")


READER = {"A": (0.5, 1.0, 1.5), "N": (1.0, 1.0, 1.0)}


# Density of scale A is 0.5 + p at a share p of the cohort, of N it is 1; bars are -5 + 0.025 k.
_DENSE = lambda x: f"(CASE scale WHEN 'A' THEN 0.5e0 + 1e0 - {normal.sf_sql(x)} ELSE 1e0 END)"
_CLAMP = lambda x: f"greatest(1e-12, least(1e0 - 1e-12, {x}))"
_QUAD = ", ".join(f"({float(x)!r}::DOUBLE, {float(w)!r}::DOUBLE)" for x, w in zip(*latent.nodes_of(latent.NODES)))


def _noisy_sql(rank_load: float, load: float = 0.9) -> str:
    """Common tables up to ``lv`` (grp, bucket, gated) and, for rank bars, ``pl`` (grp, plain)."""
    rest = f"{(1 - load * load)!r}e0"
    bar_at = f"sum(m * {normal.sf_sql(f'((-5 + 0.025e0 * k - {load}e0 * x) / sqrt({rest}))')}) / sum(m)"
    post = lambda cleared: f"1e0 - {normal.sf_sql(f'(sum(w * d * {cleared} * ab) / sum(w * d * {cleared}))')}"
    gate = normal.sf_sql(f"((gb - {load}e0 * ab) / sqrt({rest}))")
    return f"""nb AS (SELECT *, CASE bucket WHEN 'R' THEN 'A' ELSE bucket END AS scale FROM (SELECT l_partkey AS grp, l_returnflag AS bucket,
  sum(l_discount * l_quantity) / sum(l_quantity) * 9 + 0.04 AS t, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)),
ta AS (SELECT scale, x, {_DENSE('x')} AS m FROM (SELECT scale, {normal.ppf_sql('((i + 0.5e0) / 1024)')} AS x FROM range(1024) r(i), (VALUES ('A'), ('N')) v(scale))),
tl AS (SELECT scale, k, {normal.ppf_sql('tail')} AS z FROM (SELECT scale, k, {_CLAMP(bar_at)} AS tail FROM ta, range(401) r(k) GROUP BY 1, 2)),
tp AS (SELECT scale, t, {normal.ppf_sql(_CLAMP('t'))} AS want FROM (SELECT DISTINCT scale, t FROM nb UNION SELECT 'A', 0.5)),
th AS (SELECT tp.scale, t, CASE count(*) FILTER (z > want) WHEN 0 THEN -5e0 WHEN 401 THEN 5e0 ELSE -5 + 0.025e0 * (count(*) FILTER (z > want) - 1)
  + 0.025e0 * (min(z) FILTER (z > want) - want) / (min(z) FILTER (z > want) - max(z) FILTER (z <= want)) END AS bar
  FROM tp JOIN tl USING (scale) GROUP BY tp.scale, t, want),
nd AS (SELECT *, {_DENSE('ab')} AS d FROM (SELECT grp, bucket, scale, gb, w, ld * b + sqrt(1 - ld * ld) * a AS ab FROM (
  SELECT grp, bucket, nb.scale, CASE bucket WHEN 'R' THEN {normal.ppf_sql('(1e0 - t * 100 / 100e0)')} ELSE th.bar END AS b,
    CASE bucket WHEN 'R' THEN {rank_load}e0 ELSE {load}e0 END AS ld, th.bar AS gb FROM nb JOIN th USING (scale, t)), (VALUES {_QUAD}) q(a, w))),
half AS (SELECT bar AS hb FROM th WHERE scale = 'A' AND t = 0.5),
lv AS (SELECT grp, bucket, CASE bucket WHEN 'R' THEN {post(f"({gate} * {gate.replace('gb', 'hb')})")} ELSE {post('1e0')} END AS gated,
  {post('1e0')} AS plain FROM nd, half GROUP BY grp, bucket)"""


@query("m17_noisy_levels", f"WITH {_noisy_sql(0.8)} SELECT grp, bucket, round(gated, 6) AS level FROM lv")
def noisy_levels(spark, d):
    out = latent.noisy_levels(noisy_bars(spark, d), READER, F.lit(0.9), F.lit(0.8))
    return out.select("grp", "bucket", F.round("level", 6).alias("level"))


@query("m18_loading_sweep")
def loading_sweep(spark, d):
    sides = noisy_bars(spark, d).select("grp", F.col("bucket").alias("order"), "scale", "top", "score", "gates", "weight")
    both = pairs.pair_up(sides.select("grp", F.concat_ws("|", "order", "scale").alias("scale"), "top", "score", "gates", "weight"),
                         ["grp"], ["top", "score", "gates"], "weight")
    both = both.withColumn("scale_a", F.substring_index("scale_a", "|", -1)).withColumn("scale_b", F.substring_index("scale_b", "|", -1))
    sweep = spark.createDataFrame([(f"{lo}-{hi}", lo, hi) for lo in (0.8, 0.95) for hi in (0.6, 0.9)], "candidate string, loading double, rank_loading double")
    out = latent.sweep_loadings(both, READER, sweep)
    return out.select("candidate", F.round("mae", 6).alias("mae"), F.round("normalised", 6).alias("normalised"))


@query("m19_noise_diagnosis", f"""WITH {_noisy_sql(0.8)}, rd AS (SELECT nb.grp, gated AS noisy, weight,
  CASE bucket WHEN 'A' THEN (sqrt(9 - 8 * t) - 1) / 2 ELSE 1 - t END AS exact FROM lv JOIN nb USING (grp, bucket) WHERE bucket <> 'R'),
gp AS (SELECT grp, sum(abs(noisy - exact)) AS s, max(abs(noisy - exact)) AS m, count(*) AS n, sum(weight) AS w, max(exact) - min(exact) AS e,
  max(noisy) - min(noisy) AS o FROM rd GROUP BY 1)
SELECT round(100 * sum(s) / sum(n), 4) AS mean_shift, round(100 * max(m), 4) AS max_shift,
  round(100 * sum(e * w) FILTER (n > 1) / sum(w) FILTER (n > 1), 4) AS before, round(100 * sum(o * w) FILTER (n > 1) / sum(w) FILTER (n > 1), 4) AS after FROM gp""")
def noise_diagnosis(spark, d):
    bars = noisy_bars(spark, d).where("top is not null")
    side = models.with_above(spark.createDataFrame([(s, list(v)) for s, v in READER.items()], "scale string, values array<double>"), True)
    rows = bars.join(F.broadcast(side), "scale").withColumn("exact", models.level_linear(F.col("top"), F.col("values"), F.col("above")))
    rows = latent.noisy_levels(rows, READER, F.lit(0.9), F.lit(0.9), "noisy", gates=None)
    out = latent.diagnose(rows, ["grp"], "exact", "noisy", "weight")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("m19_noise_summary", f"""WITH noisy AS (WITH {_noisy_sql(0.8)} SELECT grp, bucket, gated AS noisy FROM lv),
exact AS (WITH {_noisy_sql(latent.CEILING, latent.CEILING)} SELECT grp, bucket, gated AS exact FROM lv),
gp AS (SELECT grp, sum(abs(noisy - exact)) AS s, max(abs(noisy - exact)) AS m, count(*) AS n, max(exact) - min(exact) AS e, max(noisy) - min(noisy) AS o
  FROM noisy JOIN exact USING (grp, bucket) GROUP BY 1)
SELECT round(100 * sum(s) / sum(n), 4) AS mean_shift, round(100 * max(m), 4) AS max_shift,
  round(100 * avg(e) FILTER (n > 1), 4) AS before, round(100 * avg(o) FILTER (n > 1), 4) AS after FROM gp""")
def noise_summary(spark, d):
    """The noise diagnosis over all bars: rank bars too, both readings behind their gates, gaps averaged over groups alike."""
    bars = noisy_bars(spark, d)
    ceiling = F.lit(latent.CEILING)
    rows = latent.noisy_levels(bars, READER, ceiling, ceiling, "exact")
    rows = latent.noisy_levels(rows, READER, F.lit(0.9), F.lit(0.8), "noisy")
    out = latent.diagnose(rows, ["grp"], "exact", "noisy")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("m19_gate_lift", f"""WITH {_noisy_sql(0.8)} SELECT grp, round(gated, 6) AS gated, round(plain, 6) AS plain, round(100 * (gated - plain), 4) AS lift
FROM lv WHERE bucket = 'R' ORDER BY 100 * (gated - plain) DESC, grp LIMIT 20""")
def gate_lift(spark, d):
    out = latent.gate_lift(noisy_bars(spark, d), READER, 0.9, 0.8, 20, "grp")
    return out.select("grp", F.round("gated", 6).alias("gated"), F.round("plain", 6).alias("plain"), F.round("lift", 4).alias("lift"))


def nation_atoms(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.round((F.avg("s_acctbal") - 4500) / 2500, 3).alias("mean"), (F.count("*") * 40).cast("int").alias("size")).select("mean", "size")


def rank_rows(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_returnflag", "l_linestatus", "l_discount").agg(
        F.round(F.avg("l_tax"), 2).alias("r"), F.count("*").alias("wanted"))
    return lines.select(
        F.concat_ws("-", "year", "l_returnflag", "l_linestatus", F.format_number("l_discount", 2)).alias("id"), "year",
        (F.col("r") + F.round(F.col("l_discount"), 2) + 0.01).alias("rank"),
        F.when(F.col("l_returnflag") == "A", F.array(F.lit(0.25), F.lit(0.4))).when(F.col("l_returnflag") == "N", F.array(F.lit(0.12)))
        .otherwise(F.array().cast("array<double>")).alias("gates"),
        F.when(F.col("l_returnflag") == "A", normal.isf(F.lit(0.25))).when(F.col("l_returnflag") == "N", normal.isf(F.lit(0.12))).alias("gate"), "wanted")


ATOMS = """at0 AS (SELECT round((avg(s_acctbal) - 4500) / 2500, 3) AS mean, count(*) * 40 AS size FROM supplier GROUP BY s_nationkey),
atm AS (SELECT mean, size, count(*) AS copies FROM at0 GROUP BY 1, 2),
rr AS (SELECT year(l_shipdate) || '-' || l_returnflag || '-' || l_linestatus || '-' || printf('%.2f', l_discount) AS id, l_returnflag AS f,
  round(avg(l_tax), 2) + round(l_discount, 2) + 0.01 AS rank, count(*) AS wanted FROM lineitem GROUP BY year(l_shipdate), l_returnflag, l_linestatus, l_discount)"""


def _gate(top: float, level: str) -> str:
    z = normal.ppf_sql(str(1 - top))
    return normal.sf_sql(f"(({z} - 0.9 * {level}) / {(1 - 0.81) ** 0.5!r})")


@query("m20_eligible_mean", f"""WITH {ATOMS}, g AS (SELECT -4.5 + range * (9.0 / 599) AS level FROM range(600)),
gp AS (SELECT level, {_gate(0.25, 'level')} * {_gate(0.4, 'level')} AS pa, {_gate(0.12, 'level')} AS pn FROM g),
rk AS (SELECT DISTINCT rank FROM rr),
ct AS (SELECT rank, mean, copies, floor(rank * size) / size AS share FROM rk, atm),
cu AS (SELECT *, CASE WHEN share >= 1 THEN '-inf'::DOUBLE WHEN share > 0 THEN mean - 0.75 * {normal.ppf_sql('share')} ELSE 'inf'::DOUBLE END AS cut FROM ct),
pf AS (SELECT rank, level, pa, pn, sum(copies * exp(-pow((level - mean) / 0.75, 2) / 2)) AS m FROM cu JOIN gp ON level >= cut GROUP BY 1, 2, 3, 4),
rd AS (SELECT rank, sum(m * pa * level) / nullif(sum(m * pa), 0) AS a, sum(m * pn * level) / nullif(sum(m * pn), 0) AS n, sum(m * level) / nullif(sum(m), 0) AS r FROM pf GROUP BY 1)
SELECT id, round(CASE f WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END, 6) AS reading FROM rr LEFT JOIN rd USING (rank)""")
def eligible_mean(spark, d):
    out = atoms.eligible_mean(rank_rows(spark, d), nation_atoms(spark, d), "rank", "gates")
    return out.select("id", F.round("reading", 6).alias("reading"))


@query("m21_truncated_mean", f"""WITH {ATOMS}, j AS (SELECT id, mean, copies, greatest(-({normal.ppf_sql('rank')}),
  coalesce((CASE f WHEN 'A' THEN -({normal.ppf_sql('0.25')}) WHEN 'N' THEN -({normal.ppf_sql('0.12')}) END - mean) / 0.75, -40)) AS fl FROM rr, atm)
SELECT id, round(sum(mean * copies * {normal.sf_sql('fl')} + copies * 0.75 * exp(-fl * fl / 2) / 2.5066282746310002) / sum(copies * {normal.sf_sql('fl')}), 6) AS reading FROM j GROUP BY 1""")
def truncated_mean(spark, d):
    out = atoms.qualifying_mean(rank_rows(spark, d), nation_atoms(spark, d), "id", "rank", "gate")
    return out.select("id", F.round("reading", 6).alias("reading"))


_GATE_OF = f"(CASE f WHEN 'A' THEN -({normal.ppf_sql('0.25e0')}) WHEN 'N' THEN -({normal.ppf_sql('0.12e0')}) END)"


@query("m22_marginal_level", f"""WITH {ATOMS}, fl AS (SELECT rank, f, mean, copies,
  greatest(-({normal.ppf_sql('rank')}), coalesce(({_GATE_OF} - mean) / 0.75, -40)) AS fl FROM (SELECT DISTINCT rank, f FROM rr), atm),
en AS (SELECT rank, f, min(mean + 0.75 * greatest(fl, -9)) AS low, max(mean) + 6e0 AS high, sum(copies * {normal.sf_sql('fl')}) / sum(copies) AS admits,
  sum(mean * copies * {normal.sf_sql('fl')} + copies * 0.75 * exp(-fl * fl / 2) / 2.5066282746310002) / sum(copies * {normal.sf_sql('fl')}) AS alone FROM fl GROUP BY 1, 2),
gr AS (SELECT *, low + (high - low) / 2399 * i AS level FROM en, range(2400) r(i)),
cu AS (SELECT rank, f, i, level, admits, alone, sum(copies * greatest(0, {normal.sf_sql('fl')} - {normal.sf_sql('((level - mean) / 0.75)')})) / sum(copies) AS share
  FROM gr JOIN fl USING (rank, f) GROUP BY ALL),
st AS (SELECT *, lead(share) OVER p AS share2, lead(level) OVER p AS level2 FROM cu WINDOW p AS (PARTITION BY rank, f ORDER BY i)),
hit AS (SELECT id, any_value(alone) AS alone, any_value(admits) AS admits, any_value(wanted / 200000) AS want,
  arg_max(CASE WHEN share2 IS NULL THEN level ELSE level + (wanted / 200000 - share) / (share2 - share) * (level2 - level) END, i) FILTER (share <= wanted / 200000) AS level
  FROM rr JOIN st USING (rank, f) GROUP BY id)
SELECT id, round(CASE WHEN want <= 0 OR admits <= want THEN alone ELSE level END, 5) AS reading FROM hit""")
def marginal_level(spark, d):
    out = atoms.marginal_level(rank_rows(spark, d), nation_atoms(spark, d), "id", "rank", "gate", "wanted", 200_000.0)
    return out.select("id", F.round("reading", 5).alias("reading"))


@query("w17_depleting_sweep")
def depleting_sweep(spark, d):
    out = atoms.depleting_sweep(cut_lineage(rank_rows(spark, d)), nation_atoms(spark, d), "year", "id", "rank", "gates", "wanted", 200_000.0)
    return out.select("year", "id", F.round(atoms.to_level(F.col("reading")), 6).alias("level"))
