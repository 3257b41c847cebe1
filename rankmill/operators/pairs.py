"""Same-key readings on different scales: pairs, gaps, bias and model losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollup import weighted_mean


def scale_pairs(df: DataFrame, keys: Sequence[str], scale: Column, top: Column, weight: Column) -> DataFrame:
    """One row per key and pair of scales, weighted by the smaller of the two.

    Rows are first reduced to one reading per (key, scale); a key then holds no
    more readings than there are scales, so pairing them inside one short array
    needs no self join.
    """
    rows = df.select(*keys, scale.alias("scale"), top.alias("top"), weight.cast("double").alias("w"))
    rows = rows.where(F.col("scale").isNotNull() & F.col("top").isNotNull())
    sides = rows.groupBy(*keys, "scale").agg(weighted_mean("top", "w").alias("top"), F.sum("w").alias("w"))
    return pair_up(sides, keys, ["top"], "w")


def pair_up(sides: DataFrame, keys: Sequence[str], fields: Sequence[str], weight: str) -> DataFrame:
    found = sides.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("scale", *fields, weight))).alias("_s"))
    found = found.where(F.size("_s") > 1).select(*keys, "_s", F.posexplode("_s").alias("_i", "a"))
    found = found.select(*keys, "a", F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("b"))
    sided = []
    for side in ("a", "b"):
        sided.append(F.col(f"{side}.scale").alias(f"scale_{side}"))
        sided += [F.col(f"{side}.{f}").alias(f"{f}_{side}") for f in fields]
    return found.select(*keys, *sided, F.least(f"a.{weight}", f"b.{weight}").alias("weight"))


def merge_bars(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars of one bucket as one: plain bars average, the heaviest rank bar stands for its kind."""
    plain = F.col("top").isNotNull()
    best = F.max(F.when(~plain, F.struct("weight", "score", "gates"))).alias("_best")
    got = bars.groupBy(*keys, "bucket").agg(
        weighted_mean("top", "weight").alias("top"), best, F.sum("weight").alias("weight")
    )
    return got.select(*keys, "bucket", "top", F.col("_best")["score"].alias("score"),
                      F.col("_best")["gates"].alias("gates"), "weight")


def gap_by_band(df: DataFrame, level: str, gap: str, weight: str, bands: int = 10) -> DataFrame:
    """Weighted mean gap by decile of the level, over keys that have a gap."""
    band = F.least(F.lit(bands - 1), F.floor(F.round(F.col(level) * bands, 9))).cast("int").alias("band")
    return df.where(F.col(gap).isNotNull()).groupBy(band).agg(weighted_mean(gap, weight).alias("gap"))


def pair_bias(pairs: DataFrame, minimum: int = 25) -> DataFrame:
    gap = F.col("top_b") - F.col("top_a")
    return pairs.groupBy("scale_a", "scale_b").agg(
        F.count("*").alias("n"), F.avg(gap).alias("bias"), F.stddev_pop(gap).alias("spread")
    ).where(F.col("n") >= minimum)


def losses(pairs: DataFrame, keys: Sequence[str], left: str, right: str, weight: str) -> DataFrame:
    """Weighted absolute and squared disagreement, and the latter over the level variance."""
    w, a, b = F.col(weight), F.col(left), F.col(right)
    sums = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(w).alias("_w"),
        F.sum(w * F.abs(a - b)).alias("_abs"),
        F.sum(w * (a - b) * (a - b)).alias("_sq"),
        F.sum(w * (a + b)).alias("_m"),
        F.sum(w * (a * a + b * b)).alias("_q"),
    )
    mean = F.try_divide(F.col("_m"), 2 * F.col("_w"))
    variance = F.try_divide(F.col("_q"), 2 * F.col("_w")) - mean * mean
    error = F.try_divide("_sq", "_w")
    return sums.select(
        *keys, "n",
        (100.0 * F.try_divide("_abs", "_w")).alias("mae"),
        (10_000.0 * error).alias("mse"),
        (error / F.greatest(variance, F.lit(1e-9))).alias("normalised"),
    )


def bic_delta(mse: Column, degrees: int, reference: Column, reference_degrees: int, n: Column) -> Column:
    """Gaussian BIC difference to a reference model."""
    return n * F.ln(mse / reference) + (degrees - reference_degrees) * F.ln(n)


def deviance(observed: DataFrame, predicted: DataFrame, category: str, count: str, share: str) -> DataFrame:
    """Multinomial deviance of predicted shares, and the category furthest off."""
    total = observed.agg(F.sum(count)).scalar()
    both = observed.join(predicted, category, "left")
    p = F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(1e-12))
    n = F.col(count)
    term = F.when(n > 0, 2 * n * F.ln(n / (total * p))).otherwise(0.0)
    return both.agg(
        F.sum(term).alias("deviance"),
        F.max_by(category, F.abs(n / total - F.coalesce(share, F.lit(0.0)))).alias("worst"),
    )


def kinds(pairs: DataFrame) -> DataFrame:
    """How many pairs join each kind of bar to each other."""
    kind = F.concat_ws("-", F.least("scale_a", "scale_b"), F.greatest("scale_a", "scale_b"))
    return pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
