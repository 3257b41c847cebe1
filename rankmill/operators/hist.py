"""Weighted histograms and the percentile readings taken from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def histogram(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """Weight per distinct value; non-positive weights are dropped first."""
    weight = F.lit(1.0) if weight is None else weight
    rows = df.select(*keys, F.col(value), weight.cast("double").alias("n")).where(F.col("n") > 0)
    return rows.groupBy(*keys, value).agg(F.sum("n").alias("n"))


def buckets(hist: DataFrame, keys: Sequence[str], value: str, **options) -> DataFrame:
    """Each value's weight below it and its key's total weight."""
    return running(hist, keys, [value], {"below": "n"}, before=True, totals={"total": "n"}, **options)


def midranks(hist: DataFrame, keys: Sequence[str], value: str, **options) -> DataFrame:
    """Tied midrank percentile of every distinct value: (below + n/2) / total."""
    found = buckets(hist, keys, value, **options)
    return found.withColumn("midrank", F.try_divide(F.col("below") + F.col("n") / 2, F.col("total")))


def intervals(hist: DataFrame, keys: Sequence[str], value: str, **options) -> DataFrame:
    """Ascending percentile intervals (lo, hi] held by each value."""
    found = buckets(hist, keys, value, **options)
    return found.select(
        *keys,
        value,
        "n",
        F.try_divide("below", "total").alias("lo"),
        F.try_divide(F.col("below") + F.col("n"), F.col("total")).alias("hi"),
    )


def top_share(
    levels: DataFrame, hist: DataFrame, keys: Sequence[str], level: str, value: str, out: str = "top", **options
) -> DataFrame:
    """Share strictly above each level plus half its tied bucket.

    Levels need not occur in the histogram. A key with no histogram reads null.
    """
    keys = list(keys)
    tied = hist.select(*keys, F.col(value).cast("double").alias(level), F.col("n").alias("_n"))
    asked = levels.withColumn(level, F.col(level).cast("double")).join(tied, [*keys, level], "left")
    asked = asked.select(
        *keys, F.col(level).alias("_x"), F.struct(*levels.columns).alias("_row"), F.col("_n").alias("_tied"),
        F.lit(0.0).alias("_w"), F.lit(0).alias("_kind"), F.xxhash64(*levels.columns).alias("_tie"),
    )
    known = hist.select(
        *keys, F.col(value).cast("double").alias("_x"), F.col("n").alias("_w"), F.lit(1).alias("_kind"),
        F.lit(0).cast("bigint").alias("_tie"),
    )
    mixed = asked.unionByName(known, allowMissingColumns=True)
    # From the top down a level comes just before the bucket it ties with.
    walked = running(mixed, keys, [-F.col("_x"), "_kind", "_tie"], {"_above": "_w"}, totals={"_total": "_w"},
                     **options).where("_kind = 0")
    share = (F.col("_above") + F.coalesce("_tied", F.lit(0.0)) / 2) / F.col("_total")
    return walked.select("_row.*", F.when(F.col("_total") > 0, share).alias(out))


def share_at_or_above(pmf: DataFrame, keys: Sequence[str], value: str, share: str, **options) -> DataFrame:
    """Running share from the highest value down, the value itself included."""
    return running(pmf, keys, [-F.col(value)], {"at_or_above": share}, **options)


def weighted_quantile(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, fraction: float, out: str = "quantile", **options
) -> DataFrame:
    """First value whose running weight reaches ``fraction`` of its key's weight."""
    hist = histogram(df, keys, value, F.col(weight))
    walked = running(hist, keys, [value], {"reach": "n"}, totals={"total": "n"}, **options)
    return (
        walked.where(F.col("reach") >= fraction * F.col("total"))
        .groupBy(*keys)
        .agg(F.min(value).alias(out))
    )


def fixed_bins(value: Column, width: float, bins: int) -> Column:
    """Fixed-width bin number with the last bin closed."""
    return F.least(F.lit(bins - 1), F.floor(value / width)).cast("int")


def milestones(df: DataFrame, keys: Sequence[str], order, weight: str, fractions: Sequence[float], unique: str,
               **options) -> DataFrame:
    """First row, in order, where the running weight reaches each milestone."""
    walked = running(df, keys, order, {"reach": weight}, totals={"total": weight}, **options)
    marks = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    # A row is the first to reach a mark exactly when the walk was short of it just before.
    hit = walked.select("*", marks.alias("milestone")).where(
        (F.col("reach") >= F.col("milestone") * F.col("total"))
        & (F.col("reach") - F.col(weight) < F.col("milestone") * F.col("total"))
    )
    place = F.struct("reach", unique)
    return hit.groupBy(*keys, "milestone").agg(
        F.min_by(unique, place).alias(unique), F.min("reach").alias("reach")
    )
