"""Weights moved between rows: factors to published totals, shortfalls, capacity walks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def route_factors(held: DataFrame, totals: DataFrame, keys: Sequence[str], route: str, weight: str, total: str,
                  reserved: Mapping[str, str] | None = None, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """Published total over held weight per route, 1 where either is missing.

    A reserved child route keeps factor 1 and its held weight is taken out of its
    parent's total, floored at zero. ``renamed`` maps a route to its name in the
    totals. Routes are a short vocabulary, so these tables are tiny.
    """
    reserved, renamed = dict(reserved or {}), dict(renamed or {})
    name = F.col(route)
    parent = _mapped(name, reserved)
    child = held.where(parent.isNotNull()).groupBy(*keys, parent.alias("_r")).agg(F.sum(weight).alias("_reserved"))
    total_name = F.coalesce(_mapped(name, renamed), name)
    out = held.withColumn("_t", total_name).withColumn("_r", name)
    published = totals.select(*keys, F.col(route).alias("_t"), F.col(total).alias("_total"))
    out = out.join(published, [*keys, "_t"], "left").join(child, [*keys, "_r"], "left")
    left = F.greatest(F.col("_total") - F.coalesce("_reserved", F.lit(0.0)), F.lit(0.0))
    factor = (
        F.when(name.isin(list(reserved)), 1.0)
        .when((left > 0) & (F.col(weight) > 0), left / F.col(weight))
        .otherwise(1.0)
    )
    return out.select(*keys, route, weight, factor.alias("factor"))


def _mapped(name: Column, pairs: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for source, target in pairs.items():
        out = F.when(name == source, F.lit(target)).otherwise(out)
    return out


def shortfalls(held: DataFrame, totals: DataFrame, route: str, weight: str, total: str) -> DataFrame:
    """Weight missing from each published total, as rows at level 0."""
    covered = held.groupBy(route).agg(F.sum(weight).alias("_held"))
    missing = totals.join(covered, route, "left").select(
        route, F.lit(0.0).alias("level"), (F.col(total) - F.coalesce("_held", F.lit(0.0))).alias(weight)
    )
    return missing.where(F.col(weight) > 0)


def coverage(held: DataFrame, published: DataFrame, keys: Sequence[str], have: str = "held",
             want: str = "published") -> DataFrame:
    both = held.join(published, list(keys), "full_outer")
    return both.select(*keys, have, want, F.try_divide(have, want).alias("coverage"))


def headcounts(df: DataFrame, exam: str, subject: str, weight: str,
               pools: Mapping[str, Mapping[str, Sequence]] | None = None) -> DataFrame:
    """Headcount proxy: the largest subject sum; pooled papers add up instead."""
    pools = dict(pools or {})
    sums = df.groupBy(exam, subject).agg(F.sum(weight).alias("_n"))
    plain = sums.where(~F.col(exam).isin(list(pools))) if pools else sums
    out = plain.groupBy(exam).agg(F.max("_n").alias("takers"))
    for name, parts in pools.items():
        for pool, papers in parts.items():
            here = sums.where((F.col(exam) == name) & F.col(subject).isin(list(papers)))
            out = out.unionByName(here.agg(F.sum("_n").alias("takers")).select(F.lit(pool).alias(exam), "takers"))
    return out


def composition(df: DataFrame, keys: Sequence[str], weight: str, kinds: Mapping[str, Column], total: Column) -> DataFrame:
    """Shares of a published total by kind; what no kind holds stays as ``unreported``."""
    got = df.groupBy(*keys).agg(
        *[F.sum(F.when(test, F.col(weight)).otherwise(0)).alias("_" + name) for name, test in kinds.items()],
        total.alias("_total"),
    )
    named = [F.try_divide("_" + n, "_total").alias(n) for n in kinds]
    seen = sum((F.col("_" + n) for n in list(kinds)[1:]), F.col("_" + next(iter(kinds))))
    return got.select(*keys, *named, (1 - F.try_divide(seen, F.col("_total"))).alias("unreported"))


def rate_applied(rows: DataFrame, rates: DataFrame, keys: Sequence[str], weight: str, rate: str,
                 default: float) -> DataFrame:
    """Weight times its key's rate, rounded; a default where no rate is known."""
    out = rows.join(rates.select(*keys, F.col(rate).alias("_rate")), list(keys), "left")
    got = F.round(F.col(weight) * F.coalesce("_rate", F.lit(float(default))))
    return out.withColumn("estimate", got.cast("bigint")).drop("_rate")


def consume(buckets: DataFrame, demands: DataFrame, keys: Sequence[str], value: str, capacity: str,
            cutoff: str, wanted: str, **options) -> DataFrame:
    """Walk ordered buckets from the first at or above the cutoff until demand is met.

    One demand per key. A demand its buckets cannot meet takes nothing at all.
    The walk is a prefix sum, so no row waits for another.
    """
    joined = buckets.join(demands.select(*keys, cutoff, wanted), list(keys)).where(F.col(value) >= F.col(cutoff))
    walked = running(joined, keys, [value], {"_before": capacity}, before=True, totals={"_held": capacity}, **options)
    take = F.greatest(F.lit(0.0), F.least(F.col(capacity), F.col(wanted) - F.col("_before")))
    out = walked.where(F.col("_held") >= F.col(wanted)).withColumn("taken", take)
    return out.where("taken > 0").drop("_before", "_held", cutoff, wanted)


def deduct_by_priority(cells: DataFrame, demands: DataFrame, keys: Sequence[str], route: str, order: Sequence[str],
                       weight: str, method: str, wanted: str, tag: str) -> DataFrame:
    """Take a demand out of an entity's routes in a fixed order, tagging each row touched.

    Rows per key are at most the number of routes.
    """
    place = F.array_position(F.array(*[F.lit(r) for r in order]), F.col(route))
    all_cells = cells.join(demands.select(*keys, F.col(wanted).alias("_want")), list(keys), "left")
    rank = F.when(place > 0, place).otherwise(len(order) + 1)
    along = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    able = F.when(place > 0, F.coalesce(F.col(weight), F.lit(0.0))).otherwise(0.0)
    taken_before = F.coalesce(F.sum(able).over(along), F.lit(0.0))
    moved = F.greatest(F.lit(0.0), F.least(able, F.coalesce(F.col("_want"), F.lit(0.0)) - taken_before))
    out = all_cells.withColumn("_moved", moved)
    hit = F.col("_moved") > 0
    return out.withColumn(weight, F.when(hit, F.col(weight) - F.col("_moved")).otherwise(F.col(weight))).withColumn(
        method, F.when(hit, F.concat(F.col(method), F.lit(tag))).otherwise(F.col(method))
    ).drop("_want", "_moved")
