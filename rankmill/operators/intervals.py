"""Grids, densified spans, interval overlays and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import carried, running


def on_grid(df: DataFrame, grid: Sequence[float], name: str) -> DataFrame:
    """Each row at every point of a fixed grid; the grid is a literal, so nothing is joined."""
    return df.select("*", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias(name))


def with_median(rows: DataFrame, weights: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Look weights up, the median of all known ones standing in for a missing one."""
    typical = weights.agg(F.median(weight)).scalar()
    out = rows.join(weights, list(keys), "left")
    return out.withColumn(weight, F.coalesce(F.col(weight), typical))


def shifted_tables(base: DataFrame, scale: str, score: str, offsets: Mapping) -> DataFrame:
    """Lookup tables of several scales, each moved by its own offset."""
    shift = F.lit(None).cast("int")
    for name, offset in offsets.items():
        shift = F.when(F.col(scale) == name, F.lit(offset)).otherwise(shift)
    return base.withColumn(score, F.col(score) + shift)


def densify(cells: DataFrame, keys: Sequence[str], year: str, routes: Sequence[str]) -> DataFrame:
    """Every year between a key's own ends for each of its routes; new cells are null."""
    keys, routes = list(keys), list(routes)
    span = cells.groupBy(*keys).agg(
        F.sequence(F.min(year), F.max(year)).alias("_years"), F.collect_set(F.struct(*routes)).alias("_routes")
    )
    grid = span.select(*keys, F.explode("_years").alias(year), "_routes").select(
        *keys, year, F.inline("_routes")
    )
    return grid.join(cells, [*keys, year, *routes], "left")


def overlay(steps: DataFrame, keys: Sequence[str], part: str, lo: str, hi: str, y: str, **options) -> DataFrame:
    """Sum several step functions over the intervals all their breakpoints make.

    Each part is read at an interval's midpoint, from its first step ending at or
    past it. Edges are placed by union and carry, so no range join is needed.
    """
    keys = list(keys)
    edges = steps.select(*keys, F.explode(F.array(lo, hi)).alias("lo")).distinct()
    spans = carried(edges, keys, ["lo"], following={"hi": "lo"}, **options).where("hi > lo")
    parts = steps.select(*keys, part).distinct()
    probes = spans.join(parts, keys).select(
        *keys, part, ((F.col("lo") + F.col("hi")) / 2).alias("_x"), F.lit(0).alias("_kind"), "lo", "hi"
    )
    ends = steps.select(*keys, part, F.col(hi).alias("_x"), F.lit(1).alias("_kind"), F.col(y).cast("double").alias("_y"))
    mixed = cut_lineage(probes.unionByName(ends, allowMissingColumns=True))
    read = carried(mixed, [*keys, part], ["_x", "_kind"], following={"_value": "_y"}, **options).where("_kind = 0")
    return read.groupBy(*keys, "lo", "hi").agg(F.sum("_value").alias("total"))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, **options) -> DataFrame:
    """Number the runs of equal neighbouring values along an order."""
    seen = carried(df, keys, order, previous={"_last": F.struct(F.col(value).alias("v"))}, **options)
    fresh = F.col("_last").isNull() | ~F.col("_last")["v"].eqNullSafe(F.col(value))
    marked = seen.withColumn("_fresh", fresh.cast("bigint")).drop("_last")
    return running(marked, keys, order, {"run": "_fresh"}, **options).drop("_fresh")


def merge_equal(df: DataFrame, keys: Sequence[str], lo: str, hi: str, value: str, **options) -> DataFrame:
    """Adjacent intervals of equal value as one."""
    numbered = runs(df, keys, [lo], value, **options)
    return numbered.groupBy(*keys, "run").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi), F.first(value).alias(value)
    ).drop("run")


def gap_groups(df: DataFrame, keys: Sequence[str], order: Sequence, at: Column, gap: float | Column, name: str,
               **options) -> DataFrame:
    """Number the groups of rows that lie closer than a gap to the one before."""
    limit = gap if isinstance(gap, Column) else F.lit(gap)
    base = df.withColumn("_at", at)
    seen = carried(base, keys, order, previous={"_last": "_at"}, **options)
    fresh = (F.col("_last").isNull() | (F.col("_at") - F.col("_last") > limit)).cast("bigint")
    marked = seen.withColumn("_fresh", fresh).drop("_last", "_at")
    return running(marked, keys, order, {name: "_fresh"}, **options).drop("_fresh")
