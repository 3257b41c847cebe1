"""Cumulative-weight tiling and the curves it supports, all years at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, release
from . import interp
from .allocate import route_factors
from .lookup import looked_up
from .ordered import carried, running, sliced
from .rollup import weighted_mean

# Knots of a smoothed curve, rounds and tolerance of the fixed point.
KNOTS = 10
ROUNDS = 12
TOLERANCE = 1e-5


def tile(placed: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], weight: str,
         population: DataFrame | None = None, out: str = "level", **options) -> DataFrame:
    """Level of each row's last place: 1 - weight at or above it / population.

    Rows without a bar still take up places; leaving them out of the points is
    up to the reader. The population (columns keys, ``population``) defaults to
    the weight in hand.
    """
    walked = running(placed, keys, [-F.col(score), *[F.col(t) for t in tie]], {"_above": weight},
                     totals={"_total": weight}, **options)
    size = F.col("_total")
    if population is not None:
        walked = walked.join(population, list(keys), "left")
        size = F.coalesce("population", "_total")
    return walked.withColumn(out, 1.0 - F.col("_above") / size).select(*placed.columns, out)


def pooled(points: DataFrame, keys: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted mean level and weight at each distinct bar."""
    return points.groupBy(*keys, F.col(x).alias("x")).agg(
        weighted_mean(y, weight).alias("y"), F.sum(weight).alias("w")
    )


def _antitonic(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators on rows sorted by x; output one row per pooled block."""
    lo, hi, moment, weight = [], [], [], []
    for a, b, y, w in zip(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy()):
        lo.append(a)
        hi.append(b)
        moment.append(y * w)
        weight.append(w)
        while len(lo) > 1 and moment[-2] / weight[-2] < moment[-1] / weight[-1]:
            last = hi.pop(), moment.pop(), weight.pop()
            lo.pop()
            hi[-1] = last[0]
            moment[-1] += last[1]
            weight[-1] += last[2]
    return pd.DataFrame({"lo": lo, "hi": hi, "m": moment, "w": weight})


def _keyed(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's keys are dropped."""
    other = right.select([F.col(k).alias("__r_" + k) if k in keys else F.col(k) for k in right.columns])
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(other["__r_" + k])
    return left.join(other, match, how).drop(*["__r_" + k for k in keys])


def _spanning(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``__slice``, ``rank``) of keys that lie in several slices, the slices numbered from 0.

    A border between slices parts one key at most, so these are fewer than twice the slices.
    """
    each = blocks.select(*keys, "__slice").distinct()
    along = Window.partitionBy(*keys)
    each = each.withColumn("rank", F.row_number().over(along.orderBy("__slice")) - 1)
    each = each.withColumn("_n", F.count(F.lit(1)).over(along)).where("_n > 1").drop("_n")
    return cut_lineage(each.withColumn("left", F.lit(None).cast("double")).withColumn("right", F.lit(None).cast("double")))


def _bridge(cand: DataFrame, group: Sequence[str], slice_rows: int | None) -> DataFrame:
    """(group, ``level``): the mean of the one block that two falling lists of blocks pool where they meet.

    The pooled level v takes in the blocks of the left list below v and those of the right list
    above v, and is their mean. What these hold beyond v falls as v rises, so v lies behind
    the last block, by mean, where it is not negative yet. Running sums along the means find
    it, however many blocks there are.
    """
    left, zero = F.col("side") == 0, F.lit(0.0)
    sums = {f"_{c}{n}": F.when(on, F.col(c)).otherwise(zero) for n, on in (("l", left), ("r", ~left)) for c in ("m", "w")}
    walked = running(cand, group, ["mean", "side", "lo"], sums, totals={"_mt": sums["_mr"], "_wt": sums["_wr"]}, slice_rows=slice_rows)
    moment = F.col("_ml") + F.col("_mt") - F.col("_mr")
    weight = F.col("_wl") + F.col("_wt") - F.col("_wr")
    held = walked.where(moment - F.col("mean") * weight >= 0)
    return held.groupBy(*group).agg(F.max_by(moment / weight, F.struct("mean", "side", "lo")).alias("level"))


def _merged(blocks: DataFrame, keys: Sequence[str], slice_rows: int | None) -> DataFrame:
    """Blocks that fall within each slice, made to fall along each key.

    A block list is associative: two neighbouring lists that fall merge into one by pooling a
    stretch around their border, and all other blocks stay. Neighbours are paired in rounds, as
    many as the logarithm of the slices. A round reads the lowest level of every left list and the
    highest of its right neighbour, and only blocks that lie between the two move. The blocks
    themselves are never written again; of each slice the round keeps the ends of what
    is still its own, and the pooled blocks, at most one for each border.
    """
    keys = list(keys)
    first = slices = _spanning(blocks, keys)
    most = slices.agg(F.max("rank")).first()[0]
    shape = [*keys, "lo", "hi", "m", "w"]
    if most is None:
        return blocks.select(*shape)
    # Fewer rows than twice the partitions, so they may go to all tasks.
    names = F.broadcast(slices.select(*keys, "__slice"))
    own = _keyed(blocks, names, [*keys, "__slice"], "left_semi")
    alone = _keyed(blocks, names, [*keys, "__slice"], "left_anti").select(*shape)
    pooled = own.select(*shape, F.lit(0).alias("rank")).limit(0)

    def living(slices: DataFrame) -> DataFrame:
        here = _keyed(own, F.broadcast(slices), [*keys, "__slice"])
        return here.where((F.col("left").isNull() | (F.col("lo") > F.col("left"))) & (F.col("right").isNull() | (F.col("hi") < F.col("right"))))

    for turn in range(1, int(most).bit_length() + 1):
        pair = F.shiftright("rank", turn).alias("pair")
        side = F.shiftright("rank", turn - 1).bitwiseAND(1).alias("side")
        live = living(slices).select(*shape, "rank").unionByName(pooled)
        live = live.select(*shape, "rank", pair, side, (F.col("m") / F.col("w")).alias("mean"))
        ends = live.groupBy(*keys, "pair").agg(
            F.min(F.when(F.col("side") == 0, F.col("mean"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("mean"))).alias("high"))
        clash = cut_lineage(ends.where("low < high"))
        if clash.isEmpty():
            continue
        cand = _keyed(live, F.broadcast(clash), [*keys, "pair"]).where("(side = 0 and mean < high) or (side = 1 and mean > low)")
        cand = cut_lineage(cand.drop("low", "high"))
        levels = F.broadcast(cut_lineage(_bridge(cand, [*keys, "pair"], slice_rows)))
        taken = _keyed(cand, levels, [*keys, "pair"]).where("(side = 0 and mean < level) or (side = 1 and mean > level)")
        fresh = cut_lineage(taken.groupBy(*keys, "pair").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.min("rank").alias("rank")))
        swallowed = fresh.select(*keys, "pair", F.col("lo").alias("_from"), F.col("hi").alias("_to"))
        kept = _keyed(pooled.withColumn("pair", pair), F.broadcast(swallowed), [*keys, "pair"], "left")
        kept = kept.where("_from is null or hi < _from or lo > _to").select(*shape, "rank")
        old, pooled = pooled, cut_lineage(kept.unionByName(fresh.select(*shape, "rank")))
        moved = _keyed(slices.withColumn("pair", pair).withColumn("side", side), F.broadcast(swallowed), [*keys, "pair"], "left")
        before, slices = slices, cut_lineage(moved.select(
            *keys, "__slice", "rank",
            F.when(F.col("side") == 1, F.greatest("left", "_to")).otherwise(F.col("left")).alias("left"),
            F.when(F.col("side") == 0, F.least("right", "_from")).otherwise(F.col("right")).alias("right")))
        release(old, *([] if before is first else [before]))
    return alone.unionByName(living(slices).select(*shape)).unionByName(pooled.select(*shape))


def antitonic(points: DataFrame, keys: Sequence[str], slice_rows: int | None = None) -> DataFrame:
    """Closest non-increasing curve to pooled points (x, y, w), in weighted least squares.

    A series is pooled within slices of its order, in parallel; the block lists of the
    slices are then merged (``_merged``), which gives the same fit as pooling the rows.
    """
    keys = list(keys)
    rows = points.select(*keys, F.col("x").alias("lo"), F.col("x").alias("hi"), "y", "w")
    cut = sliced(rows, keys, ["lo"], slice_rows).select(*rows.columns, "__slice")
    kinds = {f.name: f.dataType for f in cut.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in [*keys, "__slice"]])
    for name in ("lo", "hi", "m", "w"):
        schema = schema.add(name, "double")

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _antitonic(pdf.sort_values("lo", kind="stable"))
        for place, k in enumerate([*keys, "__slice"]):
            out.insert(place, k, pdf[k].iloc[0])
        return out

    blocks = cut_lineage(cut.groupBy(*keys, "__slice").applyInPandas(pool, schema))
    blocks = _merged(blocks, keys, slice_rows).select(*keys, "lo", (F.col("m") / F.col("w")).alias("y"))
    # Every bar inside a block carries the block's level.
    marks = blocks.select(*keys, F.col("lo").alias("x"), F.lit(0).alias("_kind"), F.col("y").alias("_y"))
    asked = points.select(*keys, "x", F.lit(1).alias("_kind"), "w")
    mixed = marks.unionByName(asked, allowMissingColumns=True)
    read = carried(mixed, keys, ["x", "_kind"], last={"y": "_y"}, slice_rows=slice_rows).where("_kind = 1")
    return read.select(*keys, "x", "y", "w")


def knots(curve: DataFrame, keys: Sequence[str], count: int = KNOTS, **options) -> DataFrame:
    """Thin a curve (x, y, w) to points of equal carried weight; the first stays.

    A point is kept where the running weight first reaches one of the evenly
    spaced targets; short curves are kept whole.
    """
    walked = running(curve, keys, ["x"], {"_reach": "w"}, totals={"_total": "w", "_n": F.lit(1)}, **options)
    before = F.col("_reach") - F.col("w")
    targets = F.array(*[F.lit(j / (count - 1)) for j in range(1, count)])
    # The last target is the whole weight itself, so compare it exactly.
    hit = F.exists(targets, lambda t: (t * F.col("_total") > before) & (
        (t * F.col("_total") <= F.col("_reach")) | ((t >= 1.0) & (F.col("_reach") >= F.col("_total")))))
    first = before <= 0
    return walked.where((F.col("_n") <= count) | first | hit).select(*keys, "x", "y", "w")


def smooth(points: DataFrame, keys: Sequence[str], bar: str, level: str, weight: str, count: int = KNOTS,
           slice_rows: int | None = None) -> DataFrame:
    """Rising monotone cubic per key, as a knot table over x = 1 - bar."""
    return smoothed(pooled(points, keys, bar, level, weight), keys, count, slice_rows)


def smoothed(pools: DataFrame, keys: Sequence[str], count: int = KNOTS, slice_rows: int | None = None) -> DataFrame:
    """Rising monotone cubic per key of points that are pooled already (x, y, w)."""
    fitted = antitonic(pools, keys, slice_rows)
    rising = fitted.withColumn("x", 1.0 - F.col("x"))
    return interp.pchip_slopes(knots(rising, keys, count), keys, "x", "y")


def read_bars(rows: DataFrame, curves: DataFrame, keys: Sequence[str], bar: str, out: str = "level") -> DataFrame:
    """Level of each bar on its own scale's curve, held inside [0, 1]."""
    return interp.read_curve(rows, curves, keys, 1.0 - F.col(bar), out)


def place(rows: DataFrame, totals: DataFrame | None, *, year: str, group: str, subgroup: str, route: str, scale: str,
          level: str, weight: str, reserved=None, renamed=None) -> DataFrame:
    """Rows with their own level, else their subgroup's or group's mean, weights scaled to totals."""
    live = rows.where(F.col(level).isNotNull())
    # Group means come from the subgroup sums, so rows are aggregated once.
    subs = live.groupBy(year, group, subgroup).agg(
        F.sum(F.col(level) * F.col(weight)).alias("_m"), F.sum(weight).alias("_w")
    )
    groups = subs.groupBy(year, group).agg((F.sum("_m") / F.sum("_w")).alias("_group"))
    subs = subs.select(year, group, subgroup, (F.col("_m") / F.col("_w")).alias("_sub"))
    out = rows.join(subs, [year, group, subgroup], "left").join(groups, [year, group], "left")
    out = out.withColumn("score", F.coalesce(level, "_sub", "_group")).drop("_sub", "_group")
    out = out.where(F.col(scale).isNotNull() & F.col("score").isNotNull())
    if totals is None:
        return out.withColumn("placed_weight", F.col(weight).cast("double"))
    held = out.groupBy(year, route).agg(F.sum(weight).cast("double").alias("_held"))
    factor = route_factors(held, totals, [year], route, "_held", "total", reserved, renamed)
    return looked_up(out, factor.select(year, route, "factor"), [year, route], "left").withColumn(
        "placed_weight", F.col(weight) * F.coalesce("factor", F.lit(1.0))
    ).drop("factor")


def gathered(rows: DataFrame, year: str, group: str, subgroup: str, route: str, scale: str, bar: str, weight: str,
             unique: str) -> tuple[DataFrame, DataFrame]:
    """(cells, plain rows): rows whose subgroup is never asked for its mean become sums over their bar.

    A subgroup's mean is read only by its rows without a bar. Rows of all other subgroups are summed by
    year, group, route, scale and bar, with the sum of their squares in ``_squares`` and no subgroup or
    unique column; that leaves the group's means as they are. The rest stay as they are, as do
    years in which some weight is not positive (``_odd``). The plain rows are those that were summed.
    """
    axes = [year, group, route, scale, bar]
    held = rows.select(year, group, subgroup, route, scale, bar, F.col(weight).cast("double").alias(weight), unique)
    good = F.coalesce(F.col(weight) > 0, F.lit(False))
    years = F.broadcast(held.groupBy(year).agg((~F.min(good)).alias("_odd")))
    held = cut_lineage(_keyed(held, years, [year]))
    asked = held.where(F.col("_odd") | F.col(bar).isNull() | F.col(scale).isNull()).select(year, group, subgroup).distinct()
    asked = cut_lineage(asked)
    alone = _keyed(held, asked, [year, group, subgroup], "left_semi")
    plain = cut_lineage(_keyed(held, asked, [year, group, subgroup], "left_anti").select(*axes, weight, unique))
    sums = plain.groupBy(*axes).agg(F.sum(F.col(weight) * F.col(weight)).alias("_squares"), F.sum(weight).alias(weight))
    cells = alone.withColumn("_squares", F.col(weight) * F.col(weight)).withColumn("_summed", F.lit(False)).unionByName(
        sums.withColumn("_summed", F.lit(True)).withColumn("_odd", F.lit(False)), allowMissingColumns=True)
    return cut_lineage(cells), plain


def tiled_points(placed: DataFrame, plain: DataFrame, population: DataFrame | None, *, year: str, group: str, route: str,
                 scale: str, bar: str, weight: str, unique: str) -> DataFrame:
    """Pooled tiled levels (x, y, w) of placed cells and the rows they were summed from (:func:`gathered`).

    Rows of one bar share their score and follow each other, and the mean of their levels does not
    depend on their order: with weight w above a bar's rows, sum s and sum of squares q it is
    1 - (w + (s + q / s) / 2) / population. Only where rows of other bars, or without one, have the
    same score does the unique column decide; those rows are fetched and walked.
    """
    axes = [year, scale]
    factor = F.when(F.col(weight) != 0, F.col("placed_weight") / F.col(weight)).otherwise(0.0)
    placed = cut_lineage(placed.withColumn("_factor", factor))
    classes = cut_lineage(placed.groupBy(*axes, F.col(bar).alias("x"), "score").agg(
        F.sum("placed_weight").alias("w"), F.sum(F.col("_squares") * F.col("_factor") * F.col("_factor")).alias("_q"), F.max("_odd").alias("_odd")))
    scores = classes.groupBy(year, "score").agg(
        F.sum("w").alias("_here"), ((F.max("_odd") | (F.count(F.lit(1)) > 1)) & (F.count("x") > 0)).alias("_tied"))
    scores = running(scores, [year], [-F.col("score")], {"_above": "_here"}, before=True, totals={"_size": "_here"})
    if population is not None:
        scores = scores.join(population, [year], "left").withColumn("_size", F.coalesce("population", "_size")).drop("population")
    scores = cut_lineage(scores.drop("_here"))
    own = _keyed(classes.where(F.col("x").isNotNull()), scores.where(~F.col("_tied")), [year, "score"])
    mean = 1.0 - (F.col("_above") + (F.col("w") + F.col("_q") / F.col("w")) / 2) / F.col("_size")
    parts = own.select(*axes, "x", mean.alias("y"), "w")
    tied = scores.where("_tied").drop("_tied")
    if not tied.isEmpty():
        meet = _keyed(placed, tied, [year, "score"])
        walk = [*axes, F.col(bar).alias("x"), unique, "score", "placed_weight", "_above", "_size"]
        sums = meet.where("_summed").select(year, group, route, scale, bar, "score", "_factor", "_above", "_size")
        rows = _keyed(plain, sums, [year, group, route, scale, bar]).withColumn("placed_weight", F.col(weight) * F.col("_factor"))
        walked = meet.where(~F.col("_summed")).select(*walk).unionByName(rows.select(*walk))
        walked = running(walked, [year, "score"], [unique], {"_passed": "placed_weight"}).where(F.col("x").isNotNull())
        walked = walked.withColumn("_tiled", 1.0 - (F.col("_above") + F.col("_passed")) / F.col("_size"))
        parts = parts.unionByName(pooled(walked, axes, "x", "_tiled", "placed_weight"))
    return parts.groupBy(*axes, "x").agg(weighted_mean("y", "w").alias("y"), F.sum("w").alias("w"))


def fixed_point(rows: DataFrame, totals: DataFrame | None, population: DataFrame | None, *, year: str = "year",
                group: str = "grp", subgroup: str = "sub", route: str = "route", scale: str = "scale",
                bar: str = "top", weight: str = "weight", unique: str = "id", count: int = KNOTS,
                rounds: int = ROUNDS, tolerance: float = TOLERANCE, **place_options) -> tuple[DataFrame, DataFrame, int]:
    """Alternate placing and curve reading until levels stop moving, year by year.

    Returns the knot table of the last placement, rows with their final level,
    and the rounds run. A level follows from its bar and its year's knots, so movement is
    measured on the table of different bars, which carries each bar's level from round to
    round, and rows that differ only in what no round reads are summed once (:func:`gathered`).
    A year is settled once none of its bars moves by the tolerance; its cells are
    not read again until the last placement.
    """
    columns = dict(year=year, group=group, subgroup=subgroup, route=route, scale=scale, weight=weight)
    axes = [year, scale]
    held = cut_lineage(rows)
    cells, plain = gathered(held, **columns, bar=bar, unique=unique)
    if totals is not None:
        totals = cut_lineage(totals)
    if population is not None:
        population = cut_lineage(population)
    bars = cut_lineage(cells.where(F.col(bar).isNotNull()).select(*axes, bar).distinct().withColumn("_level", 1.0 - F.col(bar)))

    def curves_of(levelled: DataFrame) -> DataFrame:
        placed = place(levelled, totals, level="_level", **columns, **place_options)
        points = tiled_points(placed, plain, population, year=year, group=group, route=route, scale=scale, bar=bar, weight=weight, unique=unique)
        return cut_lineage(smoothed(cut_lineage(points), axes, count))

    levelled = cells.withColumn("_level", 1.0 - F.col(bar))
    settled: list[DataFrame] = []
    done = 0
    for done in range(1, rounds + 1):
        curves = curves_of(levelled)
        was = bars.withColumnRenamed("_level", "_was")
        bars = cut_lineage(read_bars(was, curves, axes, bar, "_level"))
        moving = bars.groupBy(year).agg(F.max(F.abs(F.col("_level") - F.col("_was"))).alias("_moved"))
        moving = cut_lineage(moving.where(F.col("_moved") >= tolerance).select(year))
        last = done == rounds or moving.isEmpty()
        settled.append(curves if last else _keyed(curves, moving, [year], "left_anti"))
        if last:
            break
        open_ = _keyed(cells, moving, [year], "left_semi")
        bars = _keyed(bars, moving, [year], "left_semi").drop("_was")
        levelled = cut_lineage(read_bars(open_, curves, axes, bar, "_level"))
    final = settled[0]
    for more in settled[1:]:
        final = final.unionByName(more)
    final = cut_lineage(final)
    levels = read_bars(held, final, axes, bar, "_level").withColumnRenamed("_level", "level")
    return curves_of(read_bars(cells, final, axes, bar, "_level")), levels, done


def carried_curve(placed: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], scale: str,
                  scales: Sequence[str], weight: str, count: int = KNOTS, **options) -> DataFrame:
    """Weight of each scale below evenly spaced places, counted from the bottom.

    One walk carries every scale's weight at once; the staircase is then read by
    the single row that covers each place.
    """
    keys = list(keys)
    sums = {"_all": F.col(weight)} | {f"_c{i}": F.when(F.col(scale) == s, F.col(weight)).otherwise(0.0)
                                      for i, s in enumerate(scales)}
    walked = running(placed, keys, [F.col(score), *[F.col(t) for t in tie]], sums, totals={"_total": weight}, **options)
    lo, hi = F.col("_all") - F.col(weight), F.col("_all")
    picks = F.array(*[F.lit(j / (count - 1)) for j in range(count)])
    inside = lambda p: ((p * F.col("_total") > lo) | ((p == 0.0) & (lo <= 0.0))) & (
        (p * F.col("_total") <= hi) | ((p >= 1.0) & (hi >= F.col("_total"))))
    covered = walked.where(F.col(weight) > 0).select("*", F.explode(F.filter(picks, inside)).alias("x"))
    left = F.greatest(F.lit(0.0), F.col("_all") - F.col("x") * F.col("_total"))
    parts = [F.struct(F.lit(s).alias("scale"),
                      (F.col(f"_c{i}") - F.when(F.col(scale) == s, left).otherwise(0.0)).alias("y"))
             for i, s in enumerate(scales)]
    curve = covered.select(*keys, "x", F.explode(F.array(*parts)).alias("_p")).select(*keys, "x", "_p.*")
    return curve.groupBy(*keys, "scale", "x").agg(F.max("y").alias("y"))


def seat_mix(curve: DataFrame, keys: Sequence[str], grid: int = 400) -> DataFrame:
    """Which scale fills the pool at each level, from the slopes of its smooth carried curves."""
    keys = list(keys)
    curves = interp.curve_table(interp.pchip_slopes(curve, [*keys, "scale"], "x", "y"), [*keys, "scale"])
    axis = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    rates = curves.select(*keys, "scale", "knots", axis.alias("step")).withColumn("at", F.col("step") / (grid - 1))
    rates = rates.withColumn("rate", interp.curve_value(F.col("knots"), F.col("at"), derivative=True)).drop("knots")
    whole = rates.groupBy(*keys, "step").agg(F.sum("rate").alias("_sum"))
    return rates.join(whole, [*keys, "step"]).withColumn("share", F.col("rate") / F.col("_sum")).drop("_sum")


def level_of(values: DataFrame, hist: DataFrame, curves: DataFrame, keys: Sequence[str], value: str,
             hist_value: str) -> DataFrame:
    """One value's share beaten and its level on the curve; both null without a histogram."""
    from .hist import top_share

    read = top_share(values, hist, keys, value, hist_value).withColumn("beaten", 1.0 - F.col("top"))
    return interp.read_curve(read, curves, keys, F.col("beaten"), "level")


def fixed_targets(curves: DataFrame, keys: Sequence[str], targets: Sequence[float]) -> DataFrame:
    """Levels of a few fixed bars on every curve."""
    table = interp.curve_table(curves, keys)
    rows = table.select(*keys, "knots", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    value = interp.curve_value(F.col("knots"), 1.0 - F.col("target"))
    return rows.select(*keys, "target", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("level"))

