"""Interpolating as-of joins, monotone cubic curves and their inversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import looked_up
from .ordered import carried


def between(x: Column, low: Column, high: Column) -> Column:
    """Linear reading between two knots (structs x, y), held beyond the ends."""
    inner = low["y"] + (high["y"] - low["y"]) * (x - low["x"]) / (high["x"] - low["x"])
    return F.when(low.isNull(), high["y"]).when(high.isNull(), low["y"]).otherwise(inner)


def asof_interpolate(
    probes: DataFrame,
    knots: DataFrame,
    keys: Sequence[str],
    x: str,
    *,
    knot_x: str = "x",
    knot_y: str = "y",
    out: str = "value",
    hold: bool = True,
    **options,
) -> DataFrame:
    """Read every probe off its key's knots in one pass over their union.

    Below is the last knot at or before the probe, above the first knot past it.
    Among knots with the same x (a step of a rising curve) the largest y stands
    for what lies at or after it and the smallest for what lies before.
    ``hold=False`` gives null outside the knots instead of the end value.
    """
    knots = knots.where(F.col(knot_x).isNotNull() & F.col(knot_y).isNotNull())
    line = knots.groupBy(*keys, F.col(knot_x).cast("double").alias("_x")).agg(
        F.max(F.col(knot_y).cast("double")).alias("_top"), F.min(F.col(knot_y).cast("double")).alias("_foot")
    )
    line = line.select(
        *keys, "_x", F.struct(F.col("_x").alias("x"), F.col("_top").alias("y")).alias("_left"),
        F.struct(F.col("_x").alias("x"), F.col("_foot").alias("y")).alias("_right"),
        F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"),
    )
    asked = probes.select(
        *keys, F.col(x).cast("double").alias("_x"), F.struct(*probes.columns).alias("_row"),
        F.lit(1).alias("_kind"), F.xxhash64(*probes.columns).alias("_tie"),
    )
    mixed = line.unionByName(asked, allowMissingColumns=True)
    near = carried(
        mixed, keys, ["_x", "_kind", "_tie"], last={"_low": "_left"}, following={"_high": "_right"}, **options
    ).where("_kind = 1")
    value = between(F.col("_x"), F.col("_low"), F.col("_high"))
    if not hold:
        inside = F.col("_low").isNotNull() & (
            F.col("_high").isNotNull() | (F.col("_low")["x"] == F.col("_x"))
        )
        value = F.when(inside, value)
    return near.select("_row.*", value.alias(out))


def segments(knots: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Knots as consecutive segments (x0, y0, x1, y1). Knots per key are few by construction."""
    along = Window.partitionBy(*keys).orderBy(x)
    return knots.select(
        *keys,
        F.col(x).alias("x0"),
        F.col(y).alias("y0"),
        F.lead(x).over(along).alias("x1"),
        F.lead(y).over(along).alias("y1"),
    ).where(F.col("x1").isNotNull())


def pchip_slopes(knots: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Shape-preserving slopes (Fritsch-Carlson/Butland) for a small knot table.

    Interior slopes are weighted harmonic means of the neighbouring secants, zero
    at a turn; ends use the one-sided three-point rule, limited to keep the shape.
    """
    along = Window.partitionBy(*keys).orderBy(x)
    col = F.col
    step = knots.select(
        *keys, col(x).cast("double").alias("x"), col(y).cast("double").alias("y")
    )
    along = Window.partitionBy(*keys).orderBy("x")
    step = step.withColumn("h", F.lead("x").over(along) - col("x"))
    step = step.withColumn("d", (F.lead("y").over(along) - col("y")) / col("h"))
    step = step.select(
        "*",
        F.lag("h").over(along).alias("h0"), F.lag("d").over(along).alias("d0"),
        F.lead("h").over(along).alias("h2"), F.lead("d").over(along).alias("d2"),
        F.lag("h", 2).over(along).alias("h00"), F.lag("d", 2).over(along).alias("d00"),
    )
    w1, w2 = 2 * col("h") + col("h0"), col("h") + 2 * col("h0")
    inner = F.when(col("d0") * col("d") <= 0, F.lit(0.0)).otherwise(
        (w1 + w2) / (w1 / col("d0") + w2 / col("d"))
    )

    def end(h: Column, hn: Column, d: Column, dn: Column) -> Column:
        raw = ((2 * h + hn) * d - h * dn) / (h + hn)
        return (
            F.when(dn.isNull(), d)
            .when(F.signum(raw) != F.signum(d), F.lit(0.0))
            .when((F.signum(d) != F.signum(dn)) & (F.abs(raw) > 3 * F.abs(d)), 3 * d)
            .otherwise(raw)
        )

    slope = (
        F.when(col("d0").isNull() & col("d").isNull(), F.lit(0.0))
        .when(col("d0").isNull(), end(col("h"), col("h2"), col("d"), col("d2")))
        .when(col("d").isNull(), end(col("h0"), col("h00"), col("d0"), col("d00")))
        .otherwise(inner)
    )
    return step.select(*keys, "x", "y", slope.alias("slope"))


def hermite(x: Column, a: Column, b: Column) -> Column:
    """Cubic through knots a, b (structs x, y, slope) at x."""
    h = b["x"] - a["x"]
    t = (x - a["x"]) / h
    return (
        (1 + 2 * t) * (1 - t) * (1 - t) * a["y"]
        + t * (1 - t) * (1 - t) * h * a["slope"]
        + t * t * (3 - 2 * t) * b["y"]
        + t * t * (t - 1) * h * b["slope"]
    )


def hermite_slope(x: Column, a: Column, b: Column) -> Column:
    """Derivative of :func:`hermite` at x."""
    h = b["x"] - a["x"]
    t = (x - a["x"]) / h
    return (
        6 * t * (t - 1) * (a["y"] - b["y"]) / h
        + (1 - t) * (1 - 3 * t) * a["slope"]
        + t * (3 * t - 2) * b["slope"]
    )


def curve_table(slopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with its sorted knots; a curve is a handful of knots by design."""
    knots = F.array_sort(F.collect_list(F.struct("x", "y", "slope")))
    return slopes.groupBy(*keys).agg(knots.alias("knots"))


def curve_value(knots: Column, x: Column, derivative: bool = False) -> Column:
    """Evaluate a row's own curve; past the ends the last cubic piece goes on."""
    n = F.size(knots)
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(knots, lambda k: k["x"] <= x))))
    read = hermite_slope if derivative else hermite
    flat = F.lit(0.0) if derivative else F.element_at(knots, 1)["y"]
    # A one-element transform binds the two knots, so the search runs once per row.
    piece = F.array(F.struct(F.get(knots, i - 1).alias("a"), F.get(knots, i).alias("b")))
    value = F.get(F.transform(piece, lambda p: read(x, p["a"], p["b"])), F.lit(0))
    return F.when(n > 1, value).when(n == 1, flat)


def read_curve(rows: DataFrame, slopes: DataFrame, keys: Sequence[str], x: Column, out: str,
               clip: bool = True) -> DataFrame:
    """Read rows through their own key's curve, clipped to [0, 1] on request.

    The curve side is one short row per key. It is written and measured: within the bounds of
    :func:`looked_up` it goes to every task, else the rows of a hot key are spread.
    """
    table = curve_table(slopes, keys)
    value = curve_value(F.col("knots"), x)
    if clip:
        # least and greatest pass over nulls, and a row without x has no level.
        value = F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    return looked_up(rows, table, keys, "left").withColumn(out, value).drop("knots")


def invert(probes: DataFrame, knots: DataFrame, keys: Sequence[str], y: str, **options) -> DataFrame:
    """Find the x at which a rising curve takes the probe's y; null off the curve."""
    return asof_interpolate(probes, knots, keys, y, knot_x="y", knot_y="x", hold=False, **options)


def crosswalk(probes: DataFrame, source: DataFrame, target: DataFrame, keys: Sequence[str], x: str,
              out: str = "value") -> DataFrame:
    """Carry a reading on one curve to the x of another at the same level."""
    level = asof_interpolate(probes, source, keys, x, out="_level", hold=False)
    return invert(level, target, keys, "_level", out=out).drop("_level")


def fill_series(df: DataFrame, keys: Sequence[str], x: str, value: str, method: str) -> DataFrame:
    """Fill nulls inside each short series and say how.

    Between two reported points the value is linear (``interpolated:a,b``);
    outside them the nearest point stands (``nearest:a``). Series here are the
    years of one entity, so the window is bounded by the calendar.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(x).alias("x"), F.col(value).alias("y")))
    near = carried(df, keys, [x], last={"_lo": known}, following={"_hi": known}, bounded=True)
    lo, hi, at = F.col("_lo"), F.col("_hi"), F.col(x)
    text = F.when(
        lo.isNotNull() & hi.isNotNull(),
        F.concat(F.lit("interpolated:"), lo["x"].cast("string"), F.lit(","), hi["x"].cast("string")),
    ).when(
        lo.isNotNull() | hi.isNotNull(),
        F.concat(F.lit("nearest:"), F.coalesce(lo["x"], hi["x"]).cast("string")),
    )
    filled = between(at, lo, hi)
    gap = F.col(value).isNull() & filled.isNotNull()
    return near.withColumn(method, F.when(gap, text).otherwise(F.col(method))).withColumn(
        value, F.when(gap, filled).otherwise(F.col(value))
    ).drop("_lo", "_hi")
