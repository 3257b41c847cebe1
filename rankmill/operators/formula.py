"""Weighted formulas over several histograms: parsing, inversion and discrete totals.

The tables of bends and steps are one row per distinct formula and histogram
value. They are small next to the rows read through them and are used several
times, so they are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import hist as histograms
from . import interp
from .intervals import merge_equal, overlay
from .ordered import carried, running


def parts(text: Column) -> Column:
    """``"AxW BxW"`` as an array of (subject, weight); null where a token does not read."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    # The weight follows the last x, as a subject may hold one itself.
    read = F.transform(tokens, lambda t: F.struct(
        F.regexp_extract(t, r"^(.*)x([^x]*)$", 1).alias("subject"),
        F.regexp_extract(t, r"^(.*)x([^x]*)$", 2).try_cast("double").alias("weight")))
    good = (F.size(read) > 0) & F.forall(read, lambda p: (p["subject"] != "") & p["weight"].isNotNull())
    return F.when(good, read)


def largest_score(text: Column, maxima: Mapping[str, float], default: Column) -> Column:
    """Highest reachable total: sum of weight times each subject's maximum."""
    known = F.create_map(*[F.lit(x) for pair in maxima.items() for x in pair]) if maxima else None
    top = (lambda s: F.coalesce(F.element_at(known, s), default)) if maxima else (lambda s: default)
    return F.aggregate(parts(text), F.lit(0.0), lambda acc, p: acc + p["weight"] * top(p["subject"]))


def gates(text: Column, levels: str) -> Column:
    """``"NAMElevelN ..."`` bars as an array of (subject, level); ``levels`` lists the words between."""
    pattern = rf"(\S+?)(?:{levels})(\d+)"
    subject = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    level = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(subject, level, lambda s, n: F.struct(s.alias("subject"), n.cast("double").alias("level")))


def binding_gates(rows: DataFrame, hist: DataFrame, keys: Sequence[str], unique: str, text: str, levels: str,
                  value: str = "score", not_binding: float = 0.95, resolve=None) -> DataFrame:
    """Gates a histogram can read and that not nearly everyone clears, one row each."""
    listed = rows.select(unique, *keys, F.explode(gates(F.col(text), levels)).alias("g"))
    subject = F.col("g.subject") if resolve is None else resolve(F.col("g.subject"))
    asked = listed.select(unique, *keys, subject.alias("subject"), F.col("g.level").alias("level"))
    asked = asked.where(F.col("subject").isNotNull())
    read = histograms.top_share(asked, hist, [*keys, "subject"], "level", value)
    return read.where(F.col("top").isNotNull() & (F.col("top") < not_binding))


def strictest(rows: DataFrame, binding: DataFrame, unique: str) -> DataFrame:
    """1 - the smallest binding share, 0 for a row without one."""
    least = binding.groupBy(unique).agg(F.min("top").alias("_top"))
    return rows.join(least, unique, "left").withColumn(
        "strictest", F.coalesce(1.0 - F.col("_top"), F.lit(0.0))).drop("_top")


def formula_parts(rows: DataFrame, hist: DataFrame, keys: Sequence[str], text: str, resolve=None) -> DataFrame:
    """Distinct (keys, formula) exploded to parts, only where every part has a histogram.

    Formulas repeat over many rows; each distinct one is worked out once.
    """
    keys = list(keys)
    distinct = rows.select(*keys, F.col(text).alias("formula")).distinct()
    listed = distinct.select(*keys, "formula", F.size(parts(F.col("formula"))).alias("_size"),
                             F.posexplode(parts(F.col("formula"))).alias("part", "p"))
    subject = F.col("p.subject") if resolve is None else resolve(F.col("p.subject"))
    listed = listed.select(*keys, "formula", "_size", "part", subject.alias("subject"), F.col("p.weight").alias("weight"))
    known = hist.select(*keys, "subject").distinct()
    found = listed.join(known, [*keys, "subject"], "left_semi")
    whole = found.groupBy(*keys, "formula").agg(F.count("*").alias("_n"), F.max("_size").alias("_s")).where("_n = _s")
    return found.join(whole.select(*keys, "formula"), [*keys, "formula"], "left_semi").drop("_size")


def totals_curve(rows: DataFrame, hist: DataFrame, keys: Sequence[str], text: str, value: str = "score",
                 resolve=None) -> DataFrame:
    """Each formula's total at every percentile where one of its parts bends, 0 and 1 included."""
    keys = list(keys)
    mids = cut_lineage(histograms.midranks(hist, [*keys, "subject"], value))
    listed = cut_lineage(formula_parts(rows, hist, keys, text, resolve))
    bends = listed.join(mids.select(*keys, "subject", "midrank"), [*keys, "subject"]).select(*keys, "formula", F.col("midrank").alias("p"))
    ends = listed.select(*keys, "formula", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("p"))
    grid = bends.union(ends).distinct()
    probes = cut_lineage(grid.join(listed, [*keys, "formula"]))
    read = interp.asof_interpolate(probes, mids, [*keys, "subject"], "p", knot_x="midrank", knot_y=value, out="q")
    # Rounded, so that a flat stretch stays one tie whatever order its parts were added in.
    total = F.round(F.sum(F.col("weight") * F.col("q")), 10)
    return read.groupBy(*keys, "formula", "p").agg(total.alias("total"))


def invert(rows: DataFrame, hist: DataFrame, keys: Sequence[str], text: str, cutoff: str, value: str = "score",
           out: str = "percentile", resolve=None) -> DataFrame:
    """Shared percentile at which a formula's quantiles add up to the row's cutoff.

    Totals are piecewise linear between bends, so the answer is exact. Off the
    curve it is held at 0 or 1; null where a part has no histogram.
    """
    keys = list(keys)
    curve = cut_lineage(totals_curve(rows, hist, keys, text, value, resolve))
    asked = rows.withColumn("formula", F.col(text))
    read = interp.asof_interpolate(asked, curve, [*keys, "formula"], cutoff, knot_x="total", knot_y="p", out=out)
    return read.drop("formula")


def composite_buckets(rows: DataFrame, hist: DataFrame, keys: Sequence[str], text: str, value: str = "score",
                      resolve=None) -> DataFrame:
    """Discrete totals of each formula under equal quantiles, tied neighbours merged."""
    keys = list(keys)
    listed = formula_parts(rows, hist, keys, text, resolve)
    held = histograms.intervals(hist, [*keys, "subject"], value)
    steps = listed.join(held, [*keys, "subject"]).select(
        *keys, "formula", "part", "lo", "hi", (F.col("weight") * F.col(value)).alias("y"))
    flat = overlay(cut_lineage(steps), [*keys, "formula"], "part", "lo", "hi", "y")
    flat = cut_lineage(flat.withColumn("total", F.round("total", 10)))
    merged = merge_equal(flat, [*keys, "formula"], "lo", "hi", "total")
    return merged.withColumn("share", F.col("hi") - F.col("lo"))


def quantile_map(rows: DataFrame, keys: Sequence[str], raw: str, supported: str, weight: str, out: str = "basis") -> DataFrame:
    """Put rows without a supported value on that scale, by their weighted place in the raw one.

    A key without any supported row is left null.
    """
    known = rows.where(F.col(supported).isNotNull())
    place = histograms.midranks(histograms.histogram(known, keys, raw, F.col(weight)), keys, raw)
    scale = histograms.midranks(histograms.histogram(known, keys, supported, F.col(weight)), keys, supported)
    missing = rows.where(F.col(supported).isNull())
    placed = interp.asof_interpolate(missing, place, keys, raw, knot_x=raw, knot_y="midrank", out="_place")
    read = interp.asof_interpolate(placed, scale, keys, "_place", knot_x="midrank", knot_y=supported, out=out)
    read = read.drop("_place").withColumn("fallback", F.col(out).isNotNull())
    return known.withColumn(out, F.col(supported)).withColumn("fallback", F.lit(False)).unionByName(read)


def allocation_index(buckets: DataFrame, keys: Sequence[str], value: str = "total", capacity: str = "candidates") -> DataFrame:
    """Buckets numbered by value (``_place``) with their key's capacity up to and with them (``_upto``); written once."""
    return cut_lineage(running(buckets, keys, [value], {"_upto": F.col(capacity).cast("double"), "_place": F.lit(1).cast("bigint")}))


def stabbed(demands: DataFrame, index: DataFrame, keys: Sequence[str], cutoff: str, wanted: str, value: str = "total") -> DataFrame:
    """Demands with the stretch of capacity they take: ``_from``, ``_to``, and its first and last bucket, ``_first``, ``_last``.

    A demand starts at what lies below its cutoff and ends its wanted amount later; two as-of
    reads find the buckets of both ends. Demands that are not positive or that the buckets
    cannot fill are left out.
    """
    keys = list(keys)
    known = F.struct(F.col("_upto").alias("upto"), F.col("_place").alias("place"))
    asked = demands.where(F.col(wanted) > 0).select(*keys, F.struct(*demands.columns).alias("_row"), F.lit(0).alias("_kind"),
                                                     F.col(cutoff).cast("double").alias("_x"), F.col(wanted).cast("double").alias("_want"))
    asked = asked.withColumn("_tie", F.xxhash64("_row"))
    steps = index.select(*keys, F.lit(1).alias("_kind"), F.col(value).cast("double").alias("_x"), known.alias("_step"))
    # A demand stands before the bucket of its own value, so what precedes it lies below the cutoff.
    start = carried(asked.unionByName(steps, allowMissingColumns=True), keys, ["_x", "_kind", "_tie"], previous={"_below": "_step"}).where("_kind = 0")
    origin = F.coalesce(F.col("_below")["upto"], F.lit(0.0))
    start = start.select(*keys, "_row", "_kind", "_tie", origin.alias("_from"), (origin + F.col("_want")).alias("_x"),
                         (F.coalesce(F.col("_below")["place"], F.lit(0)) + 1).alias("_first"))
    ends = index.select(*keys, F.lit(1).alias("_kind"), F.col("_upto").alias("_x"), known.alias("_step"))
    done = carried(start.unionByName(ends, allowMissingColumns=True), keys, ["_x", "_kind", "_tie"], following={"_end": "_step"}).where("_kind = 0")
    done = done.where("_end is not null")
    return done.select("_row.*", "_from", F.col("_x").alias("_to"), "_first", F.col("_end")["place"].alias("_last"))


def allocation_pieces(buckets: DataFrame, rows: DataFrame, curves: DataFrame, bucket_keys: Sequence[str],
                      curve_keys: Sequence[str], unique: str, cutoff: str, wanted: str, basis: str) -> DataFrame:
    """Score intervals a row's weight is spread over, from its cutoff up.

    Buckets carry (lo, hi, total, candidates); both ends are read through the
    row's curve. A row its buckets cannot fill yields nothing. Capacities are summed once for
    each key, and a row meets only the buckets it takes from.
    """
    bucket_keys = list(bucket_keys)
    demand = rows.select(unique, *bucket_keys, *[k for k in curve_keys if k not in bucket_keys], cutoff, wanted)
    index = allocation_index(buckets, bucket_keys)
    held = stabbed(demand, index, bucket_keys, cutoff, wanted)
    each = held.withColumn("_place", F.explode(F.sequence("_first", "_last")))
    met = each.join(index.select(*bucket_keys, "_place", "lo", "hi", "candidates", "_upto"), [*bucket_keys, "_place"])
    taken = F.least("_upto", "_to") - F.greatest(F.col("_upto") - F.col("candidates"), "_from")
    met = met.withColumn("taken", F.least(taken, F.col("candidates"))).where("taken > 0")
    table = interp.curve_table(curves, curve_keys)
    ends = met.join(table, list(curve_keys))
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), interp.curve_value(F.col("knots"), F.col(x))))
    ends = ends.withColumn("_a", inside("lo")).withColumn("_b", inside("hi"))
    return ends.select(
        unique, *curve_keys,
        (100.0 * F.least("_a", "_b")).alias("ability_lower"), (100.0 * F.greatest("_a", "_b")).alias("ability_upper"),
        F.col("candidates").alias("bucket_candidates"), F.col("taken").alias("weight"), F.lit(basis).alias("bucket_basis"),
    )
