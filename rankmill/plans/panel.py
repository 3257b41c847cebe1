"""An annual panel of (group, subgroup) x route x year cells, completed with provenance.

Inputs are frames with the columns ``grp, sub, year, route, weight`` and, where
named, ``score, label, source``. Stages run in the order of :func:`build`; every
estimate keeps a method text that later stages append to. A cell is null where
nothing is known and zero only where its source is complete.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.allocate import deduct_by_priority
from ..operators.interp import fill_series
from ..operators.lookup import looked_up
from ..operators.ordered import carried, numbered
from ..operators.rollup import active_years, weighted_mean
from ..session import cut_lineage

ENTITY = ["grp", "sub"]
CELL = [*ENTITY, "year", "route"]

# Method texts and the order of the fallback levels.
OBSERVED = "observed"
QUOTA = "moe_quota"
RETURNED = "uac_post_return"
RETURN_TAG = "-uac_return_estimate"
STRUCTURAL_ZERO = "structural_zero"
SCALED_TAG = "+national_scale"
FALLBACK_LEVELS = (
    ("department_year", ("grp", "sub", "year")),
    ("department", ("grp", "sub")),
    ("school_route_year", ("grp", "route", "year")),
    ("school_year", ("grp", "year")),
    ("school_route", ("grp", "route")),
    ("school", ("grp",)),
    ("route_year", ("route", "year")),
    ("year", ("year",)),
    ("national", ()),
)


@dataclass(frozen=True)
class PanelRules:
    """What a panel knows about its routes."""

    quota_routes: Sequence[str] = ()
    sibling: tuple[str, str] | None = None
    capacity_route: str = ""
    return_order: Sequence[str] = ()
    complete_years: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    total_names: Mapping[str, str] = field(default_factory=dict)
    uncalibrated: Sequence[str] = ()


def observed_cells(scored: DataFrame, seats: DataFrame) -> DataFrame:
    """All held weight joined to the part of it that carries a score."""
    held = seats.groupBy(*CELL).agg(F.sum("weight").alias("_sw"), F.count("*").alias("_sn"))
    read = scored.groupBy(*CELL).agg(
        weighted_mean("score", "weight").alias("ability"),
        F.sum("weight").alias("_aw"),
        F.count("*").alias("_an"),
    )
    both = held.join(read, CELL, "full_outer")
    return both.select(
        *CELL,
        F.coalesce("_sw", "_aw").cast("double").alias("weight"),
        "ability",
        F.lit(OBSERVED).alias("weight_method"),
        F.when(F.col("ability").isNotNull(), OBSERVED).otherwise("").alias("ability_method"),
        F.coalesce("_sn", "_an").alias("input_rows"),
    )


def quota_cells(cells: DataFrame, quotas: DataFrame, rules: PanelRules) -> DataFrame:
    """Published counts by route, re-routed to a sibling where that one is the latest active.

    A zero counts only for a route the entity is known to use. Where the parent
    route is published, its sibling reads zero.
    """
    sums = quotas.groupBy(*ENTITY, "year").agg(
        *[F.sum(F.coalesce(F.col(f"`{r}`"), F.lit(0.0))).cast("double").alias(r) for r in rules.quota_routes]
    )
    long = sums.unpivot([*ENTITY, "year"], [f"`{r}`" for r in rules.quota_routes], "source_route", "quota")
    live = F.col("weight") > 0
    parent, child = rules.sibling or ("", "")
    # The set of routes is the route vocabulary, so the array is short.
    history = cells.groupBy(*ENTITY).agg(
        F.collect_set("route").alias("_routes"),
        F.max(F.when(live & (F.col("route") == parent), F.col("year"))).alias("_parent"),
        F.max(F.when(live & (F.col("route") == child), F.col("year"))).alias("_child"),
    )
    rows = long.join(history, ENTITY, "left").withColumn(
        "_routes", F.coalesce("_routes", F.array().cast("array<string>"))
    )
    moved = (F.col("source_route") == parent) & (F.col("_child") > F.coalesce("_parent", F.lit(-1)))
    rows = rows.withColumn("route", F.when(moved, child).otherwise(F.col("source_route")))
    so_far = Window.partitionBy(*ENTITY, "route").orderBy("year")  # at most one row per year
    known = F.array_contains("_routes", F.col("route")) | F.max(F.col("quota") > 0).over(so_far)
    kept = rows.withColumn("_known", known).where("_known")
    other = F.when(F.col("route") == parent, child).otherwise(parent)
    closed = kept.where(F.col("source_route") == parent).withColumn("_other", other).where(
        F.array_contains("_routes", F.col("_other"))
    )
    return kept.select(*CELL, "quota").unionByName(
        closed.select(*ENTITY, "year", F.col("_other").alias("route"), F.lit(0.0).alias("quota"))
    )


def _untouched(cells: DataFrame, years: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the given years and the rest. The calendar is short, so the years go to every task."""
    years = F.broadcast(cut_lineage(years.select("year").distinct()))
    return cells.join(years, "year", "left_semi").select(*cells.columns), cells.join(years, "year", "left_anti").select(*cells.columns)


def _overlay(cells: DataFrame, extra: DataFrame, value: str, method: str) -> DataFrame:
    """Let ``extra`` set the weight of its cells, creating those that are missing."""
    both = cells.join(extra, CELL, "full_outer")
    hit = F.col(value).isNotNull()
    kept = [c for c in both.columns if c not in (*CELL, "weight", "weight_method", "ability_method", "input_rows", value)]
    return both.select(
        *CELL,
        F.coalesce(value, "weight").alias("weight"),
        *kept,
        F.when(hit, F.lit(method)).otherwise(F.col("weight_method")).alias("weight_method"),
        F.coalesce("ability_method", F.lit("")).alias("ability_method"),
        F.coalesce("input_rows", F.lit(0)).cast("bigint").alias("input_rows"),
    )


def _beside(cells: DataFrame) -> DataFrame:
    """Cells that an overlay does not meet, in the shape it gives them."""
    return cells.withColumn("ability_method", F.coalesce("ability_method", F.lit(""))).withColumn(
        "input_rows", F.coalesce("input_rows", F.lit(0)).cast("bigint"))


def add_quotas(cells: DataFrame, quotas: DataFrame, rules: PanelRules) -> DataFrame:
    """Published counts set the cells of their years; cells of other years are not moved."""
    met, rest = _untouched(cells, quotas)
    out = _overlay(met, quota_cells(cells, quotas, rules), "quota", QUOTA)
    return out.select(*cells.columns).unionByName(_beside(rest))


def add_capacities(cells: DataFrame, capacities: DataFrame, rules: PanelRules) -> DataFrame:
    """Capacities stand in for one route in years without its actuals.

    Growth over the earlier figure is taken out of the other routes in order.
    Entities without a capacity in such a year read zero. Cells of other years are not moved.
    """
    key = [*ENTITY, "year"]
    caps = capacities.groupBy(*key).agg(F.sum("weight").cast("double").alias("_cap"), F.count("*").alias("_rows"))
    on_route = F.col("route") == rules.capacity_route
    actual = cells.where(on_route & (F.col("weight_method") == OBSERVED)).select("year").distinct()
    caps = cut_lineage(caps.join(actual, "year", "left_anti").select(*key, "_cap", "_rows"))
    met, rest = _untouched(cells, caps)
    base = met.join(caps.select(*key, "_cap"), key, "left")
    closing = on_route & F.col("_cap").isNull()
    base = base.withColumn("weight", F.when(closing, 0.0).otherwise(F.col("weight"))).withColumn(
        "weight_method", F.when(closing, F.lit(RETURNED)).otherwise(F.col("weight_method"))
    ).select(*cells.columns)
    initial = base.where(on_route).select(*key, F.coalesce("weight", F.lit(0.0)).alias("_had"))
    growth = caps.join(initial, key, "left").select(
        *key, (F.col("_cap") - F.coalesce("_had", F.lit(0.0))).alias("_growth")
    ).where("_growth > 0")
    base = deduct_by_priority(base, growth, key, "route", rules.return_order, "weight", "weight_method", "_growth",
                              RETURN_TAG)
    caps = caps.select(*key, F.lit(rules.capacity_route).alias("route"), "_cap", "_rows")
    out = _overlay(base, caps, "_cap", RETURNED)
    out = out.withColumn("input_rows", F.coalesce("_rows", "input_rows")).select(*cells.columns)
    return out.unionByName(_beside(rest))


def densify(cells: DataFrame, seats: DataFrame, rules: PanelRules) -> DataFrame:
    """Every year between an entity's own first and last, for every route it ever used.

    Added cells are zero where the source is known to be complete, else null. An entity has at most
    years x routes cells, so its row lists them and the missing ones are added beside them: cells
    move once, to their entity, and later steps on entities find them there.
    """
    parts = [c for c in cells.columns if c not in ENTITY]
    kinds = dict(cells.dtypes)
    span = cells.groupBy(*ENTITY).agg(
        F.min("year").alias("_first"), F.max("year").alias("_last"), F.collect_set("route").alias("_routes"),
        F.collect_list(F.struct(*parts)).alias("_cells"),
    ).where("_first is not null")
    pairs = F.flatten(F.transform(F.sequence("_first", "_last"), lambda y: F.transform(
        "_routes", lambda r: F.struct(y.alias("year"), r.alias("route")))))
    # A cell with a null in its key is no cell of the grid.
    whole = F.col("grp").isNotNull() & F.col("sub").isNotNull()
    own = F.filter("_cells", lambda c: whole & c["year"].isNotNull() & c["route"].isNotNull())
    span = span.select(*ENTITY, pairs.alias("_grid"), own.alias("_own"))
    missing = F.array_except("_grid", F.transform("_own", lambda c: F.struct(c["year"].alias("year"), c["route"].alias("route"))))
    empty = lambda m: [m[c].alias(c) if c in ("year", "route") else F.lit(None).cast(kinds[c]).alias(c) for c in parts]
    listed = F.concat(
        F.transform("_own", lambda c: F.struct(*[c[p].alias(p) for p in parts], F.lit(True).alias("_cell"))),
        F.transform(missing, lambda m: F.struct(*empty(m), F.lit(False).alias("_cell"))))
    grid = span.select(*ENTITY, F.explode(listed).alias("_c")).select(*ENTITY, "_c.*")
    covered = seats.select("grp", "year", "route").distinct().withColumn("_covered", F.lit(True))
    complete = F.lit(False)
    for route, (first, last) in rules.complete_years.items():
        complete = complete | ((F.col("route") == route) & F.col("year").between(first, last))
    full = looked_up(grid, covered, ["grp", "year", "route"], "left")
    added = ~F.col("_cell")
    zero = added & (complete | F.coalesce("_covered", F.lit(False)))
    return full.select(
        *CELL,
        F.when(zero, 0.0).otherwise(F.col("weight")).alias("weight"),
        "ability",
        F.when(zero, F.lit(STRUCTURAL_ZERO)).when(added, F.lit("")).otherwise(F.col("weight_method")).alias("weight_method"),
        F.coalesce("ability_method", F.lit("")).alias("ability_method"),
        F.coalesce("input_rows", F.lit(0)).cast("bigint").alias("input_rows"),
    )


def fill_own_series(cells: DataFrame) -> DataFrame:
    """Fill weights, then scores, from the same entity and route in other years."""
    series = [*ENTITY, "route"]
    out = fill_series(cells, series, "year", "weight", "weight_method")
    return fill_series(out, series, "year", "ability", "ability_method").select(*cells.columns)


def _live(cells: DataFrame) -> DataFrame:
    live = cells.where(F.col("ability").isNotNull() & (F.col("weight") > 0))
    return live.select("grp", "sub", "route", "year", (F.col("ability") * F.col("weight")).alias("_s"), F.col("weight").alias("_w"))


def _wide_sums(cells: DataFrame) -> DataFrame:
    """Sums by group, route and year, of which the levels above the entity are made."""
    return cut_lineage(_live(cells).groupBy("grp", "route", "year").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w")))


def _means(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sums.groupBy(*keys).agg((F.sum("_s") / F.sum("_w")).alias("mean")).where("mean is not null")


def fallback_means(cells: DataFrame) -> DataFrame:
    """Weighted means at all fallback levels; those above the entity come from one small table of sums."""
    axes = ["grp", "sub", "route", "year"]
    rows, wide, kinds = _live(cells), _wide_sums(cells), dict(cells.dtypes)
    out = None
    for place, (_, keys) in enumerate(FALLBACK_LEVELS):
        level = _means(rows if "sub" in keys else wide, keys)
        named = [F.col(a) if a in keys else F.lit(None).cast(kinds[a]).alias(a) for a in axes]
        level = level.select(*named, "mean", F.lit(place).alias("level"))
        out = level if out is None else out.unionByName(level)
    return out


def fill_fallbacks(cells: DataFrame) -> DataFrame:
    """Fill cells with no own history from the narrowest level that has a mean.

    Means are taken before any fallback fill. An entity has at most years x routes cells, so its own
    means are windows over cells that :func:`densify` has already brought together; the cells are
    written once with them. Means of wider levels are few and are measured lookups, so that no
    key of theirs gathers rows.
    """
    live = F.col("ability").isNotNull() & (F.col("weight") > 0)
    near, found = cells, []
    for place, (name, keys) in enumerate(FALLBACK_LEVELS):
        if set(ENTITY) <= set(keys):
            along = Window.partitionBy(*keys)
            mean = F.sum(F.when(live, F.col("ability") * F.col("weight"))).over(along) / F.sum(F.when(live, F.col("weight"))).over(along)
            # Rows with a null in the key have no level of that key.
            named = F.lit(True)
            for k in keys:
                named = named & F.col(k).isNotNull()
            near = near.withColumn(f"_mean{place}", F.when(named, mean))
    near = met = cut_lineage(near)
    sums = _wide_sums(near)
    for place, (name, keys) in enumerate(FALLBACK_LEVELS):
        if not keys:
            met = met.withColumn(f"_mean{place}", cut_lineage(_means(sums, keys)).agg(F.max("mean")).scalar())
        elif not set(ENTITY) <= set(keys):
            met = looked_up(met, _means(sums, keys).withColumnRenamed("mean", f"_mean{place}"), list(keys), "left")
        found.append(f"_mean{place}")
    method = F.when(F.col("ability").isNotNull(), F.col("ability_method"))
    for column, (name, _) in zip(found, FALLBACK_LEVELS):
        method = method.when(F.col(column).isNotNull(), F.lit(name))
    return met.withColumn("ability_method", method.otherwise(F.col("ability_method"))).withColumn(
        "ability", F.coalesce("ability", *found)).select(*cells.columns)


def calibrate(cells: DataFrame, totals: DataFrame, rules: PanelRules) -> DataFrame:
    """Scale the imputed weights of a (year, route) so that it meets its published total.

    Left alone: no weight held, nothing imputed, a total below the part that is
    not imputed, or a route set aside.
    """
    name = F.col("route")
    for route, published in rules.total_names.items():
        name = F.when(F.col("route") == route, F.lit(published)).otherwise(name)
    marked = cells.withColumn("_total_route", name)
    imputed = F.col("weight_method").startswith("interpolated") | F.col("weight_method").startswith("nearest")
    sums = marked.groupBy("year", "_total_route").agg(
        F.sum(F.coalesce("weight", F.lit(0.0))).alias("_base"),
        F.sum(F.when(imputed, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)).alias("_est"),
    )
    targets = totals.select("year", F.col("route").alias("_total_route"), F.col("total").cast("double").alias("_target"))
    factor = sums.join(targets, ["year", "_total_route"]).where(
        (F.col("_base") > 0) & (F.col("_est") > 0) & (F.col("_target") >= F.col("_base") - F.col("_est"))
        & ~F.col("_total_route").isin(list(rules.uncalibrated))
    ).select("year", "_total_route", ((F.col("_target") - F.col("_base") + F.col("_est")) / F.col("_est")).alias("_scale"))
    joined = looked_up(marked, factor, ["year", "_total_route"], "left")
    hit = imputed & F.col("_scale").isNotNull()
    tagged = hit & (F.abs(F.col("_scale") - 1.0) > 1e-9)
    return joined.select(
        *CELL,
        F.when(hit, F.col("weight") * F.col("_scale")).otherwise(F.col("weight")).alias("weight"),
        "ability",
        F.when(tagged, F.concat("weight_method", F.lit(SCALED_TAG))).otherwise(F.col("weight_method")).alias("weight_method"),
        "ability_method",
        "input_rows",
        F.when(hit, F.col("_scale")).otherwise(1.0).alias("weight_scale"),
    )


def display_labels(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest label of each entity, the heavier one within a year."""
    return labels.groupBy(*keys).agg(F.max_by("label", F.struct("year", "weight", "label")).alias("label"))


def year_names(rows: DataFrame, keys: Sequence[str], year: str, name: str) -> DataFrame:
    """Sorted distinct names per entity and year as one text; pairs are made distinct first."""
    pairs = rows.select(*keys, year, name).distinct()
    return pairs.groupBy(*keys, year).agg(F.array_join(F.array_sort(F.collect_list(name)), " | ").alias("names"))


def entity_names(labels: DataFrame) -> DataFrame:
    """One row per entity: its latest label and its names by year, sorted. Entities move once."""
    mine = labels.repartition(*ENTITY)
    years = mine.groupBy(*ENTITY, "year").agg(
        F.array_join(F.array_sort(F.collect_set("source")), " | ").alias("names"), F.max(F.struct("year", "weight", "label")).alias("_top"))
    return years.groupBy(*ENTITY).agg(
        F.max("_top")["label"].alias("label"), F.array_sort(F.collect_list(F.struct(F.col("year").alias("y"), F.col("names").alias("v")))).alias("_names"))


def nearest_year(rows: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Fill a null from the nearest year of the same entity, the earlier on a tie."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(year).alias("y"), F.col(value).alias("v")))
    near = carried(rows, keys, [year], last={"_lo": seen}, following={"_hi": seen}, bounded=True)
    lo, hi, at = F.col("_lo"), F.col("_hi"), F.col(year)
    pick = F.when(hi.isNull() | (at - lo["y"] <= hi["y"] - at), lo["v"]).otherwise(hi["v"])
    return near.withColumn(value, pick).drop("_lo", "_hi")


def output_rows(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Panel rows with the entity's label, the name used that year, and rounding.

    Cells meet one row per entity, which lists its names by year; a year without one has the
    name of the nearest, the earlier on a tie.
    """
    both = cells.join(entity_names(labels), ENTITY).where("year is not null")
    at = F.col("year")
    later = F.size(F.filter("_names", lambda n: n["y"] > at))
    both = both.withColumn("_lo", F.get("_names", F.size("_names") - later - 1)).withColumn("_hi", F.get("_names", F.size("_names") - later))
    lo, hi = F.col("_lo"), F.col("_hi")
    names = F.when(hi.isNull() | (at - lo["y"] <= hi["y"] - at), lo["v"]).otherwise(hi["v"])
    return both.select(
        "year", "grp", "sub", names.alias("year_name"), "label", "route",
        F.round("weight", 2).alias("weight"), F.round("ability", 3).alias("ability"),
        "weight_method", F.round("weight_scale", 6).alias("weight_scale"), "ability_method", "input_rows",
    )


def build(scored: DataFrame, seats: DataFrame, quotas: DataFrame, capacities: DataFrame, totals: DataFrame,
          rules: PanelRules, stages: str = "all") -> DataFrame:
    """Run the stages in order; ``stages`` names the last one to run.

    Stages that look at the cells more than once get a written table in the
    shared folder: nothing is recomputed from the raw rows, and a lost executor
    costs one stage. From :func:`densify` on, cells lie with their entity until written.
    """
    cells = observed_cells(scored, seats)
    if stages == "observed":
        return cells
    if rules.quota_routes:
        cells = add_quotas(cut_lineage(cells), quotas, rules)
    if stages == "quotas":
        return cells
    if rules.capacity_route:
        cells = add_capacities(cut_lineage(cells), capacities, rules)
    if stages == "capacities":
        return cells
    cells = densify(cells, seats, rules)
    if stages == "dense":
        return cells
    cells = fill_own_series(cells)
    if stages == "filled":
        return cells
    cells = fill_fallbacks(cells)
    if stages == "fallback":
        return cells
    return calibrate(cells, totals, rules)


def rank_entities(panel: DataFrame, direct: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank entities on the completed panel, next to their direct readings."""
    read = panel.select(*dict.fromkeys([*keys, "year", "route", "ability", "weight"]))
    scores = active_years(cut_lineage(read), keys, "year", "route", "ability", "weight")
    both = scores.join(direct, list(keys), "left").withColumn("score", F.round("score", 2))
    return numbered(both, [], [-F.col("score"), *[F.col(k) for k in keys]], "rank")
