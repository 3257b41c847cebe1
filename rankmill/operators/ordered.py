"""Running sums, ranks and carried values that survive one huge key.

A window over ``partitionBy(key)`` sorts a whole key in one task. Here the frame is range
partitioned along (key, order) and written once to the shared folder together with the
number of its partition, the *slice*. The window runs inside (key, slice), and what the
earlier slices of the key contribute comes from a table of slice totals. There is one
algorithm for all sizes: a slice is a partition, so slices stay as small as partitions
are, however large a key is, and adaptive execution makes one slice of a small frame.

The input is read once. The slice totals number at most keys plus slices and are joined,
not broadcast by force; a key's totals, at most one for each slice, meet in one window.
Rows that are equal in key and order share a slice, so end the order in a unique column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

Order = Sequence["str | Column"]


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _places(order: Order) -> list[str]:
    return [f"__o{i}" for i in range(len(order))]


def sliced(df: DataFrame, keys: Sequence[str], order: Order, slice_rows: int | None = None) -> DataFrame:
    """The rows with ``__slice``, which rises along (keys, order), and the order as ``__o0``, ``__o1``, ...

    ``slice_rows`` asks for slices of about so many rows; by default they are as large
    as the session's partitions.
    """
    wide = df.withColumns(dict(zip(_places(order), map(_col, order))))
    along = [*keys, *_places(order)]
    if slice_rows is None:
        spread = wide.repartitionByRange(*along)
    else:
        wide = cut_lineage(wide)
        spread = wide.repartitionByRange(max(1, -(-wide.count() // slice_rows)), *along)
    return cut_lineage(spread.withColumn("__slice", F.spark_partition_id()))


def _with_offsets(local: DataFrame, parts: DataFrame, keys: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Join what the key's other slices contribute, as ``__off_`` columns."""
    named = [column.alias("__off_" + name) for name, column in columns.items()]
    offsets = parts.select(*[F.col(k).alias("__k_" + k) for k in keys], F.col("__slice").alias("__at"), *named)
    match = local["__slice"] == offsets["__at"]
    for key in keys:
        match = match & local[key].eqNullSafe(offsets["__k_" + key])
    return local.join(offsets, match, "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    sums: Mapping[str, str | Column],
    *,
    before: bool = False,
    totals: Mapping[str, str | Column] | None = None,
    bounded: bool = False,
    slice_rows: int | None = None,
) -> DataFrame:
    """Cumulative sums per key along ``order`` (ascending), plus key totals.

    ``before`` leaves the row itself out. ``bounded`` is for inputs whose rows per key
    are limited by their domain (say, years of one entity): a plain window.
    """
    keys, totals = list(keys), dict(totals or {})
    stop = -1 if before else 0
    zero = F.lit(0)
    if bounded:
        along = Window.partitionBy(*keys).orderBy(*map(_col, order)).rowsBetween(Window.unboundedPreceding, stop)
        whole = Window.partitionBy(*keys)
        return df.select(
            "*",
            *[F.coalesce(F.sum(_col(v)).over(along), zero).alias(n) for n, v in sums.items()],
            *[F.sum(_col(v)).over(whole).alias(n) for n, v in totals.items()],
        )
    cut = sliced(df, keys, order, slice_rows)
    parts = cut.groupBy(*keys, "__slice").agg(
        *[F.sum(_col(v)).alias("__s_" + n) for n, v in sums.items()],
        *[F.sum(_col(v)).alias("__t_" + n) for n, v in totals.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    inside = Window.partitionBy(*keys, "__slice").orderBy(*_places(order)).rowsBetween(Window.unboundedPreceding, stop)
    local = cut.select("*", *[F.sum(_col(v)).over(inside).alias("__loc_" + n) for n, v in sums.items()])
    offsets = {n: F.sum("__s_" + n).over(earlier) for n in sums} | {"t_" + n: F.sum("__t_" + n).over(every) for n in totals}
    return _with_offsets(local, parts, keys, offsets).select(
        *df.columns,
        *[(F.coalesce("__loc_" + n, zero) + F.coalesce("__off_" + n, zero)).alias(n) for n in sums],
        *[F.col("__off_t_" + n).alias(n) for n in totals],
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Order, name: str, **options) -> DataFrame:
    """Unique positions 1..n per key along ``order``; end the order with a unique column."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")}, **options)


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    *,
    last: Mapping[str, str | Column] | None = None,
    following: Mapping[str, str | Column] | None = None,
    previous: Mapping[str, str | Column] | None = None,
    bounded: bool = False,
    slice_rows: int | None = None,
) -> DataFrame:
    """Nearest non-null value at or before the row (``last``), strictly before it
    (``previous``) and strictly after it (``following``).

    Unless ``bounded``, values ahead are carried along the reversed order: a frame that ends at the
    end of a key is read anew for every row, one that begins at its start is not. Rows are numbered
    along the order first, so that both directions see ties alike.
    """
    keys, last, following, previous = list(keys), dict(last or {}), dict(following or {}), dict(previous or {})
    base = df if bounded else sliced(df, keys, order, slice_rows)
    group = keys if bounded else [*keys, "__slice"]
    place = [_col(c) for c in order] if bounded else [F.col(p) for p in _places(order)]
    whole = Window.partitionBy(*group).orderBy(*place)
    back = whole.rowsBetween(Window.unboundedPreceding, 0)
    passed = whole.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*group).orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, -1)
    near = [F.last(_col(v), True).over(back).alias(n) for n, v in last.items()]
    near += [F.last(_col(v), True).over(passed).alias(n) for n, v in previous.items()]
    if bounded:  # few rows a key: a second sort would cost more than reading them anew
        near += [F.first(_col(v), True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias(n) for n, v in following.items()]
        return df.select("*", *near)
    local = base.select("*", *near)
    if following:
        # The values ahead are read off the input, which a name of ``last`` may shadow.
        values = [_col(v).alias(f"__v{i}") for i, v in enumerate(following.values())]
        placed = base.select("*", *near, *values, F.row_number().over(whole).alias("__place"))
        found = [F.last(f"__v{i}", True).over(ahead).alias(n) for i, n in enumerate(following)]
        local = placed.select("*", *found).drop("__place", *[f"__v{i}" for i in range(len(values))])
    last = last | previous
    at = F.struct(*place)
    edges = base.groupBy(*keys, "__slice").agg(
        *[F.max_by(_col(v), F.when(_col(v).isNotNull(), at)).alias(n) for n, v in last.items()],
        *[F.min_by(_col(v), F.when(_col(v).isNotNull(), at)).alias(n) for n, v in following.items()],
    )
    slices = Window.partitionBy(*keys).orderBy("__slice")
    behind = slices.rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*keys).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = {n: F.last(n, True).over(behind) for n in last} | {n: F.last(n, True).over(onward) for n in following}
    return _with_offsets(local, edges, keys, offsets).select(
        *df.columns, *[F.coalesce(n, "__off_" + n).alias(n) for n in (*last, *following)]
    )
