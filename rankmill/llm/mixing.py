"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. Within the source, every document expects
target / size copies; the expected copies are summed along an order, one random offset
per source is added, and a document is emitted once for each integer boundary that its
stretch of the sum crosses. The order is by size, so that documents of every length are
taken in proportion and the words taken stay near the target.

The running sum of equal expectations is rank x rate, so that only the rank within the
source is needed. The narrow rows are range-partitioned along the order and written once
to the shared folder; ranks inside a partition plus the counts of earlier partitions give
the rank. A source that holds any share of all rows is thus spread over many tasks.

Defined results: null texts count as empty, a null source is a source of its own and the
last; sources without words have target 0 and none of their documents is emitted; ties in
the order are broken by a hash of the id and the id, and rows that repeat an id are told
apart only by how often they are emitted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

from .words import word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0


def unit(value: Column, salt: str) -> Column:
    """A fixed pseudo-random number in [0, 1) for each value (32 bits of its MD5)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(value.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, take the weights in turn. Sharing again and again
    what exceeds ``most`` times a source's size ends where each source has the lesser of
    that and level x weight, for the one level at which all add up to the budget. The
    sources that stop first have the least size per weight, so that the level follows
    from sums along that order. One row per source: small next to the documents.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    rows = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    filling = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("place", F.struct(F.row_number().over(filling).alias("n"), level.alias("level")))
    # The first source that its level does not fill, and all after it, share that level.
    unfilled = F.col("place.level") * F.col("weight") <= F.col("bound")
    shared = F.min(F.when(unfilled, F.col("place"))).over(every)["level"]
    target = F.least("bound", F.coalesce(shared * F.col("weight"), F.col("bound")))
    return rows.select("source", "source_size", target.alias("target"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Add ``rank`` within the source, along (size, tie, id)."""
    order = ("size", "tie", "id")
    spread = rows.repartitionByRange("source", *order).withColumn("slice", F.spark_partition_id())
    spread = cut_lineage(spread)
    counts = spread.groupBy("source", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("source").alias("s_source"), F.col("slice").alias("s_slice"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
    )
    inside = F.row_number().over(Window.partitionBy("slice", "source").orderBy(*order))
    placed = spread.withColumn("inside", inside)
    same = (F.col("slice") == F.col("s_slice")) & F.col("source").eqNullSafe(F.col("s_source"))
    return placed.join(starts, same).withColumn("rank", F.col("start") + F.col("inside"))


def emitted(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """One row per input row: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"))
    placed = _ranked(rows.withColumn("tie", unit(F.col("id"), seed)))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, share, most).withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.lit("source "), F.col("t_source")), seed)
    aims = aims.select("*", rate.alias("rate"), offset.alias("offset"))
    joined = placed.join(aims, F.col("source").eqNullSafe(F.col("t_source")))
    upto = lambda n: F.floor(F.col("offset") + n * F.col("rate"))
    copies = upto(F.col("rank")) - upto(F.col("rank") - 1)
    return joined.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents, each as often as it is emitted, with their own columns.

    The copies meet the texts again on (id, source, size). Rows that repeat all three
    take their numbers of copies in the order of their texts.
    """
    marks = emitted(docs, doc_id, text, source, **options)
    at = F.row_number().over(Window.partitionBy("_y_key").orderBy("copies"))
    marks = marks.withColumn("_y_key", F.xxhash64("id", "source", "size")).withColumn("_y_at", at)
    marks = marks.select("_y_key", "_y_at", F.col("copies").alias("_y_copies"))
    rows = docs.withColumn("_x_key", F.xxhash64(F.col(doc_id), F.col(source), word_count(text)))
    rows = rows.withColumn("_x_at", F.row_number().over(Window.partitionBy("_x_key").orderBy(F.xxhash64(F.col(text)))))
    rows = rows.join(marks, (F.col("_x_key") == F.col("_y_key")) & (F.col("_x_at") == F.col("_y_at")))
    rows = rows.where("_y_copies > 0").withColumn("_x_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_y_copies")))
    return rows.select(*docs.columns)
