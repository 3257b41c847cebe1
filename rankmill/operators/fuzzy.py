"""Name matching that repairs a clear slip and rejects an ambiguous one."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - edit distance over the longer length."""
    longest = F.greatest(F.length(left), F.length(right))
    return 1.0 - F.levenshtein(left, right) / longest


@F.pandas_udf(T.DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 2M/T over the matching blocks."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def _edits(longest: Column, above: float) -> Column:
    """Most edits a pair may need while its similarity can still reach ``above``."""
    return F.floor((1.0 - above) * longest + 1e-9).cast("int")


def near_pairs(source: DataFrame, known: DataFrame, keys: Sequence[str], name: str, above: float,
               max_length_gap: int | None = None) -> DataFrame:
    """Distinct name pairs of a block whose edit similarity can reach ``above``.

    Exact, without comparing all pairs: a name within k edits keeps at least one
    of k + 1 segments of the other intact, at most k places away (Pass-Join, Li
    et al., VLDB 2011). The segments are join keys; the similarity itself is
    computed only for pairs that share one.
    """
    keys = list(keys)
    left = source.select(*keys, F.col(name).alias("source_name")).where("source_name <> ''").distinct()
    right = known.select(*keys, F.col(name).alias("known_name")).where("known_name <> ''").distinct()
    gap = lambda n: F.floor(n / F.lit(above) + 1e-9).cast("int") - n  # noqa: E731 - longest partner minus own length
    n = F.length("source_name")
    low = F.ceil(n * above - 1e-9).cast("int")
    high = n + gap(n)
    if max_length_gap is not None:
        low, high = F.greatest(low, n - max_length_gap), F.least(high, n + max_length_gap)
    probes = left.select("*", n.alias("ls"), F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("lc"))
    m = F.length("known_name")
    low = F.ceil(m * above - 1e-9).cast("int")
    high = m + gap(m)
    if max_length_gap is not None:
        low, high = F.greatest(low, m - max_length_gap), F.least(high, m + max_length_gap)
    pieces = right.select("*", m.alias("lc"), F.explode(F.sequence(F.greatest(low, F.lit(1)), high)).alias("ls"))

    def cut(df: DataFrame) -> DataFrame:
        k = F.least(_edits(F.greatest("ls", "lc"), above), F.col("lc") - 1)
        df = df.withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        size = F.col("k") + 1
        begin = F.floor(F.col("i") * F.col("lc") / size).cast("int")
        end = F.floor((F.col("i") + 1) * F.col("lc") / size).cast("int")
        return df.withColumn("at", begin).withColumn("len", end - begin)

    pieces = cut(pieces).select(*keys, "known_name", "ls", "lc", "i",
                                F.col("known_name").substr(F.col("at") + 1, F.col("len")).alias("piece"))
    probes = cut(probes)
    first = F.greatest(F.lit(0), F.col("at") - F.col("k"))
    final = F.least(F.col("ls") - F.col("len"), F.col("at") + F.col("k"))
    probes = probes.where(final >= first).select("*", F.explode(F.sequence(first, final)).alias("from"))
    probes = probes.select(*keys, "source_name", "ls", "lc", "i",
                           F.col("source_name").substr(F.col("from") + 1, F.col("len")).alias("piece"))
    met = probes.join(pieces, [*keys, "ls", "lc", "i", "piece"]).select(*keys, "source_name", "known_name").distinct()
    scored = met.withColumn("similarity", edit_similarity(F.col("source_name"), F.col("known_name")))
    return scored.where(F.col("similarity") >= above - 1e-12)


def _block_pairs(source: DataFrame, known: DataFrame, keys: Sequence[str], name: str, above: float,
                 max_length_gap: int | None) -> DataFrame:
    """Distinct names of one block compared by matching blocks, lengths permitting.

    This similarity has no join key that keeps every pair, so pairs are limited
    by the length bound 2 * min / (a + b) alone; both sides are distinct names.
    """
    left = source.select(*keys, F.col(name).alias("source_name")).where("source_name <> ''").distinct()
    right = known.select(*keys, F.col(name).alias("known_name")).where("known_name <> ''").distinct()
    met = left.join(right, list(keys))
    a, b = F.length("source_name"), F.length("known_name")
    met = met.where(2 * F.least(a, b) >= above * (a + b))
    if max_length_gap is not None:
        met = met.where(F.abs(a - b) <= max_length_gap)
    return met.withColumn("similarity", matching_ratio("source_name", "known_name")).where(F.col("similarity") >= above)


def clear_matches(source: DataFrame, known: DataFrame, keys: Sequence[str], name: str, floor: float = 0.80,
                  margin: float = 0.15, similarity: str = "edit") -> DataFrame:
    """Best known name per source name, if good enough and clear of the runner-up.

    Runners-up below ``floor - margin`` can never spoil a match, so pairs under
    that bound need not be found.
    """
    finder = near_pairs if similarity == "edit" else _block_pairs
    pairs = finder(source, known, keys, name, floor - margin, None)
    best = pairs.groupBy(*keys, "source_name").agg(
        F.max(F.struct("similarity", "known_name")).alias("_best"),
        F.count("*").alias("_n"),
    )
    with_best = pairs.join(best, [*keys, "source_name"])
    second = with_best.groupBy(*keys, "source_name").agg(
        F.first("_best").alias("_best"),
        F.max(F.when(F.col("known_name") != F.col("_best")["known_name"], F.col("similarity"))).alias("_second"),
    )
    clear = (F.col("_best")["similarity"] >= floor) & (
        F.col("_best")["similarity"] - F.coalesce("_second", F.lit(0.0)) >= margin - 1e-12
    )
    return second.where(clear).select(
        *keys, "source_name", F.col("_best")["known_name"].alias("known_name"),
        F.col("_best")["similarity"].alias("similarity"),
    )


def join_known(rows: DataFrame, known: DataFrame, keys: Sequence[str], name: str, fold, repairable: Column,
               **options) -> DataFrame:
    """Keep rows naming a known entity, in the known spelling; repair slips only where allowed.

    ``fold`` maps a name to its grouping key. Rows that match on the folded key
    adopt the known spelling; the rest go through :func:`clear_matches` where
    ``repairable`` holds, and are dropped otherwise.
    """
    keys = list(keys)
    spelled = known.groupBy(*keys, fold(F.col(name)).alias("_key")).agg(F.min(name).alias("_known"))
    joined = rows.withColumn("_key", fold(F.col(name))).join(spelled, [*keys, "_key"], "left")
    exact = joined.where("_known is not null").withColumn(name, F.col("_known"))
    rest = joined.where("_known is null").where(repairable)
    found = clear_matches(rest, spelled.select(*keys, F.col("_known").alias(name)), keys, name, **options)
    fixed = rest.drop("_known").join(
        found.select(*keys, F.col("source_name").alias(name), "known_name"), [*keys, name]
    ).withColumn(name, F.col("known_name"))
    return exact.select(*rows.columns).unionByName(fixed.select(*rows.columns))


def snap(rows: DataFrame, known: DataFrame, keys: Sequence[str], name: str, floor: float = 0.6,
         max_length_gap: int = 2, similarity: str = "edit") -> DataFrame:
    """Replace each name by the nearest known one, or keep it; ties go by name order."""
    finder = near_pairs if similarity == "edit" else _block_pairs
    pairs = finder(rows, known, keys, name, floor, max_length_gap)
    top = pairs.groupBy(*keys, "source_name").agg(F.max("similarity").alias("_top"))
    best = pairs.join(top, [*keys, "source_name"]).where("similarity = _top").groupBy(*keys, "source_name").agg(
        F.min("known_name").alias("_known")
    )
    out = rows.join(best.withColumnRenamed("source_name", name), [*keys, name], "left")
    return out.withColumn("snapped", F.coalesce("_known", name)).drop("_known")

