"""Data-quality checks: conflicts, control totals, total rows, completeness, version agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incomplete_groups(df: DataFrame, keys: Sequence[str], band: str, expected: int) -> DataFrame:
    """Groups whose number of distinct bands is not the expected one."""
    found = df.select(*keys, band).distinct().groupBy(*keys).agg(F.count("*").alias("bins"))
    return found.where(F.col("bins") != expected)


def dedupe_checked(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Identical duplicates collapse; a key with two different values fails the job."""
    low = F.min(F.struct(*values)).alias("_low")
    high = F.max(F.struct(*values)).alias("_high")
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    found = df.groupBy(*keys).agg(low, high).withColumn(
        "_low",
        F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(F.raise_error(F.concat(F.lit("conflicting rows for "), text)).cast(
            "struct<" + ",".join(f"{v}:{df.schema[v].dataType.simpleString()}" for v in values) + ">"
        )),
    )
    return found.select(*keys, "_low.*")


def conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys reported with more than one value."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high")


def control_totals(detail: DataFrame, totals: DataFrame, keys: Sequence[str], amount: str, published: str,
                   tolerance: float = 0.0, fail: bool = False) -> DataFrame:
    """Keys whose summed detail misses its published total, or whose detail is negative."""
    held = detail.groupBy(*keys).agg(F.sum(amount).alias("held"), F.min(amount).alias("least"))
    both = held.join(totals.select(*keys, F.col(published).alias("published")), list(keys), "full_outer")
    diff = F.coalesce("held", F.lit(0.0)) - F.coalesce("published", F.lit(0.0))
    wrong = both.withColumn("difference", diff).where(
        (F.abs("difference") > tolerance) | (F.col("least") < 0)
    ).drop("least")
    if fail:
        text = F.concat(F.lit("detail misses its total for "), F.concat_ws("|", *keys))
        return wrong.withColumn("difference", F.raise_error(text).cast("double"))
    return wrong


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def total_rows(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows equal, on every measure, to the sum of the other rows of their table.

    The table sums are one partial aggregate joined back, so a huge table is
    never gathered in one task.
    """
    sums = df.groupBy(*keys).agg(*[F.sum(m).alias("_all_" + m) for m in measures])
    if keys:
        joined = df.join(sums, list(keys))
    else:
        joined = df.withColumns({"_all_" + m: sums.select("_all_" + m).scalar() for m in measures})
    test = F.lit(True)
    for m in measures:
        test = test & (F.abs(F.col("_all_" + m) - 2 * F.col(m)) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col(m))))
    return joined.where(test).select(*df.columns)


def field_agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str],
                    gate: float = 0.99) -> DataFrame:
    """Share of matched keys on which two versions agree, field by field."""
    both = left.select(*keys, *fields).alias("l").join(right.select(*keys, *fields).alias("r"), list(keys))
    same = [F.avg(F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")).cast("double")).alias(f) for f in fields]
    one = both.agg(F.count("*").alias("matched"), *same)
    long = one.unpivot(["matched"], list(fields), "field", "agreement")
    return long.withColumn("passed", F.coalesce(F.col("agreement") >= gate, F.lit(False)))


def unknown_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys that the table does not hold."""
    return wanted.join(known.select(key).distinct(), key, "left_anti")


def status_of(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """First matching rule's label."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(default) if out is None else out.otherwise(default)


def required_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Select canonical columns from a sheet whose headers go by aliases.

    Exactly one alias of each canonical name must be present.
    """
    present = {name.strip(): name for name in df.columns}
    picked = []
    for canonical, names in aliases.items():
        hits = [present[n] for n in names if n in present]
        if len(hits) != 1:
            raise ValueError(f"{canonical}: expected one of {list(names)}, found {hits}")
        picked.append(F.col(f"`{hits[0]}`").alias(canonical))
    return df.select(*picked)
