"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Rows are grouped by length,
the groups of two or more by the hash of a prefix, and only what still stands in a
group of two or more has its whole content hashed (SHA-256). Of equal texts the row
with the largest id stays.

Shuffles: the narrow keys (id, length, prefix hash) decide who survives. The texts
then meet the survivors on a key that contains the id, so a group of copies that
holds a third of all rows is spread over all tasks; each group is summed before it
is shuffled. Narrow results of the content pass are written once to the shared
folder, so that no text is hashed again.

Defined results: a null text counts as empty; a null id is smaller than any other
and, where all ids of a group are null, the kept id is null; rows that repeat both id
and text are one group and exactly one of them stays; an empty table gives an empty
result. Other columns of the input are never touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

from .words import lowered

PREFIX_CHARS = 256
KEYS = ("_x_key", "_x_bytes", "_x_head")


def _keyed(docs: DataFrame, doc_id: str, text: str, prefix_chars: int) -> DataFrame:
    """The rows with their length in bytes and the hash of their first characters.

    Lower-casing A-Z changes no length, so that the length needs no normalised text.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    head = F.xxhash64(lowered(F.substring(F.col(text), 1, prefix_chars)))
    wide = docs.withColumns({"_x_bytes": size, "_x_head": head})
    return wide.withColumn("_x_key", F.xxhash64(F.col(doc_id), "_x_bytes", "_x_head"))


def survivors(keys: DataFrame) -> DataFrame:
    """Of rows with ``_x_bytes`` and ``_x_head``, those that share both with another row."""
    rest = keys
    for by in (["_x_bytes"], ["_x_bytes", "_x_head"]):
        groups = rest.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
        # Written, the groups are a plain side of the join: Spark splits hot keys of the other.
        rest = rest.join(cut_lineage(groups), by, "left_semi")
    return rest.distinct()


def _meet(rows: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """Left join on the keys; ``found`` has them and the id as ``_y_id``."""
    renamed = found.withColumnsRenamed({k: k.replace("_x_", "_y_") for k in KEYS})
    same = F.col("_x_key") == F.col("_y_key")
    same &= (F.col("_x_bytes") == F.col("_y_bytes")) & (F.col("_x_head") == F.col("_y_head"))
    same &= F.col(doc_id).eqNullSafe(F.col("_y_id"))
    return rows.join(renamed, same, "left").drop("_y_key", "_y_bytes", "_y_head", "_y_id")


def decisions(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    prefix_chars: int = PREFIX_CHARS,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per different (id, text): ``_x_id``, ``keep_id``, ``group_size``, ``copies``.

    ``copies`` counts rows that repeat id and text. ``full_hash`` is null where length
    or prefix already told the text from all others. ``carry`` holds further columns
    that depend on id and text only, computed while the content is read.
    """
    carry = dict(carry or {})
    keys = cut_lineage(
        _keyed(docs.select(doc_id, text), doc_id, text, prefix_chars).select(F.col(doc_id).alias("_y_id"), *KEYS)
    )
    rows = _keyed(docs.select(doc_id, text), doc_id, text, prefix_chars)
    rows = _meet(rows, survivors(keys).withColumn("_x_alive", F.lit(True)), doc_id)
    full = F.when(F.col("_x_alive"), F.sha2(lowered(text), 256))
    read = rows.select(
        F.col(doc_id).alias("_x_id"), *KEYS, full.alias("full_hash"), *[c.alias(n) for n, c in carry.items()]
    )
    read = cut_lineage(read.groupBy(*read.columns).agg(F.count(F.lit(1)).alias("copies")))
    groups = (
        read.where("full_hash is not null")
        .groupBy(F.col("_x_bytes").alias("g_bytes"), F.col("full_hash").alias("g_hash"))
        .agg(F.max("_x_id").alias("g_keep"), F.sum("copies").alias("g_size"))
    )
    groups = cut_lineage(groups)
    same = (F.col("_x_bytes") == F.col("g_bytes")) & (F.col("full_hash") == F.col("g_hash"))
    alone = F.col("g_size").isNull()
    return read.join(groups, same, "left").select(
        *read.columns,
        F.when(alone, F.col("_x_id")).otherwise(F.col("g_keep")).alias("keep_id"),
        F.when(alone, F.col("copies")).otherwise(F.col("g_size")).alias("group_size"),
    )


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and the carried columns."""
    carry = list(options.get("carry") or {})
    made = decisions(docs, doc_id, text, **options)
    each = made.withColumn("_x_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    kept = F.col("_x_id").eqNullSafe(F.col("keep_id")) & (F.col("_x_copy") == 1)
    return each.select(
        F.col("_x_id").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), "full_hash", *carry
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with their own columns, one of each group of equal texts.

    Rows no group claims pass by; the others are looked up by (id, length, prefix),
    and their content is hashed again only where that still names several texts or rows.
    """
    made = decisions(docs, doc_id, text, **options).where("full_hash is not null")
    kept = F.col("_x_id").eqNullSafe(F.col("keep_id"))
    found = made.groupBy(F.col("_x_id").alias("_y_id"), *KEYS).agg(
        F.collect_set(F.when(kept, F.col("full_hash"))).alias("_x_kept"),
        F.count(F.lit(1)).alias("_x_texts"),
        F.sum("copies").alias("_x_rows"),
    )
    rows = _keyed(docs, doc_id, text, options.get("prefix_chars", PREFIX_CHARS))
    rows = _meet(rows, found, doc_id)
    full = F.sha2(lowered(text), 256)
    stays = (
        F.when(F.col("_x_rows").isNull(), True)
        .when(F.col("_x_texts") == 1, F.size("_x_kept") > 0)
        .otherwise(F.array_contains("_x_kept", full))
    )
    rows = rows.where(stays).withColumn("_x_full", F.when(F.col("_x_rows") > 1, full))
    again = F.row_number().over(Window.partitionBy(*KEYS, "_x_full").orderBy("_x_key"))
    # Rows without a group are alone under their keys, unless they repeat nothing at all.
    return rows.withColumn("_x_again", again).where("_x_again = 1").select(*docs.columns)
