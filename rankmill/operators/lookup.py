"""Joins of many rows with a small table whose size is measured, not hoped for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written_bytes

# Rows and written bytes up to which a table is sent to every task, and the shares a hot key is cut into.
MOST_ROWS = 1_000_000
MOST_BYTES = 8 << 20
SALTS = 32


def looked_up(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", *,
              most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, salts: int = SALTS) -> DataFrame:
    """Join rows with a lookup table that is expected to be small.

    The table is written and its rows and bytes are counted. Within both bounds it goes to
    every task, and the rows stay where they are. Beyond, rows are dealt to ``salts`` shares of
    each key and the table is repeated for each share, so that a key with very many rows is
    spread over as many tasks; a fixed factor on the small side is the price.
    """
    keys = list(keys)
    held = cut_lineage(small)
    if written_bytes(held) <= most_bytes and held.count() <= most_rows:
        return rows.join(F.broadcast(held), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
