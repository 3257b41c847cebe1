"""Words as the operators of this package count them: runs of ``[^\\x20\\x09-\\x0D]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


def lowered(text: str | Column) -> Column:
    """The text with A-Z, and nothing else, in lower case; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column, F.lit("")), UPPER, UPPER.lower())


def word_count(text: str | Column) -> Column:
    """Number of words; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("bigint")


def split_words(text: str | None) -> list[bytes]:
    """The words as UTF-8; ``bytes.split`` parts at exactly the six white characters above."""
    return (text or "").encode().split()


def lower_words(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case; ``bytes.lower`` touches no other letter."""
    return (text or "").encode().lower().split()
