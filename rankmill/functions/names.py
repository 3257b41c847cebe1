"""Name normalising, aliases, tokenising and key fallback as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Brackets that open a note, head nouns a name ends at, the
# qualifier that may follow one, and a spelling folded in grouping keys.
NOTE_OPENERS = "(（【"
HEADS = "系科班程院"
QUALIFIER = "組"
FOLDED = ("學系", "系")

# Subject tokens and what their short forms stand for.
SUBJECT_TOKENS = ("數學A", "數學B", "國文", "英文", "數學", "社會", "自然", "英聽", "數A", "數B", "國", "英", "數", "社", "自")
SUBJECT_FULL = {"數A": "數學A", "數B": "數學B", "國": "國文", "英": "英文", "數": "數學", "社": "社會", "自": "自然"}


def base_name(name: Column, openers: str = NOTE_OPENERS, heads: str = HEADS, qualifier: str = QUALIFIER) -> Column:
    """Name up to its first bracket, and up to its last head noun where a qualifier follows."""
    bare = F.trim(F.regexp_extract(name, f"^([^{re.escape(openers)}]*)", 1))
    head = F.regexp_extract(bare, f"^(.*[{heads}]).+{qualifier}$", 1)
    return F.when(head != "", head).otherwise(bare)


def grouping_key(name: Column, folded: tuple[str, str] = FOLDED, **parts) -> Column:
    """Key under which two spellings of one name meet."""
    return F.replace(base_name(name, **parts), F.lit(folded[0]), F.lit(folded[1]))


def mapped(value: Column, pairs: Mapping[str, str]) -> Column:
    """Value of a short literal map, null where absent."""
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.element_at(F.create_map(*entries), value) if entries else F.lit(None).cast("string")


def renamed(value: Column, pairs: Mapping[str, str]) -> Column:
    """Successor of a name, or the name itself."""
    return F.coalesce(mapped(value, pairs), value)


def predecessors(value: Column, pairs: Mapping[str, str]) -> Column:
    """Sorted former names of a current one, as text."""
    former: dict[str, list[str]] = {}
    for old, new in pairs.items():
        former.setdefault(new, []).append(old)
    return F.coalesce(mapped(value, {new: " | ".join(sorted(old)) for new, old in former.items()}), F.lit(""))


def without_suffix(value: Column, suffixes: Sequence[str]) -> Column:
    return F.trim(F.regexp_replace(value, "(" + "|".join(re.escape(s) for s in suffixes) + ")$", ""))


def without_prefix(value: Column, prefixes: Sequence[str]) -> Column:
    return F.trim(F.regexp_replace(value, "^(" + "|".join(re.escape(s) for s in prefixes) + ")", ""))


def tokens(value: Column, vocabulary: Sequence[str] = SUBJECT_TOKENS, full: Mapping[str, str] = SUBJECT_FULL) -> Column:
    """Split a label into known tokens, longest first; null unless all of it is known.

    Tokens never partly apply: one unknown character rejects the whole label.
    """
    ordered = sorted(vocabulary, key=len, reverse=True)
    choice = "(?:" + "|".join(re.escape(t) for t in ordered) + ")"
    found = F.regexp_extract_all(value, F.lit(f"({choice})"), F.lit(1))
    whole = F.array_join(found, "") == value
    return F.when((value != "") & whole, F.transform(found, lambda t: renamed(t, full)))


def cjk_only(value: Column) -> Column:
    """Han characters of a text, without punctuation and Latin debris."""
    return F.regexp_replace(value, "[^一-鿿]", "")


@F.pandas_udf(T.StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """NFKC of a text; Spark has no built-in for it."""
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def folded_space(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def folded(value: Column) -> Column:
    """NFKC and single spaces, as used before any text is matched."""
    return folded_space(compatibility_form(F.coalesce(value, F.lit(""))))


def rejoined(value: Column) -> Column:
    """A label wrapped over lines, without the breaks inside it."""
    return F.regexp_replace(value, r"\s*\n\s*", "")


def override(df: DataFrame, repairs: DataFrame, keys: Sequence[str], name: str, better: str) -> DataFrame:
    """Take the repaired name where the lookup has one, marking rows it changed."""
    out = df.join(repairs.select(*keys, F.col(better).alias("_better")), list(keys), "left")
    changed = F.col("_better").isNotNull() & (F.col("_better") != F.col(name))
    return out.withColumn("repaired", F.coalesce(changed, F.lit(False))).withColumn(
        name, F.coalesce("_better", name)).drop("_better")


def first_known(df: DataFrame, known: DataFrame, name: str, candidates: Sequence[str], default: str | None = None,
                out: str = "name") -> DataFrame:
    """First candidate column whose value is in the known set."""
    known = known.select(F.col(name).alias("_known")).distinct()
    picked = []
    for i, candidate in enumerate(candidates):
        side = known.select(F.col("_known").alias(f"_k{i}"))
        df = df.join(side, df[candidate] == side[f"_k{i}"], "left")
        picked.append(F.col(f"_k{i}"))
    if default is not None:
        picked.append(F.lit(default))
    return df.withColumn(out, F.coalesce(*picked)).drop(*[f"_k{i}" for i in range(len(candidates))])


def split_at_head(text: Column, heads: Sequence[str], carried_head: Column) -> tuple[Column, Column]:
    """Split a collided field after its first head suffix; without one the carried head stands."""
    pattern = "^(.*?(?:" + "|".join(re.escape(h) for h in heads) + "))(.*)$"
    head, tail = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(head != "", head).otherwise(carried_head), F.when(head != "", F.trim(tail)).otherwise(text)


def unwrapped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, line: str, wrapped: Sequence[str],
              endings: Sequence[str], **options) -> DataFrame:
    """Repair names that were cut at a line end: a name that ends in ``wrapped`` goes on in a following line.

    The line that counts is the next one with text on it; if that is a single word with one
    of the ``endings`` it is the name, else the name stays.
    """
    from ..operators.ordered import carried

    text = F.trim(F.coalesce(line, F.lit("")))
    near = carried(rows.withColumn("_line", F.when(text != "", text)), keys, order, following={"_next": "_line"}, **options)
    ends = lambda value, words: F.coalesce(value.rlike("(?:" + "|".join(re.escape(w) for w in words) + ")$"), F.lit(False))
    goes_on = ends(F.col(name), wrapped) & ~F.coalesce(F.col("_next").rlike(r"\s"), F.lit(False)) & ends(F.col("_next"), endings)
    return near.withColumn(name, F.when(goes_on, F.col("_next")).otherwise(F.col(name))).drop("_line", "_next")


def part_label(part: Column, tail: Column, common: str, noise: str) -> Column:
    """Name of a part's item: the tail alone in the common part, else the part without ``noise`` and the tail."""
    return F.when(part == common, tail).otherwise(F.concat(F.replace(part, F.lit(noise), F.lit("")), F.lit("-"), tail))
