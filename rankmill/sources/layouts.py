"""Sheets of several layouts, told by their names and read in one scan.

Sheets come as rows (``name``, ``row``, ``cells``): the sheet's name, the place of the row
in it and its cells as text. Each row gets its layout by name; what a header row says is
carried down its sheet; then one ``inline`` of the array that the row's layout makes gives
the long form, so that all sheets are one scan and one walk, whatever their layouts.

Long form: ``name``, ``layout``, ``subject``, ``label``, ``score``, ``count``, ``share``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import number, range_midpoint
from ..operators.ordered import carried

RECORD = "struct<subject: string, label: string, score: double, count: double, share: double>"


def cell(at: int | Column) -> Column:
    """A row's cell by place from 0, trimmed; empty where the row is too short."""
    return F.trim(F.coalesce(F.get("cells", F.lit(at) if isinstance(at, int) else at), F.lit("")))


def record(subject=None, label=None, score=None, count=None, share=None) -> Column:
    text, amount = F.lit(None).cast("string"), F.lit(None).cast("double")
    return F.struct(
        (text if subject is None else subject).alias("subject"), (text if label is None else label).alias("label"),
        (amount if score is None else score).alias("score"), (amount if count is None else count).alias("count"),
        (amount if share is None else share).alias("share"))


@dataclass(frozen=True)
class Layout:
    """How one kind of sheet reads.

    ``named`` is a pattern of sheet names. ``header`` tells the rows that hold for those
    below them, as a value or null, and ``records`` makes an array of records of a row, null
    or empty for a row that holds none; it may use ``header()``.
    """

    named: str
    records: Column
    header: Column | None = None


def header() -> Column:
    """The cells of the last header row above this row."""
    return F.col("_header")


def grades(marker: str, named: str) -> Layout:
    """A marked header row names subjects, each above its count column; scores stand in the first column."""
    score = number(cell(0))
    places = F.filter(F.sequence(F.lit(1), F.size(header()) - 1), lambda i: F.trim(F.get(header(), i)) != "")
    each = F.transform(places, lambda i: record(F.trim(F.get(header(), i)), score=score, count=number(cell(i))))
    found = F.filter(each, lambda r: r["count"].isNotNull())
    return Layout(named, F.when((F.size(header()) > 1) & score.isNotNull(), found), F.when(cell(0) == marker, F.col("cells")))


def marks(named: str, halves: Sequence[int] = (0, 7)) -> Layout:
    """A subject stands alone on a row; below it score bands and counts in halves side by side."""
    alone = (cell(0) != "") & (cell(1) == "") & number(cell(0)).isNull()
    each = F.array(*[record(F.trim(F.get(header(), 0)), score=range_midpoint(cell(at)), count=number(cell(at + 1))) for at in halves])
    found = F.filter(each, lambda r: r["score"].isNotNull() & r["count"].isNotNull())
    return Layout(named, F.when(header().isNotNull() & ~alone, found), F.when(alone, F.col("cells")))


def totals(named: str, subject: str, most: float) -> Layout:
    """A total and its count in the first two columns of every numeric row."""
    score, count = number(cell(0)), number(cell(1))
    held = score.between(0, most) & count.isNotNull()
    return Layout(named, F.when(held, F.array(record(F.lit(subject), score=score, count=count))))


def categories(named: str, pattern: str) -> Layout:
    """A category, its count and its percentage."""
    held = cell(0).rlike(pattern) & (F.size("cells") >= 3)
    return Layout(named, F.when(held, F.array(record(label=cell(0), count=number(cell(1)), share=number(cell(2))))))


def levels(named: str, pattern: str, names: Sequence[str], first: int = 3) -> Layout:
    """Inside each category, a count, a cumulated count and a percentage for each level."""
    held = cell(0).rlike(pattern) & (F.size("cells") >= first + 3 * len(names))
    each = [record(F.lit(name), cell(0), count=number(cell(first + 3 * i)), share=number(cell(first + 3 * i + 2))) for i, name in enumerate(names)]
    return Layout(named, F.when(held, F.array(*each)))


def layout_of(name: Column, layouts: Mapping[str, Layout]) -> Column:
    """The first layout whose pattern the name matches; null for a name that none knows."""
    found = F.lit(None).cast("string")
    for key, layout in reversed(layouts.items()):
        found = F.when(name.rlike(layout.named), F.lit(key)).otherwise(found)
    return found


def unknown_sheets(sheets: DataFrame, layouts: Mapping[str, Layout]) -> DataFrame:
    """Names that no layout knows, with their rows."""
    return sheets.where(layout_of(F.col("name"), layouts).isNull()).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))


def read_sheets(sheets: DataFrame, layouts: Mapping[str, Layout], **options) -> DataFrame:
    """The long form of all sheets of known layouts."""
    rows = sheets.select("name", "row", "cells", layout_of(F.col("name"), layouts).alias("layout")).where("layout is not null")
    head = F.lit(None).cast("array<string>")
    made = F.lit(None).cast(f"array<{RECORD}>")
    for key, layout in layouts.items():
        here = F.col("layout") == key
        made = F.when(here, layout.records).otherwise(made)
        if layout.header is not None:
            head = F.when(here, layout.header).otherwise(head)
    # A header holds for the rows below it, so a row reads what stands strictly before it.
    down = carried(rows.withColumn("_own", head), ["name"], ["row"], previous={"_header": "_own"}, **options)
    return down.where("_own is null").select("name", "layout", F.inline(made))


def sheet_rows(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """Delimited text files in folders named after their sheets; the first cell is the row's place."""
    lines = spark.read.text(path).withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))
    parts = F.split("value", delimiter)
    return lines.select("name", parts[0].cast("bigint").alias("row"), F.slice(parts, 2, F.size(parts)).alias("cells"))
