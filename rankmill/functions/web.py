"""URLs and links as Column expressions."""

from __future__ import annotations

import html
from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes that mark a document.
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".odt", ".xls", ".xlsx", ".ods")

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def normalized(url: Column) -> Column:
    """Lower-case scheme, a path of at least /, the query and no fragment; https where none is given."""
    text = F.trim(F.coalesce(url, F.lit("")))
    text = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    path = F.regexp_extract(text, _PARTS, 3)
    made = F.concat(F.lower(F.regexp_extract(text, _PARTS, 1)), F.lit("://"), F.regexp_extract(text, _PARTS, 2),
                    F.when(path == "", "/").otherwise(path), F.regexp_extract(text, _PARTS, 4))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(made)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def variants(url: Column) -> Column:
    """The secure form first where the URL is plain http, then the URL."""
    secure = F.regexp_replace(url, "(?i)^http://", "https://")
    return F.when(F.coalesce(url, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(secure, url)))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def is_document(url: Column, name: Column, suffixes: Sequence[str] = DOCUMENT_SUFFIXES) -> Column:
    """Whether the path or the label ends in a document suffix."""
    end = "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    return F.lower(path_of(url)).rlike(end) | F.coalesce(F.lower(name).rlike(end), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(b) or pd.isna(k) else urljoin(b, k) for b, k in zip(base, link)], dtype=object)


def unescaped(text: Column) -> Column:
    """All character references back to their characters."""
    return F.when(F.contains(text, F.lit("&")), _decoded(text)).otherwise(text)


def absolute(link: Column, site: Column) -> Column:
    """A link resolved against its site or page, dot segments, queries and fragments included."""
    return _joined(site, unescaped(F.trim(link)))
