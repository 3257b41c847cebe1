"""Delimited tables in and out, and several sources brought to one row shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str, optional: bool = False) -> DataFrame:
    """Typed scan of a tab-separated file with a header; a blank cell is null.

    An optional source whose path Spark does not find reads as an empty table of the
    same schema; anything else that keeps it from being read is an error.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = (
        spark.read.schema(schema)
        .option("sep", "\t").option("header", True).option("nullValue", "").option("encoding", "UTF-8")
        .option("enforceSchema", False).option("quote", '"').option("escape", '"')
    )
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if not optional or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_rows(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> int:
    """Tab-separated sink with a fixed column order; returns the rows written.

    An empty table is an error, as it has no first row to take a header from.
    The rows are counted while they are written, so the input runs once.
    """
    from pyspark.sql import Observation

    seen = Observation()
    out = df.select(*(columns or df.columns)).observe(seen, F.count(F.lit(1)).alias("rows"))
    (
        out.write.option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "")
        .option("quote", '"').option("escape", '"').csv(path)
    )
    rows = seen.get["rows"]
    if not rows:
        raise ValueError(f"no rows to write to {path}")
    return rows


def clean_field(value: Column) -> Column:
    """Tab and newline runs inside a value become one space."""
    return F.trim(F.regexp_replace(value, r"[\t\r\n]+", " "))


def write_clean_rows(df: DataFrame, path: str, columns: Sequence[str]) -> int:
    """Sanitising sink: every string column is cleaned before it is written."""
    kinds = dict(df.dtypes)
    picked = [clean_field(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in columns]
    return write_rows(df.select(*picked), path)


def read_summed_csv(spark: SparkSession, path: str, schema: str, keys: Sequence[str],
                    sums: Mapping[str, Sequence[str]]) -> DataFrame:
    """Comma-separated scan (a byte-order mark is ignored) with columns added up in groups.

    A row whose sums are all zero is dropped.
    """
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    return summed_columns(raw, keys, sums)


def summed_columns(raw: DataFrame, keys: Sequence[str], sums: Mapping[str, Sequence[str]]) -> DataFrame:
    added = []
    for name, parts in sums.items():
        total = F.coalesce(F.col(parts[0]), F.lit(0))
        for part in parts[1:]:
            total = total + F.coalesce(F.col(part), F.lit(0))
        added.append(total.alias(name))
    live = F.lit(False)
    for name in sums:
        live = live | (F.col(name) != 0)
    return raw.select(*keys, *added).where(live)


def keyed_by_file(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Key columns taken from the name of the file each row was read from."""
    path = F.url_decode(F.col("_metadata.file_path"))
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def union_sources(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]], shape: Sequence[str]) -> DataFrame:
    """Bring sources with their own column names to one row shape and union them."""
    out = None
    for df, columns in parts:
        have = {c: F.col(f"`{c}`") for c in df.columns} | dict(columns)
        rows = df.select(*[have[c].alias(c) for c in shape if c in have])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def content_manifest(pages: DataFrame, url: str, content: str) -> DataFrame:
    """Stable key from the URL's hash, content hash, size and status of each document."""
    body = F.col(content)
    return pages.select(
        url,
        F.substring(F.sha2(F.col(url), 256), 1, 24).alias("filename"),
        F.when(body.isNull(), "missing").otherwise("ok").alias("status"),
        F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint").alias("bytes"),
        F.when(body.isNotNull(), F.sha2(body, 256)).alias("sha256"),
    )


def star_export(hist: DataFrame, subject: str, value: str, weight: str, formulas: Mapping[str, Sequence[str]],
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One histogram table as three: subjects, formula members and totals.

    A formula naming a subject that the histogram lacks fails the job.
    """
    subjects = hist.groupBy(subject, value).agg(F.sum(weight).alias("n"))
    rows = [(name, part) for name, parts in formulas.items() for part in parts]
    members = hist.sparkSession.createDataFrame(rows, f"formula string, {subject} string")
    known = subjects.select(subject).distinct().withColumn("_known", F.lit(True))
    text = F.concat(F.lit("no histogram for subject "), F.col(subject))
    checked = members.join(known, subject, "left").select(
        "formula", F.when(F.col("_known"), F.col(subject)).otherwise(F.raise_error(text).cast("string")).alias(subject)
    )
    totals = subjects.groupBy(subject).agg(F.sum("n").alias("total"))
    return subjects, checked, totals


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as the session has cores.

    For work that is heavy next to the bytes it reads: a file of one row group is one
    partition, whatever the split size. Frames that have enough partitions are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
