"""Incremental sinks that replace what one source gave, behind a commit table.

A write puts the rows of its keys into a new version folder and only then appends one row a
key to the manifest: key, version, rows and a content hash. Readers go through the manifest,
so that a write that dies leaves nothing to be seen, a key is replaced as a whole, and a
source whose content is already held is told by its hash and skipped. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: rows of one file.
ROWS_A_FILE = 1_000_000
MANIFEST = "key string, version string, rows bigint, content string, turn bigint"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """All commits so far, none where nothing was ever written."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The last commit of each key."""
    latest = _manifest(spark, path).groupBy("key").agg(F.max_by(F.struct("version", "rows", "content", "turn"), "turn").alias("c"))
    return latest.select("key", "c.*")


def content(df: DataFrame, key: str) -> DataFrame:
    """(``key``, ``rows``, ``content``): a hash of each key's rows, whatever their order."""
    columns = sorted(c for c in df.columns if c != key)
    row = F.xxhash64(*[F.col(c) for c in columns]) if columns else F.lit(0).cast("bigint")
    other = F.xxhash64(F.lit("second"), *[F.col(c) for c in columns])
    sums = [F.sum(F.pmod(x, F.lit(1 << 31))).cast("string") for x in (row, other)]
    hashed = F.concat_ws(":", F.bit_xor(row).cast("string"), F.bit_xor(other).cast("string"), *sums)
    return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("rows"), hashed.alias("content"))


def write_version(df: DataFrame, path: str, key: str, rows_a_file: int = ROWS_A_FILE) -> tuple[str, DataFrame]:
    """Write the rows under a version that no reader sees yet; returns it and what to commit.

    A key may be a large part of the data: a hash of the row deals it to as many tasks as it
    needs for files of about ``rows_a_file`` rows, and a small key is one file.
    """
    version = uuid.uuid4().hex
    sizes = content(df, key)
    files = F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_a_file))
    shares = sizes.select("key", files.alias("_files"))
    named = df.withColumn("_key", F.col(key).cast("string"))
    dealt = named.join(shares, F.col("_key").eqNullSafe(F.col("key"))).drop("key") if key != "key" else named.join(
        shares.withColumnRenamed("key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).drop("_k")
    dealt = dealt.withColumn("_share", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    out = dealt.repartition("_key", "_share").drop("_files", "_share")
    out.write.option("maxRecordsPerFile", rows_a_file).partitionBy("_key").parquet(f"{path}/data/{version}")
    return version, sizes


def commit(spark: SparkSession, path: str, version: str, sizes: DataFrame) -> None:
    """Make a version the one that readers see, by one file that appears as a whole."""
    last = _manifest(spark, path).agg(F.max("turn")).first()[0]
    rows = sizes.select("key", F.lit(version).alias("version"), "rows", "content", F.lit(0 if last is None else last + 1).cast("bigint").alias("turn"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def replace_by_key(df: DataFrame, path: str, key: str, rows_a_file: int = ROWS_A_FILE) -> None:
    """Replace the rows of the source keys that ``df`` holds and leave the others alone."""
    version, sizes = write_version(df, path, key, rows_a_file)
    commit(df.sparkSession, path, version, sizes)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last commit of every key; empty versions and dead writes are not read."""
    live = committed(spark, path)
    versions = [r["version"] for r in live.select("version").distinct().collect()]
    if not versions:
        raise ValueError(f"nothing is committed in {path}")
    place = F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)
    held = spark.read.parquet(f"{path}/data/{versions[0]}").schema
    # The key stays text: 007 is not 7.
    schema = StructType([f for f in held if f.name != "_key"]).add("_key", "string")
    parts = [spark.read.schema(schema).parquet(f"{path}/data/{v}").withColumn("_version", place) for v in versions]
    data = reduce(DataFrame.unionByName, parts)
    keep = live.select(F.col("key").alias("_k"), F.col("version").alias("_v"))
    return data.join(keep, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_version") == F.col("_v")), "left_semi").drop("_key", "_version")


def pending(df: DataFrame, spark: SparkSession, path: str, key: str, refresh: bool = False, by_content: bool = False) -> DataFrame:
    """Rows of keys that the sink does not hold, or holds with other content; all of them on a refresh."""
    if refresh:
        return df
    held = committed(spark, path)
    if by_content:
        held = held.join(content(df, key), ["key", "rows", "content"])
    held = held.select(F.col("key").alias("_done"))
    return df.join(held, df[key].cast("string").eqNullSafe(held["_done"]), "left_anti")
