"""Session helpers: sane defaults and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in ``spark.checkpoint.dir``.

    A local session without the setting, as in tests, gets a folder of its own. On a
    cluster no folder can be guessed that all executors see, so its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = tempfile.mkdtemp(prefix="rankmill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Survives the loss of any executor, unlike a local checkpoint, and costs one
    write; used between the rounds of the iterative operators.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._step_path = path
    return made


def release(*steps: DataFrame) -> None:
    """Delete the folders of steps made by ``cut_lineage`` that nothing will read again.

    For the rounds of an operator, once what follows from a step is itself written. Frames
    from elsewhere are left alone.
    """
    for step in steps:
        path = getattr(step, "_step_path", None) if "_step_path" in step.__dict__ else None
        if path is not None:
            place = step.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def written_bytes(step: DataFrame) -> int:
    """Size of the files of a step made by ``cut_lineage``."""
    place = step.sparkSession._jvm.org.apache.hadoop.fs.Path(step._step_path)
    return int(place.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).getContentSummary(place).getLength())
