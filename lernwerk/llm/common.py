"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a temporary folder takes its place.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that a loop writes."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of ``scratch`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Texts go to Python in batches of so many bytes at most; one longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def bound_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """Bound what a Python worker holds at once: lower the session's Arrow batch size to ``most`` bytes.

    A setting that is lower already stays. Gives ``df`` back.
    """
    session, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if session._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(session.conf.get(name)) > most:
        session.conf.set(name, str(most))
    return df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` does just that on pure ASCII, and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def ascii_lower_sql(c: str) -> str:
    """The same in DuckDB."""
    return f"translate({c}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def word_count(c: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space characters."""
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
