"""Session-wide habits: where lineage is cut, and the settings we start with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files.

    The folder is ``spark.checkpoint.dir``; a temporary one is made only where it is unset, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="lernwerk-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``cut`` for long loops: by a table, of whose columns the optimiser knows nothing.

    A checkpoint carries on what was derived of its columns, and over many rounds of ``coalesce`` that grows until planning stands still.
    """
    path = shared(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any store that Spark reads, with all below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder of any store that Spark reads; nothing where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


@contextmanager
def lent(spark: SparkSession) -> Iterator[str]:
    """A new shared path that is deleted when the block ends."""
    path = shared(spark, "lent")
    try:
        yield path
    finally:
        delete(spark, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within the block, the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


#: HotSpot compiles no method of more bytes than this; Spark's own limit lets it run far larger ones uncompiled.
METHOD_BYTES = 8000


def bound_methods(spark: SparkSession) -> SparkSession:
    """Have Spark split generated code that HotSpot would interpret, as wide projections give it: lower the session's limit to ``METHOD_BYTES``.

    A setting that is lower already stays. Gives the session back.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > METHOD_BYTES:
        spark.conf.set(name, str(METHOD_BYTES))
    return spark


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the caller's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
