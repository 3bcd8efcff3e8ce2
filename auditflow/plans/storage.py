"""Tables, and intermediate results in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = getattr(spark, "_auditflow_dir", None) or "file://" + tempfile.mkdtemp(prefix="auditflow-")
        spark._auditflow_dir = found
    return found.rstrip("/")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all cores: a small file may hold the rows of hours of work, and is read by one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Spark judges by the size of the files below, and what Python makes of them, or packed columns
    hold, can be a hundred times that: the driver would gather it all.
    """
    return df.hint("merge")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Later steps depend on the files alone, so a lost executor never forces the work before
    them to be done again, and what is used twice is computed once.  The files go when the
    application ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/auditflow-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the files goes when they are written
    try:
        df.write.parquet(where)
    finally:
        spark.conf.set(_CLEANUP, was)
    path, files = _path(spark, where)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._auditflow_files = where
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized df that nothing reads any more; any other df is left alone."""
    where = getattr(df, "_auditflow_files", None)
    if where:
        path, files = _path(df.sparkSession, where)
        files.delete(path, True)


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
