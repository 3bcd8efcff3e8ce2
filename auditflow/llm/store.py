"""Tables and shared intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Later steps depend on the files alone, so a lost executor never forces the work before
    them to be done again, and what is used twice is computed once.  The files go when the
    application ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/auditflow-{uuid.uuid4().hex}"
    df.write.parquet(where)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    kept = spark.read.schema(df.schema).parquet(where)
    kept._materialized_at = where
    return kept


def discard(df: DataFrame) -> None:
    """Remove the files of a materialize()d table that nothing reads any more, before the application ends."""
    where = getattr(df, "_materialized_at", None)
    if where:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
