"""Tables written in between: lineage is cut, and the files outlive executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a session within one process may do without: it uses its warehouse's."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have an existing folder removed when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    removed_at_end(spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back. The folder is removed when the driver's JVM ends, or by `discard`."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_end(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def written_bytes(written: DataFrame) -> int:
    """Size of the files of a table that `materialize` wrote."""
    spark = written.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(written.written_at)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def discard(written: DataFrame) -> None:
    """Remove a table that `materialize` wrote and that nothing reads any more, so long loops don't fill the shared folder."""
    spark = written.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(written.written_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
