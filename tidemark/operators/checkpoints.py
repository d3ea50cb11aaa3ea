"""Where jobs keep what they write on the way: one folder an application, on storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _own_folder(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir; below the warehouse where that is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder for a table on the way.  Results read from it, so it stays until ``clear``."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table on the way: lineage ends here, and later reads see the same rows in the same files."""
    out = work_folder(rows.sparkSession, name)
    rows.write.parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def ensure(spark: SparkSession) -> None:
    """Set the checkpoint folder only where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_folder(spark, "checkpoints"))


def discard(spark: SparkSession, folder: str) -> None:
    """Delete one table on the way that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> bool:
    """Delete all that this application's queries have written on the way.  Call it once their results are
    written elsewhere: results that are still lazy read from there.  Returns whether there was anything."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
