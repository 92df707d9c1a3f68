"""Materialise an intermediate that several branches of a plan read.

The rows are written once as a parquet table under the shared folder named by
``spark.checkpoint.dir`` (never an executor-local path) and read back: later
branches scan the written table -- with column pruning and filter pushdown,
which an RDD checkpoint does not give -- instead of re-running the lineage, and
a lost executor re-reads files instead of recomputing.

Every table goes to a folder of its own. A DataFrame returned to the caller may
still read it, so nothing is removed behind the caller's back: ``release(spark)``
deletes what this application has materialised, once the results are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskflow.session import scratch_path

_WRITTEN: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared scratch folder, removed by ``release``."""
    path = scratch_path(spark, f"materialized/{name}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> int:
    """Delete every folder this application has materialised; the number deleted."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_folder(spark, path)
    return len(paths)
