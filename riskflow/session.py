"""Session helpers.

Library code never creates its own session; it takes the caller's. These helpers
are for tests, the bench and command-line use.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "riskflow") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only read, never set. Where the setting is absent a local-mode session (tests,
    one machine) gets one temporary folder per application; any other master raises,
    because a machine-local folder is invisible to the other machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not (context.master.startswith("local[") or context.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="riskflow-ckpt-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/riskflow/{name}"
