"""Session settings and the folder a job may write its working tables to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, app: str = "vitrine") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass in the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """A new path below the shared folder named by the session.

    Only a local session may fall back to a folder of this machine.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        # Gone when the process ends.
        kept = tempfile.TemporaryDirectory(prefix="vitrine-", ignore_cleanup_errors=True)
        atexit.register(kept.cleanup)
        base = kept.name
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vitrine-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The same rows from a table below the shared folder: computed once, of known size."""
    path = work_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
