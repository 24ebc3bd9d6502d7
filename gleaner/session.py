"""Session defaults.  On a cluster the submitted configuration wins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(app: str = "gleaner", cores: int | str | None = None) -> SparkSession:
    """A session for local runs; an active or cluster session is used as it is."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Lists of keys reach the Parquet reader value by value, not as a range.
        .config("spark.sql.parquet.pushdown.inFilterThreshold", "1000")
        .config("spark.driver.memory", "12g")
        # Building a plan need not record the Python line of every column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # One folder per application: later calls find it set.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df):
    """Cut the lineage through reliable storage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()
