"""Session defaults: UTC, adaptive execution, partition counts that follow the cores."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "brevispark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tested under; anything already set by the cluster wins."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with the tables that read them
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("BREVI_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder that all machines see (spark.checkpoint.dir). Only a local session without the setting gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not (sc.master + "[").startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="brevispark-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Rows that stay as they are when they are read again: a checkpoint in the scratch folder."""
    scratch(df.sparkSession)
    return df.checkpoint()
