"""Session settings and lineage cuts."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Rows that a checkpoint's file holds at least, where their number is known.
ROWS_A_FILE = 5_000


def build_session(app: str = "prismill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator expects."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.checkpoint.compress": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_runtime(spark: SparkSession) -> SparkSession:
    """Settings that may change after start-up, for sessions made elsewhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


class NoSharedFolderError(RuntimeError):
    """A cluster session without a folder that driver and executors share."""


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in a local session that has none, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise NoSharedFolderError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="prismill-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage at a reliable checkpoint, so that a lost executor repeats nothing upstream.

    `rows`: about as many rows as `df` has or is computed from. Its files then follow its size, not the number of shuffle
    partitions, with one for each core at least: a file costs requests, and on a local file system processes that set its mode.
    """
    context = df.sparkSession.sparkContext
    if rows is not None:
        df = df.coalesce(max(context.defaultParallelism, math.ceil(rows / ROWS_A_FILE)))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

