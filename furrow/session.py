"""The session the engine expects, the folder its executors share, and tables computed once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "furrow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for checkpoints and for tables that a job writes and reads back.

    It is ``spark.checkpoint.dir`` of the session. Only a local session without one gets a temporary
    folder; on a cluster that would be one machine's own, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="furrow-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed now and read back from the shared folder: for a small table that a plan uses many times."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
