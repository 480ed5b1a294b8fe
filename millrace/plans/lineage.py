"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed and written to the checkpoint folder.

    The folder is the session's own, else the one named by spark.checkpoint.dir; only where neither
    is set and the session runs on one machine (as in tests) a temporary one is made. On a cluster a folder
    must be named: the executors do not share a machine's own.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: grows with the data and the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
