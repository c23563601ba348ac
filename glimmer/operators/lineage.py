"""Cutting the lineage of iterations, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and read back: a step of an iteration that reads its input several times would otherwise
    double the plan. The folder is spark.checkpoint.dir; one of our own is made only on one machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex))
    return df.checkpoint()
