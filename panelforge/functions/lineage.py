"""Cutting lineage where a small table is used many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a table that may be broadcast, at most, where nothing else bounds them.
FEW = 100_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which are counted here; else a join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settle(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the session's spark.checkpoint.dir; a temporary folder only where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="panelforge-ckpt-"))
    return df.checkpoint(eager=True)
