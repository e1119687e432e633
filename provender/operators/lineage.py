"""Cutting a plan's lineage by writing a frame down."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to spark.checkpoint.dir, which must be set unless executors are on this machine."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="provender-"))
    return df.checkpoint()
