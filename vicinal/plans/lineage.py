"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read again; one of our own is set only in local mode where there is none, as in tests.

    A table read again has the sizes that it has, and none of the constraints
    that a checkpoint inherits from the plan before it: over the rounds of an
    iteration, these make planning slower and slower.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="vicinal-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
