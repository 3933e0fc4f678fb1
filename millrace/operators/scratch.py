"""Lineage cut in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed and kept in the folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(found)
    return df.checkpoint()


def staged(df: DataFrame, folder: str) -> DataFrame:
    """``df``, written as a new table under a shared folder and read back: for rows that are read several times, a few columns or rows at a time."""
    path = f"{folder}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
