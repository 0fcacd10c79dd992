"""Lineage cuts of iterative operators: tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; the setting is filled in only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/steps/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def settle(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written to a new folder and read back."""
    path = place(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
