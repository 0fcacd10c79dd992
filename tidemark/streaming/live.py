"""Live counts of a growing archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def message_counts(messages: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Messages by provider and window of a stream; rows later than ``late`` are left out."""
    return messages.withWatermark(at, late).groupBy(F.window(at, width), "provider").agg(F.count(F.lit(1)).alias("messages"))
