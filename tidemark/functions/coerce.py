"""Tolerant conversions: bad input gives the default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds up to the year 3000.
EPOCH_LIMIT = 32_503_680_000


def safe_int(text: Column, default: int = 0) -> Column:
    """Whole number in a trimmed string, underscores between digits allowed."""
    tidy = F.trim(text)
    plain = F.when(F.regexp_like(tidy, F.lit(r"^[+-]?\d+(_\d+)*$")), F.regexp_replace(tidy, "_", ""))
    return F.coalesce(plain.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(text: Column, default: float = 0.0) -> Column:
    """Finite number in a string."""
    x = F.trim(text).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def epoch(value: Column) -> Column:
    """Timestamp of a number: above 1e10 milliseconds, else seconds; null out of range."""
    seconds = F.when(value > 10_000_000_000, value / 1000).otherwise(value)
    return F.when(F.abs(seconds) <= EPOCH_LIMIT, F.timestamp_seconds(seconds))


def iso_ms(text: Column) -> Column:
    """Milliseconds of an ISO timestamp; 0 for anything else."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0).cast("bigint"))
