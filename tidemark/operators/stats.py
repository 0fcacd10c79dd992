"""Statistics that keep unknown counts apart from zero, and time groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_and_unknown(rows: DataFrame, group: str, count: str, total: str = "(all)") -> DataFrame:
    """Rows, known sum and unknown rows for each group and in all."""
    rolled = rows.rollup(group).agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(count), F.lit(0)).cast("long").alias("known_messages"), F.count_if(F.col(count).isNull()).alias("unknown_sessions"), F.grouping(group).alias("__all"))
    return rolled.withColumn(group, F.when(F.col("__all") == 1, total).otherwise(F.col(group))).drop("__all")


def time_group(day: Column, today: Column) -> Column:
    age = F.date_diff(today, day)
    return F.when(age <= 0, "today").when(age == 1, "yesterday").when(age <= 7, "this week").when(age <= 30, "this month").otherwise("older")


def first_known(rows: DataFrame, key: str, order: str, value: Column, prefix: int, name: str) -> DataFrame:
    """First value that is not null among the first ``prefix`` rows of each key."""
    from pyspark.sql import Window

    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__r") <= prefix)
    return ranked.groupBy(key).agg(F.min_by(value, F.when(value.isNotNull(), F.col("__r"))).alias(name))
