"""A search index kept up to date: one row (provider, session_id, signature, title, content, last_seen) a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["provider", "session_id"]
#: Days an unseen session stays.
RETENTION = 30


def stale(index: DataFrame, seen: DataFrame) -> DataFrame:
    """Seen sessions that are new or whose signature changed: only their texts need reading."""
    old = index.select(*KEY, F.col("signature").alias("__old"), F.lit(True).alias("__known"))
    return seen.join(old, KEY, "left").filter(F.col("__known").isNull() | ~F.col("signature").eqNullSafe(F.col("__old"))).drop("__old", "__known")


def refresh(index: DataFrame, seen: DataFrame, corpus: DataFrame, now: Column, rebuild: bool = False) -> DataFrame:
    """The index after a scan that saw ``seen`` (key, signature, title); ``corpus`` gives key and content.

    Seen rows get ``now`` as last seen.  A changed session takes its new text;
    where that cannot be read (null or absent) the old row stays and the next
    run tries again.  Unseen rows stay until ``evict``; with ``rebuild`` they
    go and every text is taken anew.  One row a key; repeated keys of ``seen``
    or ``corpus`` count once, by the greatest values.
    """
    seen = seen.groupBy(*KEY).agg(F.max(F.struct("signature", "title")).alias("__s")).select(*KEY, "__s.*")
    if rebuild:
        index = index.limit(0)
    todo = stale(index, seen).select(*KEY)
    text = corpus.join(todo, KEY, "left_semi").groupBy(*KEY).agg(F.max("content").alias("__new"))
    fresh = seen.join(text, KEY, "left").select(*KEY, F.col("signature").alias("__signature"), F.col("title").alias("__title"), "__new", F.lit(True).alias("__seen"))
    both = index.join(fresh, KEY, "full")
    read = F.col("__new").isNotNull()
    take = lambda new, old: F.when(read, F.col(new)).otherwise(F.col(old)).alias(old)
    rows = both.filter(read | F.col("last_seen").isNotNull())
    return rows.select(*KEY, take("__signature", "signature"), take("__title", "title"), take("__new", "content"), F.when(F.col("__seen"), now).otherwise(F.col("last_seen")).alias("last_seen"))


def evict(index: DataFrame, now: Column, days: int = RETENTION) -> DataFrame:
    """Without rows unseen for more than ``days``."""
    return index.filter(F.col("last_seen") >= now - F.make_interval(days=F.lit(days)))


def clear(index: DataFrame, provider: str) -> DataFrame:
    """Without a provider's rows."""
    return index.filter(~F.col("provider").eqNullSafe(F.lit(provider)))


def refresh_counts(index: DataFrame, seen: DataFrame, corpus: DataFrame, samples: int = 3) -> DataFrame:
    """(provider, added, skipped, sample): sessions whose text is taken, those whose text cannot be read, and the first ids of these."""
    todo = stale(index, seen.groupBy(*KEY).agg(F.max("signature").alias("signature"))).select(*KEY)
    read = corpus.groupBy(*KEY).agg(F.max("content").isNotNull().alias("read"))
    rows = todo.join(read, KEY, "left").withColumn("read", F.coalesce("read", F.lit(False)))
    n = F.row_number().over(Window.partitionBy("provider", "read").orderBy("session_id"))
    few = F.when(~F.col("read") & (F.col("n") <= samples), F.col("session_id"))
    return rows.withColumn("n", n).groupBy("provider").agg(F.count_if("read").alias("added"), F.count_if(~F.col("read")).alias("skipped"), F.array_sort(F.collect_list(few)).alias("sample"))
