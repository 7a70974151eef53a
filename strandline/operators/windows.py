"""Id windows: shards are half-open, catch-up windows open at the baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(num: Column, after: Column | int, before: Column | int, after_inclusive: Column | bool = True) -> Column:
    after, before = (x if isinstance(x, Column) else F.lit(x) for x in (after, before))
    if isinstance(after_inclusive, bool):
        lower = num >= after if after_inclusive else num > after
    else:
        lower = F.when(after_inclusive, num >= after).otherwise(num > after)
    return lower & (num < before)


def page_before(messages: DataFrame, before: int, limit: int = 100, num: str = "id_num") -> DataFrame:
    """The newest messages below an id: what one page would hold."""
    return messages.where(F.col(num) < before).orderBy(F.desc(num)).limit(limit)


def sweep_span(segments: DataFrame, *by: str) -> DataFrame:
    """One window over pending segments (after, before, cursor as numbers, after_inclusive): least lower bound with its kind, greatest upper bound, where a cursor stands for the upper bound it has reached."""
    lower = F.min_by("after_inclusive", F.struct("after", "index"))
    return segments.groupBy(*by).agg(F.min("after").alias("after"), F.max(F.coalesce("cursor", "before")).alias("before"), lower.alias("after_inclusive"))


def coverage_gaps(intervals: DataFrame, channel: str = "channel_id") -> DataFrame:
    """(channel, after, before) of what no interval [after, before) of a channel covers between its first and last."""
    w = Window.partitionBy(channel).orderBy("after", "before")
    reached = F.max("before").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("reached", reached).where(F.col("after") > F.col("reached")).select(channel, F.col("reached").alias("after"), F.col("after").alias("before"))
