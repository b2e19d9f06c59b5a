"""Extension: the trailing signal counters as a stream (windows of days, late events up to a watermark).

The profile format carries these counters already aggregated; this keeps them current from an event stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


KINDS = ("view", "click", "purchase")


def _counts(days: int) -> list[Column]:
    return [*(F.sum((F.col("event_type") == k).cast("long")).alias(f"{k}_{days}d") for k in KINDS), F.count("*").alias(f"all_{days}d")]


def counts_before(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """user_id and a count of each kind of event in the `days` days before a moment."""
    end = F.to_timestamp(F.lit(as_of))
    return events.where((F.col("ts") >= end - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < end)).groupBy("user_id").agg(*_counts(days))


def trailing_counts(events: DataFrame, days: int = 30, late: str = "2 days") -> DataFrame:
    """user_id, window, and a count of each kind of event in every window of `days` days that slides by a day."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{days} days", "1 day")).agg(*_counts(days))
