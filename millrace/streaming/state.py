"""Streams by built-in operators: request windows, rate limits, first events of a window. Keyed states are in ordered.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_windows(events: DataFrame, ts: str, endpoint: str, latency: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """STR-01, STR-07: requests and latency of each endpoint in closed windows; rows later than the watermark are dropped."""
    stats = events.withWatermark(ts, late).groupBy(F.window(ts, width), endpoint).agg(F.count("*").alias("n"), F.sum(latency).alias("total"), F.max(latency).alias("most"))
    return stats.select(F.col("window.start").alias("start"), endpoint, "n", F.round(F.col("total"), 4).alias("total"), "most")


def over_limit(events: DataFrame, ts: str, client: str, limit: int, width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """STR-05: closed windows in which a client made more requests than the limit."""
    n = events.withWatermark(ts, late).groupBy(F.window(ts, width), client).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > limit).select(F.col("window.start").alias("start"), client, "n")


def once(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """STR-08: each key once for each window that it has events in, whichever comes first; the watermark clears windows from state."""
    seen = events.withWatermark(ts, late).select(F.window(ts, width).alias("window"), key).dropDuplicates(["window", key])
    return seen.select(F.col("window.start").alias("start"), key)


def latest_states(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """STR-02, STR-03: the last value of each key."""
    return log.groupBy(key).agg(F.max(F.struct(order, value)).alias("last")).select(key, F.col("last")[order].alias(order), F.col("last")[value].alias(value))


def cached(log: DataFrame, key: str, order: str, value: str, as_of: Column, days: int = 7) -> DataFrame:
    """STR-09: what the cache holds of each key: its last value, unless that is null (an empty result takes the entry out) or past its time."""
    last = latest_states(log.where(F.col(order) <= as_of), key, order, value)
    return last.where(F.col(value).isNotNull() & (F.col(order) > as_of - F.make_dt_interval(F.lit(days))))


def recent(metrics: DataFrame, ts: str, as_of: Column, hours: int = 1) -> DataFrame:
    """SNK-13: the appended request metrics that aren't past their time; older ones are left out when they are read."""
    return metrics.where(F.col(ts).between(as_of - F.make_dt_interval(hours=F.lit(hours)), as_of))
