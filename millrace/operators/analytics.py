"""Jobs, tiers and requests: grouped counts, ratios, percentiles, shares and running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import catalog, ranges


def request_stats(df: DataFrame, latency: str, failed: Column, ts: str, most: int = ranges.MOST) -> DataFrame:
    """AGG-07: count, error rate in percent, exact interpolated p50, p95 and p99 (T12), and requests a minute between first and last."""
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 60e6
    counts = df.agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(failed) / F.count("*"), 4).alias("error_rate"), F.when(span > 0, F.round(F.count("*") / span, 4)).otherwise(0.0).alias("rpm"))
    exact = ranges.percentiles(df, [], latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, most)
    return counts.join(F.broadcast(exact)).select("n", "error_rate", *(F.round(p, 4).alias(p) for p in ("p50", "p95", "p99")), "rpm")  # one row each


def endpoint_stats(df: DataFrame, endpoint: str, latency: str, shown: int = 10, most: int = ranges.MOST) -> DataFrame:
    """AGG-08, SORT-06: count, mean and p95 of each endpoint; the busiest."""
    stats = df.groupBy(endpoint).agg(F.count("*").alias("n"), F.round(F.avg(latency), 4).alias("avg_latency")).orderBy(F.desc("n"), endpoint).limit(shown)
    busy = ranges.by_key(df, stats, [endpoint], "left_semi")
    exact = ranges.percentiles(busy, [endpoint], latency, {"p95": 0.95}, most).withColumnRenamed(endpoint, "_endpoint")
    joined = stats.join(exact, F.col(endpoint).eqNullSafe(F.col("_endpoint")), "left")
    return joined.select(endpoint, "n", "avg_latency", F.round("p95", 4).alias("p95")).orderBy(F.desc("n"), endpoint)


def last_hours(df: DataFrame, ts: str, as_of: Column, hours: int = 1) -> DataFrame:
    """SRC-21, STR-07: rows of the hours up to as_of."""
    return df.where((F.col(ts) >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col(ts) <= as_of))


def job_summary(jobs: DataFrame, status: str, products: str, seconds: str) -> DataFrame:
    """AGG-04."""
    done = F.col(status) == "completed"
    return jobs.agg(F.count("*").alias("jobs"), F.coalesce(F.sum(F.col(products).try_cast("bigint")), F.lit(0)).alias("products"), F.coalesce(F.round(100.0 * F.count_if(done) / F.count("*"), 1), F.lit(0.0)).alias("success_rate"), F.round(F.avg(F.when(done & (F.col(seconds) > 0), F.col(seconds))), 1).alias("avg_seconds"))


def counts_by(jobs: DataFrame, *dimensions: str) -> DataFrame:
    """AGG-04: counts by each dimension in one pass; a missing status counts as unknown, other missing values are left out."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), (F.coalesce(F.col(d), F.lit("unknown")) if d == "status" else F.col(d)).alias("value")) for d in dimensions))
    return jobs.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def tier_performance(jobs: DataFrame, tier: str, seconds: str, products: str) -> DataFrame:
    """AGG-05, SORT-05: products a second is a ratio of sums."""
    rate = F.coalesce(F.round(F.try_divide(F.sum(products), F.sum(seconds)), 2), F.lit(0.0))
    return jobs.where(F.col(seconds) > 0).groupBy(tier).agg(F.count("*").alias("jobs"), F.round(F.avg(seconds), 1).alias("avg_seconds"), F.round(F.avg(products), 1).alias("avg_products"), rate.alias("pps")).orderBy(F.desc("pps"), tier)


def crawl_totals(jobs: DataFrame, seconds: str, products: str, *by: str) -> DataFrame:
    """AGG-06: seconds of the jobs that took any, and their products a second; 0 where none did."""
    took = F.col(seconds) > 0
    rate = F.round(F.try_divide(F.sum(F.when(took, F.col(products))), F.sum(F.when(took, F.col(seconds)))), 4)
    return jobs.groupBy(*by).agg(F.coalesce(F.sum(F.when(took, F.col(seconds))), F.lit(0)).alias("seconds"), F.coalesce(rate, F.lit(0.0)).alias("products_a_second"))


def shares(counts: DataFrame, n: str) -> DataFrame:
    """WIN-09, WIN-10: share of the total in percent and of the largest. counts has few rows: one for each value of a dimension."""
    every = Window.partitionBy(F.lit(1))
    return counts.select("*", F.round(100.0 * F.col(n) / F.sum(n).over(every), 2).alias("share"), F.round(F.col(n) / F.greatest(F.max(n).over(every), F.lit(1)), 4).alias("of_max"))


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """STR-03, SRC-20: the last state of each key."""
    return catalog.last_by_key(log, [key], list(order)).select(key, *(c for c in log.columns if c != key))


def progress(log: DataFrame, key: str, order: list[str], n: str, most: int = ranges.MOST) -> DataFrame:
    """WIN-05, WIN-06: running amount of each key, and its percentage of the whole (0 of 0)."""
    out = ranges.running(log, [key], order, {"processed": n}, {"_whole": n}, most)
    return out.withColumn("percentage", F.coalesce(F.round(F.try_divide(100.0 * F.col("processed"), F.col("_whole")), 2), F.lit(0.0))).drop("_whole")


def budget(log: DataFrame, key: str, order: list[str], cost: str, limit: float, most: int = ranges.MOST) -> DataFrame:
    """AGG-22, WIN-07: spent so far, what remains, and which row crosses 80 % and which the limit."""
    out = ranges.running(log, [key], order, {"spent": cost}, most=most).withColumn("spent", F.round("spent", 4))
    out = out.withColumn("remaining", F.greatest(F.lit(0.0), F.round(F.lit(limit) - F.col("spent"), 4)))
    before = F.round(F.col("spent") - F.col(cost), 4)
    return out.withColumn("warns", (F.col("spent") >= 0.8 * limit) & (before < 0.8 * limit)).withColumn("exceeds", (F.col("spent") > limit) & (before <= limit))
