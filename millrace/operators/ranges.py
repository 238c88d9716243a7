"""Running sums, exact percentiles and concurrency for keys of any size.

A key with more rows than a task should order is cut: rows go by ranges of key and order to many tasks, each range is summed up, and what stands before it is added.
Keys of fewer rows take one window. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import fresh_dir

#: Rows of a key that one task orders; those of larger keys are cut.
MOST = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Keys of more than `most` rows: few, as each has that many."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys)


def by_key(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join by keys in which null equals null."""
    other = other.select(*(F.col(k).alias(f"_key_{k}") for k in keys))
    return df.join(other, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], how)


def window_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    until = every.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *(F.sum(c).over(until).alias(a) for a, c in sums.items()), *(F.sum(c).over(every).alias(a) for a, c in totals.items()))


def range_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """window_sums() where rows of a key lie in several ranges. Ranges are written once: their bounds come from a sample, which must be the same for sums and rows."""
    parted = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy(*keys, "_part").agg(*(F.sum(c).alias(f"_sum_{a}") for a, c in (sums | totals).items()))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows for a key as there are ranges
    sizes = sizes.select(*(F.col(k).alias(f"_own_{k}") for k in keys), F.col("_part").alias("_own_part"), *(F.coalesce(F.sum(f"_sum_{a}").over(before), F.lit(0)).alias(f"_before_{a}") for a in sums), *(F.sum(f"_sum_{a}").over(every).alias(f"_all_{a}") for a in totals))
    joined = parted.join(sizes, [*(F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys), F.col("_part") == F.col("_own_part")])
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = lambda a, c: F.when(F.sum(c).over(within).isNull() & (F.col(f"_before_{a}") == 0), None).otherwise(F.col(f"_before_{a}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return joined.select(*df.columns, *(running(a, c).alias(a) for a, c in sums.items()), *(F.col(f"_all_{a}").alias(a) for a in totals))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, str], totals: dict[str, str] | None = None, most: int = MOST) -> DataFrame:
    """WIN-05 to WIN-07: df with running sums (name to column) of each key in order, and the key's sums. order must tell rows of a key apart. Nulls count as nothing."""
    large = hot(df, keys, most)
    if large.isEmpty():
        return window_sums(df, keys, order, sums, totals or {})
    if not keys:
        return range_sums(df, keys, order, sums, totals or {})
    large = F.broadcast(stored(large, "hot-keys")) if large.limit(10_001).count() <= 10_000 else stored(large, "hot-keys")
    few, many = by_key(df, large, keys, "left_anti"), by_key(df, large, keys, "left_semi")
    return window_sums(few, keys, order, sums, totals or {}).unionByName(range_sums(many, keys, order, sums, totals or {}))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], most: int = MOST) -> DataFrame:
    """AGG-07, AGG-08: interpolated percentiles (name to share) of each key's values that aren't null, T12.

    For keys of many rows equal values are counted first; of what is left the ranks come from running counts, and each percentile needs the values at two ranks."""
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    plain = lambda some: some.groupBy(*keys).agg(*(F.percentile(value, F.lit(q)).alias(a) for a, q in wanted.items()))
    large = hot(rows, keys, most)
    if large.isEmpty():
        return plain(rows)
    few, many = None, rows
    if keys:
        large = stored(large, "hot-keys")
        few, many = by_key(rows, large, keys, "left_anti"), by_key(rows, large, keys, "left_semi")
    counted = running(many.groupBy(*keys, value).agg(F.count("*").alias("_times")), keys, [value], {"_until": "_times"}, {"_all": "_times"}, most)
    place = lambda q: F.lit(q) * (F.col("_all") - 1)
    at = lambda rank: F.max(F.when((rank >= F.col("_until") - F.col("_times")) & (rank < F.col("_until")), F.col(value)))
    ends = counted.groupBy(*keys).agg(F.max("_all").alias("_all"), *(x for a, q in wanted.items() for x in (at(F.floor(place(q))).alias(f"_low_{a}"), at(F.ceil(place(q))).alias(f"_high_{a}"))))
    share = lambda q: place(q) - F.floor(place(q))
    exact = ends.select(*keys, *(F.when(share(q) == 0, F.col(f"_low_{a}")).otherwise((1 - share(q)) * F.col(f"_low_{a}") + share(q) * F.col(f"_high_{a}")).cast("double").alias(a) for a, q in wanted.items()))
    return plain(few).unionByName(exact) if keys else exact


def concurrent(spans: DataFrame, key: str, start: str, end: str, limit: int = 5, most: int = MOST) -> DataFrame:
    """STR-05: for each key the spans, the most that ran at once, and how many began while `limit` others ran.

    A sweep over starts and ends: a span ends before another that starts at that time; one without an end goes on; one that ends where it starts or before counts as a span that never ran."""
    real = spans.where(F.col(start).isNotNull()).select(key, start, end).withColumn("_ran", F.coalesce(F.col(end) > F.col(start), F.lit(True)))
    moves = F.array_compact(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("move")), F.when(F.col(end).isNotNull(), F.struct(F.col(end).alias("at"), F.lit(-1).alias("move")))))
    swept = real.where("_ran").select(key, F.explode(moves).alias("m")).groupBy(key, "m.at", "m.move").agg(F.sum("m.move").alias("change"))  # starts of one time are as one
    swept = running(swept, [key], ["at", "move"], {"now": "change"}, most=most)
    began = swept.where("move = 1").groupBy(key).agg(F.max("now").alias("most_at_once"), F.sum(F.least(F.col("change"), F.greatest(F.col("now") - limit, F.lit(0)))).alias("over_limit"))
    every = spans.groupBy(key).agg(F.count("*").alias("spans"))
    out = every.join(began.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, "spans", F.coalesce("most_at_once", F.lit(0)).cast("bigint").alias("most_at_once"), F.coalesce("over_limit", F.lit(0)).cast("bigint").alias("over_limit"))
