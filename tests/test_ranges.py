"""Running sums, percentiles and sweeps give the same rows whether a key is cut into ranges or not."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import analytics, ranges

ROWS = [(("hot" if i % 3 else f"k{i % 7}") if i % 50 else None, i // 2, i, (i * 37 % 101) / 4 if i % 11 else None) for i in range(3000)]
SHAPE = "k string, o int, id int, v double"


def same(a, b):
    rows = lambda df: sorted((tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert rows(a) == rows(b) and a.columns == b.columns


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sums(spark, keys):
    df = spark.createDataFrame(ROWS, SHAPE).repartition(6)
    one, many = (ranges.running(df, keys, ["o", "id"], {"s": "v", "n": "one"}, {"whole": "v"}, most) if "one" in df.columns else ranges.running(df.withColumn("one", F.lit(1)), keys, ["o", "id"], {"s": "v", "n": "one"}, {"whole": "v"}, most) for most in (10_000, 100))
    same(one, many)
    if keys:
        assert many.where("k = 'hot'").select("n").orderBy(F.desc("n")).first()[0] == sum(r[0] == "hot" for r in ROWS)


def test_a_hot_key_lies_in_many_tasks(spark):
    """One key of all rows: no task of the running sum orders more than a part of them."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), "id", F.lit(1).alias("v")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this is little data
    try:
        out = ranges.running(df, ["k"], ["id"], {"s": "v"}, most=1000)
        assert out.where("s <> id + 1").count() == 0 and out.count() == 20_000
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [10_000, 50])
def test_percentiles(spark, most):
    dice = random.Random(5)
    values = {"a": [dice.random() for _ in range(997)], "ties": [1.0] * 500 + [2.0] * 500 + [3.0], "one": [7.0], "two": [1.0, 2.0], "ints": [float(dice.randrange(20)) for _ in range(600)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: tuple(r)[1:] for r in ranges.percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}, most).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert np.allclose(got[k], np.percentile(vs, [0, 50, 95, 99, 100]), rtol=0, atol=1e-12)
    whole = ranges.percentiles(df, [], "v", {"p": 0.3}, most).first()[0]
    assert abs(whole - np.percentile([v for _, v in rows if v is not None], 30)) < 1e-12
    assert ranges.percentiles(df.limit(0), ["k"], "v", {"p": 0.5}, most).count() == 0


def test_stats_do_not_depend_on_the_cut(spark):
    df = spark.createDataFrame(ROWS, SHAPE).withColumn("ts", F.timestamp_seconds(F.col("o") + 1_700_000_000))
    same(analytics.request_stats(df, "v", F.col("id") % 9 == 0, "ts"), analytics.request_stats(df, "v", F.col("id") % 9 == 0, "ts", 100))
    same(analytics.endpoint_stats(df, "k", "v", 4), analytics.endpoint_stats(df, "k", "v", 4, 100))
    same(analytics.progress(df, "k", ["o", "id"], "v"), analytics.progress(df, "k", ["o", "id"], "v", 100))
    same(analytics.budget(df, "k", ["o", "id"], "v", 900.0), analytics.budget(df, "k", ["o", "id"], "v", 900.0, 100))


@pytest.mark.parametrize("most", [10_000, 40])
def test_concurrency(spark, most):
    dice = random.Random(6)
    spans = [(dice.choice(["a", "a", "b", None]), s, dice.choice([None, s, s - 1, s + 3, s + 10, s + 2])) for s in (dice.randrange(120) for _ in range(500))] + [("never", 5, 5), ("null", None, 3)]
    want = {}
    for k in {k for k, _, _ in spans}:
        own = [(s, e) for kk, s, e in spans if kk == k]
        ran = [(s, e) for s, e in own if s is not None and (e is None or e > s)]
        now = {t: sum(s <= t and (e is None or e > t) for s, e in ran) for t, _ in ran}
        want[k] = (len(own), max(now.values(), default=0), sum(min(sum(s == t for s, _ in ran), max(0, n - 5)) for t, n in now.items()))
    df = spark.createDataFrame(spans, "domain string, s int, e int")
    assert {r.domain: tuple(r)[1:] for r in ranges.concurrent(df, "domain", "s", "e", 5, most).collect()} == want
    assert ranges.concurrent(df.limit(0), "domain", "s", "e", 5, most).count() == 0
