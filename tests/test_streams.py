"""Streams give the same rows whether their events come in one file, in seven in order, or in seven that overlap; and their machines at their bounds."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans import stream_queries
from millrace.session import table
from millrace.streaming import ordered, state

DAY, TTL = stream_queries.DAY, stream_queries.TTL_HOURS * stream_queries.HOUR


@pytest.fixture(scope="module")
def layouts(spark, small, tmp_path_factory):
    """Folders whose events are one file, seven by time, and seven by time with rows up to 20 hours late."""
    events = table(spark, small, "events")
    rank = lambda jitter: F.ntile(7).over(Window.orderBy(F.col("ts") + jitter))
    made = [small]
    for name, jitter in (("ordered", F.expr("interval 0 hours")), ("late", F.make_dt_interval(hours=(F.col("event_id") * 7 % 20).cast("int")))):
        top = tmp_path_factory.mktemp(name)
        cut = events.withColumn("file", rank(jitter)).cache()
        for i in range(1, 8):  # one after the other: streams take files by their age
            cut.where(f"file = {i}").drop("file").coalesce(1).write.mode("append").parquet(f"file://{top}/events.parquet")
        made.append(f"file://{top}")
    return made


NAMES = ("stream_limits", "stream_latest", "stream_once", "stream_cache", "stream_progress", "stream_nonces", "stream_breakers")


@pytest.mark.parametrize("name", NAMES)
def test_layouts(spark, layouts, name):
    query = getattr(stream_queries, name)
    late = layouts[1:2] if name in ("stream_limits", "stream_once") else layouts[1:] if name == "stream_breakers" else layouts[2:]  # the first two have a watermark of an hour
    want = sorted(map(str, query(spark, layouts[0]).collect()))
    for where in late:
        assert sorted(map(str, query(spark, where, files=1).collect())) == want
    assert want


def test_breakers(spark, small):
    """Against the rule applied to each user's events in order, as of the watermark."""
    rows = sorted(((r.user_id, r.us // 1000, r.event_id, r.event_type == "error") for r in table(spark, small, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()), key=lambda r: r[1:3])
    reached = rows[-1][1] - DAY
    want = {}
    for user, at, _, bad in rows:
        if at > reached:
            continue
        name, failures, opened = want.get(user, ("CLOSED", 0, None))
        if name == "OPEN" and at - opened >= TTL:
            name = "HALF_OPEN"
        if name != "OPEN":
            if bad:
                failures += 1
                name, opened = ("OPEN", at) if name == "HALF_OPEN" or failures >= 3 else (name, opened)
            elif name == "HALF_OPEN":
                name, failures = "CLOSED", 0
        want[user] = (name, failures, opened)
    want = {u: ("HALF_OPEN" if n == "OPEN" and reached - o >= TTL else n, f, o) for u, (n, f, o) in want.items()}
    assert {r.user_id: (r.state, r.failures, r.opened) for r in stream_queries.stream_breakers(spark, small).collect()} == want
    assert {x[0] for x in want.values()} >= {"OPEN", "HALF_OPEN"} or len(want) < 20


def fed(machine, rows):
    """The state after rows (at, kind, value) in order, and what they give."""
    now, given = None, []
    for at, kind, value in rows:
        if (end := machine.deadline(now)) is not None and end <= at:
            now = machine.passed(now)
        now, out = machine.event(json.loads(json.dumps(now)), at, kind, value)
        given += [out] if out else []
    return now, given


@pytest.mark.parametrize("events, want", [([1] * 5, "OPEN"), ([1, 1, 0, 1, 1, 1], "OPEN"), ([1] * 4, "CLOSED")])
def test_breaker(events, want):
    """T16: successes don't reset the count."""
    breaker = ordered.Breaker(5, 60)
    rows = [(at, "bad" if bad else None, None) for at, bad in enumerate(events)]
    assert fed(breaker, rows)[0][0] == want
    if want == "OPEN":
        opened = fed(breaker, rows)[0][2]
        assert fed(breaker, [*rows, (opened + 60, None, None)])[0] == ["CLOSED", 0, opened] and fed(breaker, [*rows, (opened + 60, "bad", None)])[0][0] == "OPEN"
        assert fed(breaker, [*rows, (opened + 59, None, None)])[0] == fed(breaker, rows)[0]


def test_nonces_are_given_once():
    nonces = ordered.Nonces(600)
    issue, use = lambda at, v: (at, "issue", v), lambda at: (at, "use", None)
    assert fed(nonces, [use(1), issue(2, "a"), use(3), use(4)])[1] == [[1, False, None], [3, True, "a"], [4, False, None]]
    assert fed(nonces, [issue(0, "a"), use(599)])[1] == [[599, True, "a"]] and fed(nonces, [issue(0, "a"), use(600)])[1] == [[600, False, None]]
    assert fed(nonces, [issue(0, "a"), issue(500, "b"), use(900)])[1] == [[900, True, "b"]] and fed(nonces, [issue(0, "a"), use(1)])[0] is None


def test_progress_and_cache_at_their_bounds():
    job = ordered.Progress(100)
    value = lambda p, t, e=None: {"processed": p, "total": t, "error": e}
    now, _ = fed(job, [(0, "run", value(1, 3)), (99, "failed", value(None, None, "x")), (198, "run", value(2, None))])
    assert job.told(now) == [198, "run", 2, 3, 66.67, "x"]
    now, _ = fed(job, [(0, "run", value(1, 3, "x")), (100, "run", value(5, 0))])
    assert job.told(now) == [100, "run", 5, 0, 0.0, None] and job.told(None) == [None] * 6
    cache = ordered.Cache(100)
    assert fed(cache, [(0, "set", "a"), (50, "set", "b")])[0] == [50, "b"] and fed(cache, [(0, "set", "a"), (50, "set", None)])[0] is None
    assert cache.deadline([50, "b"]) == 150 and cache.told(None) == [None, None]


def test_odd_rows_of_a_stream(spark, tmp_path):
    """Null times are left out, null keys are a key, rows of one time go by seq; rows of a hot key in one slice and over many."""
    dice = random.Random(4)
    rows = [("hot", 1_700_000_000 + dice.randrange(400_000), i) for i in range(2000)] + [(None, 1_700_000_000, 5), ("x", None, 6), ("tie", 1_700_000_001, 9), ("tie", 1_700_000_001, 8), ("end", 1_701_000_000, 10)]
    frame = spark.createDataFrame([(k, None if t is None else t, i) for k, t, i in rows], "k string, t long, i long").select("k", F.timestamp_seconds("t").alias("ts"), "i")
    frame.repartition(5).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    shaped = ordered.in_order(stream, "k", "ts", "i", ordered.Cache(10**12), F.lit("set"), F.col("i").cast("string"), late="30 days", slice_hours=1)
    assert stream_queries.into_table(spark, shaped, "update", ["k"]).rows().count() == 0  # nothing is older than the delay
    shaped = ordered.in_order(stream, "k", "ts", "i", ordered.Cache(10**12), F.lit("set"), F.col("i").cast("string"), late="6 days", slice_hours=1)
    got = {r.k: r.value for r in stream_queries.into_table(spark, shaped, "update", ["k"]).rows().collect()}
    last = defaultdict(str) | {k: str(i) for k, t, i in sorted((r for r in rows if r[0] and r[1]), key=lambda r: r[1:])}
    assert got == {None: "5", "hot": last["hot"], "tie": "9"}


def test_cache_and_metrics_of_batches_at_their_bounds(spark):
    log = spark.sql("select k, cast(t as timestamp_ntz) as t, v from values ('a', '2024-01-01 00:00:00', 'x'), ('b', '2024-01-01 00:00:01', 'x'), ('c', '2024-01-07', 'x'), ('c', '2024-01-07 01:00:00', null), ('d', '2024-01-07', 'old'), ('d', '2024-01-07 23:00:00', 'new'), ('e', '2024-01-09', 'late') as x(k, t, v)")
    now = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    assert {(r.k, r.v) for r in state.cached(log, "k", "t", "v", now).collect()} == {("b", "x"), ("d", "new")}
    assert {r.k for r in state.recent(log, "t", now, 1).collect()} == {"d"}
    assert state.cached(log.limit(0), "k", "t", "v", now).count() == 0 == state.recent(log.limit(0), "t", now).count()
