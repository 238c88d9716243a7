"""Streams over the events table, run to its end, each with the SQL that gives the same rows where SQL can.

Each query takes `files`: how many files a micro-batch reads at most (all, if it isn't given). Results don't depend on it as long as rows are no later than the delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import fresh_dir, table
from millrace.sinks.buckets import BucketTable
from millrace.streaming import ordered, state

DAY, HOUR = 86_400_000, 3_600_000
#: How long entries of the queries below live: gaps between a user's events are shorter and longer.
TTL_HOURS = 12


def source(s, d, files=None) -> DataFrame:
    """The events as a stream, whether the table is a file or a folder of files."""
    reader = s.readStream.schema(table(s, d, "events").schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return reader.parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def run(s, shaped: DataFrame, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream to its end; write gets each micro-batch and its number, again after a failure."""
    key, store = ordered.STORE
    before = s.conf.get(key)
    s.conf.set(key, store)
    try:
        writer = shaped.writeStream.outputMode(mode).option("checkpointLocation", fresh_dir(s, "checkpoint")).trigger(availableNow=True)
        writer.foreachBatch(write).start().awaitTermination()
    finally:
        s.conf.set(key, before)


def into_table(s, shaped: DataFrame, mode: str, keys=(), schema: StructType | None = None, **options) -> BucketTable:
    """A new table with what a stream gives: upserted by keys, or appended where there are none."""
    made = BucketTable(s, fresh_dir(s, "table"), keys, schema or shaped.schema, buckets=16)
    run(s, shaped, mode, made.writer("stream", **options) if keys else lambda df, n: made.append(df, "stream", n))
    return made


def _start(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_windows(s, d, files=None):
    """STR-01: requests of each hour and kind that the watermark has closed."""
    return _start(into_table(s, state.request_windows(source(s, d, files), "ts", "event_type", "value"), "append").rows())


def stream_limits(s, d, files=None):
    """STR-05: closed days in which a user made more than four requests."""
    return _start(into_table(s, state.over_limit(source(s, d, files), "ts", "user_id", 4, "1 day"), "append").rows())


def stream_latest(s, d, files=None):
    """STR-02, SNK-01: the last event of each user, upserted batch by batch; the table is the only state."""
    log = source(s, d, files).select("user_id", "ts", "event_type")
    return into_table(s, log, "append", ["user_id"], order=["ts", "event_type"], newest=True).rows().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_once(s, d, files=None):
    """STR-08: users once for each day."""
    return _start(into_table(s, state.once(source(s, d, files), "ts", "user_id"), "append").rows())


def stream_metrics(s, d, files=None):
    """SNK-13: events appended as request metrics, and those of the last 24 hours as a reader sees them."""
    kept = into_table(s, source(s, d, files).select("event_id", "ts", "event_type", "value"), "append").rows()
    return state.recent(kept, "ts", _last_ts(s, d).cast("timestamp"), 24).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _last_ts(s, d):
    return F.lit(table(s, d, "events").agg(F.max("ts").cast("string")).first()[0])


def result_cache(s, d):
    """STR-09: each user as a domain whose errors empty its entry."""
    log = table(s, d, "events").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")))
    return state.cached(log, "user_id", "ts", "event_type", _last_ts(s, d).cast("timestamp_ntz"))


def stream_cache(s, d, files=None):
    """STR-09: what is left in a cache by user whose errors empty its entry and whose entries live 12 hours."""
    e = source(s, d, files)
    shaped = ordered.in_order(e, "user_id", "ts", "event_id", ordered.Cache(TTL_HOURS * HOUR), F.lit("set"), F.when(F.col("event_type") != "error", F.col("event_type")))
    return into_table(s, shaped, "update", ["user_id"]).rows().where("at_ms is not null")


def stream_progress(s, d, files=None):
    """STR-03, SNK-12: users as jobs whose events set fields; an error stays as long as the job lives, which is 12 hours behind each event."""
    e = source(s, d, files)
    value = F.struct(F.floor("value").alias("processed"), F.when(F.col("event_id") % 3 == 0, 500).alias("total"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))
    shaped = ordered.in_order(e, "user_id", "ts", "event_id", ordered.Progress(TTL_HOURS * HOUR), F.col("event_type"), value)
    return into_table(s, shaped, "update", ["user_id"]).rows().where("at_ms is not null")


def stream_nonces(s, d, files=None):
    """STR-08: two streams: views issue a nonce for their user, clicks use it; each is granted once, within 12 hours."""
    rows = lambda kind, what: source(s, d, files).where(F.col("event_type") == kind).withWatermark("ts", "1 day").select("user_id", "ts", "event_id", F.lit(what).alias("kind"))
    both = rows("view", "issue").union(rows("click", "use"))
    value = F.when(F.col("kind") == "issue", F.col("event_id").cast("string"))
    shaped = ordered.in_order(both, "user_id", "ts", "event_id", ordered.Nonces(TTL_HOURS * HOUR), F.col("kind"), value, late=None)
    return into_table(s, shaped, "update").rows()


def stream_breakers(s, d, files=None):
    """STR-04: each user as a domain whose errors trip the breaker."""
    e = source(s, d, files)
    shaped = ordered.in_order(e, "user_id", "ts", "event_id", ordered.Breaker(3, TTL_HOURS * HOUR), F.when(F.col("event_type") == "error", "bad"))
    return into_table(s, shaped, "update", ["user_id"]).rows()


_W = f"w as (select epoch_us(max(ts)) // 1000 - {DAY} as w from events), e as (select *, epoch_us(ts) // 1000 as at_ms from events, w where epoch_us(ts) // 1000 <= w)"
_TTL = TTL_HOURS * HOUR
QUERIES = {
    "stream_windows": (stream_windows, "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total, max(value) as most from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 1 hour"),
    "stream_limits": (stream_limits, "select date_trunc('day', ts) as start, user_id, count(*) as n from events group by 1, 2 having n > 4 and date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour"),
    "stream_latest": (stream_latest, "select user_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_type desc) as r from events) where r = 1"),
    "stream_once": (stream_once, "select distinct date_trunc('day', ts) as start, user_id from events"),
    "stream_metrics": (stream_metrics, "select event_id, ts, event_type, value from events where ts >= (select max(ts) - interval 24 hour from events)"),
    "result_cache": (result_cache, "select user_id, ts, event_type from (select user_id, ts, case when event_type <> 'error' then event_type end as event_type, row_number() over (partition by user_id order by ts desc, case when event_type <> 'error' then event_type end desc nulls last) as r from events) where r = 1 and event_type is not null and ts > (select max(ts) - interval 7 day from events)"),
    "stream_cache": (stream_cache, f"with {_W} select user_id, at_ms, event_type as value from (select *, row_number() over (partition by user_id order by at_ms desc, event_id desc) as r from e) where r = 1 and event_type <> 'error' and at_ms + {_TTL} > w"),
    "stream_progress": (stream_progress, f"""with {_W},
        g as (select *, case when at_ms - lag(at_ms) over (partition by user_id order by at_ms, event_id) >= {_TTL} then 1 else 0 end as gap from e),
        c as (select *, sum(gap) over (partition by user_id order by at_ms, event_id) as chain from g),
        l as (select *, max(chain) over (partition by user_id) as last_chain from c)
        select user_id, max(at_ms) as at_ms, arg_max(event_type, (at_ms, event_id)) as status, cast(arg_max(floor(value), (at_ms, event_id)) as bigint) as processed,
          cast(max((at_ms, event_id)) filter (where event_id % 3 = 0) is not null as int) * 500::bigint + case when max((at_ms, event_id)) filter (where event_id % 3 = 0) is null then null else 0 end as total,
          case when max((at_ms, event_id)) filter (where event_id % 3 = 0) is null then 0.0 else round(100 * arg_max(floor(value), (at_ms, event_id)) / 500, 2) end as percentage,
          arg_max('e' || event_id, (at_ms, event_id)) filter (where event_type = 'error') as error
        from l where chain = last_chain group by user_id, w having max(at_ms) + {_TTL} > w"""),
    "stream_nonces": (stream_nonces, f"""with w as (select least(epoch_us(max(ts) filter (where event_type = 'view')) // 1000, epoch_us(max(ts) filter (where event_type = 'click')) // 1000) - {DAY} as w from events),
        e as (select *, epoch_us(ts) // 1000 as at_ms from events, w where event_type in ('view', 'click') and epoch_us(ts) // 1000 <= w),
        p as (select *, lag(struct_pack(event_type, at_ms, event_id)) over (partition by user_id order by at_ms, event_id) as before from e),
        g as (select *, coalesce(before.event_type = 'view' and before.at_ms + {_TTL} > at_ms, false) as granted from p where event_type = 'click')
        select user_id, at_ms, granted, case when granted then before.event_id::varchar end as value from g"""),
    "stream_breakers": (stream_breakers, None),
}
