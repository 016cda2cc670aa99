"""Queries over the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marklight.session import shared_dir, table
from marklight.streaming import state


def _events(df):
    return df.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def token_bucket(spark, d):
    """Which events a bucket of three tokens a user lets through, one token in six hours."""
    r = state.rate_limit(_events(table(spark, d, "events")), 6 * 3600.0, 3.0)
    return r.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected")).withColumnRenamed("key", "user_id")


def event_sessions(spark, d):
    """Sessions over all users: no pause longer than ten minutes."""
    s = state.table_sessions(_events(table(spark, d, "events")))
    return s.agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


def stream_progress(spark, d):
    """Highest value per user and quarter of an hour, from the stream, windows open at its end included."""
    e = _events(state.read_stream(spark, d, "events")).select("key", "ts", F.col("value").alias("fraction"))
    p = state.drained(state.progress(e), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", "update")
    # a window is given again by every batch that raises it
    return p.groupBy("key", "since").agg(F.max("fraction").alias("fraction"))


def stream_token_bucket(spark, d):
    e = _events(state.read_stream(spark, d, "events"))
    r = state.drained(state.rate_limit_stream(e, 6 * 3600.0, 3.0), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    return r.groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected")).withColumnRenamed("key", "user_id")


def event_windows(spark, d):
    """Events and mean value per type and day."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean")


QUERIES = {f.__name__: f for f in (token_bucket, event_sessions, stream_progress, stream_token_bucket, event_windows)}
_BUCKET = """with recursive e as (select user_id, epoch_us(ts) / 1e6 as sec, row_number() over (partition by user_id order by ts, event_id) as i from events where user_id is not null and ts is not null),
r as (select user_id, i, sec, 2.0::double as tokens, true as ok from e where i = 1 union all
  select user_id, i, sec, case when have >= 1 then have - 1 else have end, have >= 1 from (select e.user_id, e.i, e.sec, least(3.0::double, r.tokens + (e.sec - r.sec) / 21600.0) as have from r join e on e.user_id = r.user_id and e.i = r.i + 1))
select user_id, count(*) filter (ok) as allowed, count(*) filter (not ok) as rejected from r group by user_id"""
SQL = {
    "token_bucket": _BUCKET,
    "stream_token_bucket": _BUCKET,
    "stream_progress": "select user_id as key, time_bucket(interval '15 minutes', ts::timestamp) as since, max(value) as fraction from events where ts is not null group by all",
    "event_sessions": "with o as (select epoch_us(ts) as t, lag(epoch_us(ts)) over (order by ts) as p from events), s as (select sum(case when p is null or t - p >= 600000000 then 1 else 0 end) over (order by t rows unbounded preceding) as s from o), c as (select s, count(*) as n from s group by s) select count(*) as sessions, sum(n)::bigint as events, max(n) as longest from c",
    "event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(avg(value), 6) as mean from events group by all",
}
