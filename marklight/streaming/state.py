"""Stateful operators over a stream of events, and the same over a table where that is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def progress(events: DataFrame, ttl: str = "15 minutes") -> DataFrame:
    """``key, fraction``: the highest fraction seen per key and window of ``ttl``; a key idle for longer is forgotten.

    ``events(key, ts, fraction)``, a stream or a table. Late events only ever raise a fraction, so it never falls.
    """
    return events.withWatermark("ts", ttl).groupBy("key", F.window("ts", ttl)).agg(F.max("fraction").alias("fraction")).select("key", F.col("window.start").alias("since"), "fraction")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``key, start, end, events``: stretches of a key's events with no pause longer than ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("key", "w.start", "w.end", "events")


def table_sessions(events: DataFrame, gap_seconds: float = 600.0, stretch_seconds: int = 3600) -> DataFrame:
    """``start, end, events``: stretches of all events of a table with no pause of ``gap_seconds`` or more, whatever their key.

    ``events(ts timestamp)``; null times are left out. Each ``stretch_seconds`` of time are cut into sessions apart, then the first and last
    session of each stretch are put together with their neighbours: one row a stretch meets in one task, never the events.
    """
    t = events.where("ts is not null").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("at", F.floor(F.col("t") / (stretch_seconds * 1_000_000)))
    gap = F.lit(int(gap_seconds * 1_000_000))
    w = Window.partitionBy("at").orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) < gap, 0).otherwise(1)
    part = t.withColumn("new", new).withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = part.groupBy("at", "no").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    edge = part.groupBy("at").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.max("no").alias("parts"))
    over = Window.orderBy("at")  # as many rows as there are stretches
    edge = edge.withColumn("goes_on", F.coalesce(F.col("first") - F.lag("last").over(over) < gap, F.lit(False)))
    # a stretch's last session has the name of the stretch in which it began
    name = F.max(F.when(~(F.col("goes_on") & (F.col("parts") == 1)), F.col("at"))).over(over.rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("name", name).withColumn("before", F.lag("name").over(over)).select("at", "goes_on", "parts", "name", "before")
    j = part.join(edge, "at")
    inner = (F.col("no") > 1) & (F.col("no") < F.col("parts"))
    key = F.when((F.col("no") == 1) & F.col("goes_on"), F.struct(F.col("before").alias("at"), F.lit(-1).cast("bigint").alias("no"))).when((F.col("no") == F.col("parts")) & ~inner, F.struct(F.col("name").alias("at"), F.lit(-1).cast("bigint").alias("no"))).otherwise(F.struct("at", "no"))
    s = j.withColumn("key", key).groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("events"))
    return s.select(F.timestamp_micros("lo").alias("start"), F.timestamp_micros(F.col("hi") + gap).alias("end"), "events")


class Bucket:
    """A bucket of ``burst`` tokens that fills by one every ``every`` seconds."""

    def __init__(self, every: float, burst: float, tokens: float | None = None, last: float | None = None):
        self.every, self.burst, self.tokens, self.last = every, burst, burst if tokens is None else tokens, last

    def allow(self, at: float) -> bool:
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, at - self.last) / self.every)
        self.last = at if self.last is None else max(self.last, at)
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


def rate_limit(events: DataFrame, every: float = 300.0, burst: float = 3.0) -> DataFrame:
    """``key, id, allowed`` for the rows of a table ``events(key, id, ts)``, in order of time (ties by id).

    Rows are sorted within partitions and read as a stream, so a key with very many rows needs no memory. Rows without
    key or time are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = None, None
        for pdf in batches:
            out = []
            for k, at in zip(pdf["key"], pdf["at"]):
                if bucket is None or k != key:
                    key, bucket = k, Bucket(every, burst)
                out.append(bucket.allow(at))
            yield pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "allowed": out})

    e = events.where("key is not null and ts is not null").select("key", "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    return e.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(rows, f"key {kinds['key']}, id {kinds['id']}, allowed boolean")


def rate_limit_stream(events: DataFrame, every: float = 300.0, burst: float = 3.0, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """The same over a stream; a key's bucket is forgotten once the watermark is ``ttl_ms`` past its last event.

    The timeout goes by event time: one by the clock would keep a stream that is to use up its input running for ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (None, None)
        bucket = Bucket(every, burst, tokens, last)
        # times and ids only, of one key and batch: how much that can be is set by what a batch reads (``read_stream``)
        pdf = pd.concat([b[["at", "id"]] for b in batches]).sort_values(["at", "id"])
        allowed = [bucket.allow(at) for at in pdf["at"]]
        state.update((bucket.tokens, bucket.last))
        state.setTimeoutTimestamp(max(int(bucket.last * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "id": pdf["id"], "allowed": allowed})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    e = timed.where("key is not null and ts is not null").select("key", "id", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    return e.groupBy("key").applyInPandasWithState(step, f"key {kinds['key']}, id {kinds['id']}, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def read_stream(spark: SparkSession, folder: str, name: str, batch_bytes: int = 8 << 30) -> DataFrame:
    """A table of a folder as a stream of its files, about ``batch_bytes`` in a batch (one file at least)."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{folder}/{name}.parquet*")


def notify(spark: SparkSession, on_start=None, on_batch=None, on_end=None) -> StreamingQueryListener:
    """Call back as streams go: ``on_start(name)``, ``on_batch(name, batch, rows)`` and ``on_end(name, error)``, in the driver.

    Gives the listener, for ``spark.streams.removeListener``. A callback that raises doesn't stop the stream.
    """

    class Calls(StreamingQueryListener):
        def onQueryStarted(self, event):
            if on_start:
                on_start(event.name)

        def onQueryProgress(self, event):
            if on_batch:
                on_batch(event.progress.name, event.progress.batchId, event.progress.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            if on_end:
                on_end(str(event.id), event.exception)

    listener = Calls()
    spark.streams.addListener(listener)
    return listener


def drained(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its present input is used up, by way of a parquet sink with a checkpoint under ``at``.

    ``append`` gives closed windows only; ``update`` gives a row each time a batch changes it, whether closed or not.
    """
    if mode != "append":  # the file sink appends only: a folder per batch, which a repeated batch replaces
        w = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/{n}"))
        w.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")
