"""The four behaviours with streaming meaning, as Structured Streaming jobs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from barlens.operators import events as ev
from barlens.operators.event_store import EventStore

BUCKET = "60 minutes"


def ohlcv() -> list[Column]:
    order = F.struct("ts", "event_id")
    return [
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trades"),
    ]


def bucket_stream(ticks: DataFrame, delay: str = "10 minutes", bucket: str = BUCKET) -> DataFrame:
    """OHLCV buckets; in append mode a bucket appears only after its end has passed."""
    g = ticks.withWatermark("ts", delay).groupBy("market", "symbol", F.window("ts", bucket).alias("w"))
    return g.agg(*ohlcv()).select("market", "symbol", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume", "trades")


def closed_buckets(ticks: DataFrame, now: Column, bucket: str = BUCKET) -> DataFrame:
    """The batch equivalent: buckets whose end is not after ``now``."""
    g = ticks.groupBy("market", "symbol", F.window("ts", bucket).alias("w")).agg(*ohlcv())
    return g.filter(F.col("w.end") <= now).select("market", "symbol", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume", "trades")


def first_observations(events: DataFrame, delay: str = "36 hours") -> DataFrame:
    """A replayed event is not new: first arrival per id wins within the watermark."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


def observe(events: DataFrame, out_path: str, checkpoint: str, delay: str = "36 hours") -> StreamingQuery:
    """Append the first observation of every event of a stream to a table.

    Files are taken in the order of their arrival.  An id is remembered until the watermark (the newest event time
    less ``delay``) has passed its event; what is older than the watermark itself is late and left out, so a replay
    is never taken for new.  The table is written exactly once: the file sink logs its batches in the folder.
    """
    writer = first_observations(events, delay).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_batch(batch: DataFrame, store_path: str, name: str | None = None) -> None:
    """Add the articles of one micro-batch that nothing in the store matches, with their clusters.

    A batch that runs again under its name replaces what it wrote; under another name its rows match themselves.
    """
    EventStore(batch.sparkSession, store_path).ingest(ev.prepared_events(batch), name)


def ingest_stream(events: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Incremental ingest of an event stream into the store."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = events.writeStream.foreachBatch(lambda df, number: ingest_batch(df, store_path, f"{stream}-{number}"))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clusters_touched(store: DataFrame, new: DataFrame) -> DataFrame:
    """Clusters of all events in the runs that new events fall into; other runs keep theirs."""
    near = ev.touched(store, new)
    return ev.cluster(near.unionByName(new.select(*near.columns)).dropDuplicates(["event_id"]))


def usable_view(store: DataFrame, as_of: Column) -> DataFrame:
    """Late knowledge: an event counts from its first sighting, however early it happened."""
    return ev.events_as_of(store, as_of)
