"""Structured Streaming jobs over message streams.

Streams carry the columns of ``relaylog.schema.MESSAGE``. ``ts`` is event time; ``timed`` makes
it a timestamp with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relaylog.operators.queue import forward_uid
from relaylog.operators.routing import route_match
from relaylog.schema import POLL_INTERVAL
from relaylog.sources import capture


def timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_route(captures: DataFrame, routes: DataFrame) -> DataFrame:
    """Parse and route a stream of captures (``raw``); the route table is static, no state is kept."""
    parsed = capture.parsed_once(stream_parse(captures))
    return route_match(parsed.drop("raw"), routes, "uri")


def stream_parse(captures: DataFrame) -> DataFrame:
    return capture.parse_requests(captures)


def stream_dedupe(stream: DataFrame, delay: str, uid: str = "uid") -> DataFrame:
    """One row per uid; a uid is remembered for ``delay`` after it was seen."""
    return timed(stream, delay).dropDuplicatesWithinWatermark([uid])


def stream_correlate(requests: DataFrame, answers: DataFrame, wait: str, delay: str) -> DataFrame:
    """Every PUT with the first POST that names it within ``wait``; without one the answer is null.

    A PUT comes out once, when the watermark has passed the time in which it can be answered.
    """
    puts = timed(requests, delay).filter(F.col("method") == "PUT").select(
        F.col("channel").alias("put_channel"), F.col("uid").alias("put_uid"),
        F.col("event_id").alias("put_id"), F.col("ts").alias("put_ts"),
    )
    posts = timed(answers, delay).filter(F.col("method") == "POST").select(
        F.col("channel").alias("post_channel"), forward_uid().alias("post_uid"),
        F.col("event_id").alias("post_id"), F.col("ts").alias("post_ts"),
    )
    within = (
        (F.col("put_channel") == F.col("post_channel"))
        & (F.col("put_uid") == F.col("post_uid"))
        & (F.col("post_ts") >= F.col("put_ts"))
        & (F.col("post_ts") <= F.col("put_ts") + F.expr(f"interval {wait}"))
    )
    first = F.min(F.when(F.col("post_id").isNotNull(), F.struct("post_ts", "post_id", "post_channel", "post_uid"))).alias("_first")
    answered = puts.join(posts, within, "leftOuter").groupBy("put_channel", "put_uid", "put_id", "put_ts").agg(first)
    return answered.select("put_channel", "put_uid", "put_id", "put_ts", "_first.*")


def stream_monitor(stream: DataFrame, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Requests per window, channel and method; rows behind the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = timed(stream, delay).groupBy(window.alias("w"), "channel", "method").agg(
        F.count(F.lit(1)).alias("requests")
    )
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "channel", "method", "requests")


def stream_sessions(stream: DataFrame, delay: str, gap: str) -> DataFrame:
    """Bursts of activity per channel, closed after ``gap`` without a request."""
    sessions = timed(stream, delay).groupBy(F.session_window("ts", gap).alias("w"), "channel").agg(
        F.count(F.lit(1)).alias("requests")
    )
    return sessions.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "channel", "requests")


def reply_writer(path: str, outputs: dict[str, Column]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink with several outputs, each a filter over the batch.

    Every batch owns the folder ``batch_id=N`` of an output and overwrites it, so a batch that
    runs again after a failure leaves no second copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, keep in outputs.items():
                batch.filter(keep).write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write a stream as parquet: continuously, or all that is available now and stop."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)).start()


def start_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  once: bool = False) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)).start()


def rocksdb_state(spark: SparkSession) -> AbstractContextManager[None]:
    """Keyed state larger than memory; required by stateful processors."""
    return _setting(
        spark, "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def merged_sessions(spark: SparkSession) -> AbstractContextManager[None]:
    """Merge sessions where rows are read, so that a busy channel shuffles sessions, not rows."""
    return _setting(spark, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting while a query starts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
