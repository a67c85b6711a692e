"""Method policy, dispatch, and limits on rate, concurrency and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylog.functions.scalars import parse_period
from relaylog.operators.slices import Slicing, add_slice, epoch_seconds, running, spread
from relaylog.schema import ALLOWED, METHODS

# What each method does to a queue.
OPERATIONS = {
    "GET": "consume",
    "POST": "reply",
    "PUT": "enqueue",
    "HEAD": "peek",
    "OPTIONS": "help",
}


def allowed_methods(mq_class: Column | str, method: Column | str) -> Column:
    """The methods a refusal names, by queue class and refused method."""
    mq_class, method = (F.col(c) if isinstance(c, str) else c for c in (mq_class, method))
    out = F.lit(None).cast("string")
    for cls, served in ALLOWED.items():
        # TRACE on a queue names PUT only; clients depend on the text, so it stays.
        listed = F.when(method == "TRACE", "PUT").otherwise(",".join(served)) if cls == "SyncQueue" else F.lit(",".join(served))
        out = F.when(mq_class == cls, listed).otherwise(out)
    return out


def _allow_table(df: DataFrame) -> DataFrame:
    rows = [(cls, method, 0 if method in served else 405) for cls, served in ALLOWED.items() for method in METHODS]
    return df.sparkSession.createDataFrame(rows, "mq_class string, method string, code int")


def method_policy(messages: DataFrame) -> DataFrame:
    """Add ``code`` (0 or 405), ``allow`` and ``message`` by queue class and method."""
    joined = messages.join(F.broadcast(_allow_table(messages)), ["mq_class", "method"], "left")
    refused = F.col("code") == 405
    text = F.when(refused, F.concat(F.lit("Method "), "method", F.lit(" Not Allowed")))
    return joined.withColumns({"allow": F.when(refused, allowed_methods("mq_class", "method")), "message": text})


def method_dispatch(method: Column | str = "method") -> Column:
    """The operation a method asks for; methods that no queue serves are ``refuse``."""
    method = F.col(method) if isinstance(method, str) else method
    out = F.when(method.isin(*[m for m in METHODS if m not in OPERATIONS]), "refuse")
    for name, op in OPERATIONS.items():
        out = out.when(method == name, op)
    return out.otherwise("ignore")


def rate_limit(messages: DataFrame) -> DataFrame:
    """Number each request within its channel's period and flag those over ``max_requests``.

    Rows carry ``limit_seconds`` and ``max_requests``; a period of 0 means no limit. Counts run
    per ``(channel, period number)`` and, for hot channels, in slices.
    """
    seconds = F.col("limit_seconds")
    rows = messages.withColumn(
        "bucket", F.when(seconds > 0, F.floor(epoch_seconds("ts") / seconds)).cast("bigint")
    )
    rows = running(rows, {"request_no": F.lit(1)}, keys=("channel", "bucket"))
    over = F.coalesce(F.col("bucket").isNotNull() & (F.col("request_no") > F.col("max_requests")), F.lit(False))
    return rows.withColumn("over_limit", over)


def sweep(intervals: DataFrame, slicing: Slicing | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Turn intervals into ordered start/end rows with ``active``, the number open after each.

    Input: ``channel, start_ts, start_id, end_ts, end_id``, the end null while open.
    """
    edges = F.array(
        F.struct(F.col("start_ts").alias("ts"), F.col("start_id").alias("event_id"), F.lit(1).alias("step")),
        F.struct(F.col("end_ts").alias("ts"), F.col("end_id").alias("event_id"), F.lit(-1).alias("step")),
    )
    rows = intervals.select("channel", *keep, F.explode(edges).alias("e")).select("channel", *keep, "e.*")
    rows = rows.filter(F.col("event_id").isNotNull())
    return running(add_slice(rows, slicing), {"active": F.col("step")})


def peak_concurrency(intervals: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """Largest number of simultaneously open requests per channel."""
    return sweep(intervals, slicing).groupBy("channel").agg(F.max("active").alias("peak"))


def task_limit(intervals: DataFrame, slicing: Slicing | None = None) -> DataFrame:
    """Open requests at every start, flagged above ``limit_tasks`` (0 = no limit)."""
    starts = sweep(intervals, slicing, keep=("limit_tasks",)).filter(F.col("step") == 1)
    over = (F.col("limit_tasks") > 0) & (F.col("active") > F.col("limit_tasks"))
    return starts.select("event_id", "channel", "active", "limit_tasks", over.alias("over_limit"))


def endpoint_down(messages: DataFrame, active: Column | str = "active") -> DataFrame:
    """Status 521 for PUTs to a handler channel that is switched off, null otherwise.

    Other classes keep serving, and other methods are refused as not allowed before. Rows carry ``mq_class``.
    """
    active = F.col(active) if isinstance(active, str) else active
    asked = (F.col("mq_class") == "SyncSAPI") & (F.col("method") == "PUT")
    return messages.withColumn("status", F.when(asked & ~active, F.lit(521)))


def with_channel_config(messages: DataFrame, channels: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """Attach the channel's settings; the table is broadcast only when it has few rows.

    A larger table is joined by shuffle, after which sliced rows are spread over their slices again.
    A period text is turned into seconds here, once per channel and not per message.
    """
    if "limit_period" in channels.columns:
        channels = channels.withColumn("limit_seconds", parse_period("limit_period")).drop("limit_period")
    if channels.select("channel").limit(max_broadcast + 1).count() <= max_broadcast:
        return messages.join(F.broadcast(channels), "channel", "left")
    return spread(messages.join(channels, "channel", "left"))
