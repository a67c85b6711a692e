"""From captures to replies in one job.

Captured requests of any number of listeners are read, routed to declared channels and answered by the class each
channel names, with limits, handlers and every counter. Every input row comes out once, with the reply its sender
hears in the end, on one of four lanes: ``queue``, ``handler``, ``unrouted`` (no such endpoint) and ``unparsed``
(not a request). The last two are the dead letters.

The plan is one chain: what a row cannot take part in is left null, nothing is filtered away and unioned back, so captures
are parsed once. Rows without a channel get a key of their own, so that dead letters do not meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.operators.handlers import DRAIN_SECONDS, Handler, queue_by_class
from relaylog.operators.ids import message_uid
from relaylog.operators.routing import route_match
from relaylog.operators.slices import ROWS_PER_SLICE, add_slice, plan_slices
from relaylog.schema import DEFAULT_HEADER_LIMIT, DEFAULT_QUERY_LIMIT
from relaylog.session import materialise
from relaylog.sources.capture import header, parse_requests, parsed_once
from relaylog.sources.channels import channel_table, routes_of
from relaylog.sources.replies import reply_of_each

LANES = ("queue", "handler", "unrouted", "unparsed")
_CHANNEL_COLUMNS = ("limit_size", "active")


@dataclass(frozen=True)
class Settings:
    """What the exchange is set up with.

    ``channels``: ``channel, endpoint, sapi`` and, where wanted, ``limit_size`` and ``active``. ``listeners``: ``listener,
    query_limit, header_limit``; others have the defaults. ``handlers``: by class of script.
    """

    channels: DataFrame
    listeners: DataFrame | None = None
    handlers: dict[str, Handler | str] | None = None
    drain_seconds: int = DRAIN_SECONDS
    rows_per_slice: int = ROWS_PER_SLICE
    max_broadcast: int = 100_000


def routed_requests(captures: DataFrame, settings: Settings) -> DataFrame:
    """Requests as rows of a message log, with ``route``, ``mq_class`` and ``refusal``, the code of what is no request.

    Captures carry ``event_id, ts, listener, raw`` and, where known, ``read_error``.
    """
    rows = captures
    if settings.listeners is not None:
        rows = rows.join(F.broadcast(settings.listeners), "listener", "left")
        query, head = F.coalesce("query_limit", F.lit(DEFAULT_QUERY_LIMIT)), F.coalesce("header_limit", F.lit(DEFAULT_HEADER_LIMIT))
    else:
        query, head = F.lit(DEFAULT_QUERY_LIMIT), F.lit(DEFAULT_HEADER_LIMIT)
    error = F.coalesce("read_error", F.lit(False)) if "read_error" in captures.columns else None
    parsed = parsed_once(parse_requests(rows, query_limit=query, header_limit=head, read_error=error))
    parsed = parsed.select(
        "event_id", "ts", "listener", "uri", F.when(F.col("code") == 0, F.col("method")).alias("method"),
        F.when(F.col("code") != 0, F.col("code")).alias("refusal"), message_uid("ts", "event_id").alias("uid"),
        header("x-msg-forward-uid").alias("fwd"), header("content-type").alias("content_type"),
        F.col("body").cast("string").alias("content"),
    )
    # A few rows, asked for as routes and as settings.
    table = materialise(channel_table(settings.channels).filter(F.col("status") == "ok"), "channels")
    chosen = table.select(
        F.col("channel").alias("route"), "mq_class", "sapi_class", *[c for c in _CHANNEL_COLUMNS if c in settings.channels.columns]
    )
    if chosen.limit(settings.max_broadcast + 1).count() <= settings.max_broadcast:
        chosen = F.broadcast(chosen)
    routed = route_match(parsed, routes_of(table), "uri").join(chosen, "route", "left")
    own = F.concat(F.lit("\x00"), F.coalesce(F.col("event_id").cast("string"), F.lit("")), F.lit(" "), "listener")
    for column, kind in (("limit_size", "bigint"), ("active", "boolean")):
        if column not in routed.columns:
            routed = routed.withColumn(column, F.lit(None).cast(kind))
    return routed.withColumns({"channel": F.coalesce("route", own), "limit_size": F.coalesce(F.col("limit_size").cast("bigint"), F.lit(0))})


def exchange(captures: DataFrame, settings: Settings) -> DataFrame:
    """The reply to every captured request, one row each, with ``lane``.

    Rows of one channel are taken in the order ``(ts, event_id)``; hot channels are cut into slices.
    """
    # Slicing asks for the rows before the replay does.
    rows = materialise(routed_requests(captures, settings), "requests")
    rows = add_slice(rows, plan_slices(rows, rows_per_slice=settings.rows_per_slice))
    answered = queue_by_class(rows, settings.handlers, drain_seconds=settings.drain_seconds)
    lane = F.when(F.col("mq_class") == "SyncSAPI", "handler").otherwise("queue")
    return reply_of_each(answered.withColumn("lane", lane))


def write_lanes(replies: DataFrame, path: str) -> None:
    """All lanes in one pass, a folder each, and in it one for each day."""
    replies.withColumn("day", F.to_date("ts")).write.partitionBy("lane", "day").mode("append").parquet(path)
