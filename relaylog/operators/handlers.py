"""User-written message handlers and queue classes, by name.

A handler takes a batch of messages as a pandas DataFrame and returns one reply text per row,
or None for a message it cannot serve (503). When it raises, the batch is halved until the
failing messages are alone, so an error costs one message and not its batch; its text is the reply.

Handlers of several classes run in one pass: each task takes its batches apart by class, so the
input is read once and nothing is shuffled, however many classes there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylog.operators.bounded import queue_replay_bounded
from relaylog.operators.queue import queue_replay
from relaylog.operators.slices import ORDER, epoch_seconds, running, spread

Handler = Callable[[pd.DataFrame], pd.Series]
ERROR_TEXT = "SAPI Endpoint error"
# Seconds after which a handler channel has taken all that waits, where the caller names none.
DRAIN_SECONDS = 3
_OTHER_CLASS = "of another class"

_handlers: dict[str, Handler] = {}


def register_handler(name: str, handler: Handler) -> None:
    _handlers[name] = handler


def _answer(handler: Handler, batch: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
    """Replies and error texts of a batch; a message without a reply has an error, perhaps an empty one."""
    try:
        replies = pd.Series(handler(batch), index=batch.index).astype(object)
    except Exception as error:
        if len(batch) <= 1:
            nothing = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            return nothing, pd.Series([str(error)] * len(batch), index=batch.index, dtype=object)
        half = len(batch) // 2
        parts = [_answer(handler, batch.iloc[:half]), _answer(handler, batch.iloc[half:])]
        return pd.concat([p[0] for p in parts]), pd.concat([p[1] for p in parts])
    return replies, pd.Series([None] * len(batch), index=batch.index, dtype=object)


def _outcome(handler: Handler | None, batch: pd.DataFrame) -> pd.DataFrame:
    """``status, reply, error`` of each message."""
    if handler is None:
        return pd.DataFrame({"status": 503, "reply": ERROR_TEXT, "error": None}, index=batch.index)
    replies, errors = _answer(handler, batch)
    served = replies.notna()
    return pd.DataFrame({"status": served.map({True: 200, False: 503}), "reply": replies.where(served, ERROR_TEXT), "error": errors})


def _with_outcome(messages: DataFrame) -> T.StructType:
    return T.StructType([
        *messages.schema.fields, T.StructField("status", T.IntegerType()), T.StructField("reply", T.StringType()),
        T.StructField("error", T.StringType()),
    ])


def _answered(messages: DataFrame, outcome: Callable[[pd.DataFrame], pd.DataFrame], asked: str | None = None) -> DataFrame:
    """Add the outcome of the rows that are asked for. Only those become pandas rows, whole numbers stay whole; the rest passes as it is."""
    names = [f.name for f in messages.schema.fields if f.name != asked]
    rows = messages.select(*names, *([asked] if asked else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(batch.column(asked).to_numpy(zero_copy_only=False)) if asked else np.arange(batch.num_rows)
            made = pd.DataFrame({"status": [None] * batch.num_rows, "reply": None, "error": None}, dtype=object)
            if len(at):
                mine = batch.select(names).take(pa.array(at)).to_pandas(integer_object_nulls=True)
                made.loc[at] = outcome(mine).set_axis(at).astype(object)
            made = made.where(made.notna(), None)
            extra = [pa.array(made["status"], pa.int32()), pa.array(made["reply"], pa.string()), pa.array(made["error"], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *extra], [*names, "status", "reply", "error"])

    return rows.mapInArrow(run, _with_outcome(messages.select(*names)))


def apply_handler(messages: DataFrame, handler: Handler | str) -> DataFrame:
    """Run a handler over all rows; adds ``status``, ``reply`` and ``error`` (what the handler raised). Needs no shuffle."""
    run = _handlers[handler] if isinstance(handler, str) else handler
    return _answered(messages, lambda batch: _outcome(run, batch))


def apply_by_class(
    messages: DataFrame, handlers: dict[str, Handler | str], column: str = "sapi_class", where: Column | None = None,
) -> DataFrame:
    """Each message to the handler of its class, in one pass; classes without one are answered with 503.

    With ``where`` only those rows are handled; the others get nulls.
    """
    named = {name: _handlers[h] if isinstance(h, str) else h for name, h in handlers.items()}

    def outcome(batch: pd.DataFrame) -> pd.DataFrame:
        parts = [_outcome(named.get(name), part) for name, part in batch.groupby(batch[column].fillna(""), sort=False)]
        return pd.concat(parts).reindex(batch.index)

    if where is None:
        return _answered(messages, outcome)
    return _answered(messages.withColumn("_asked", F.coalesce(where, F.lit(False))), outcome, "_asked")


def handler_chain(messages: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Pass messages through stages in order."""
    return reduce(lambda df, stage: df.transform(stage), stages, messages)


def handler_queue(messages: DataFrame, drain_seconds: int = DRAIN_SECONDS) -> DataFrame:
    """What a handler channel does with each row before a handler runs: add ``status`` and ``queue_limit``.

    405 for all but PUT, 521 where the channel is switched off (``active``), 507 where ``limit_size`` messages already
    wait (0 or null: no limit), null for messages that a handler shall answer. The channel takes all that waits at once,
    every ``drain_seconds``; so at most ``limit_size`` messages are accepted in between.
    """
    put = F.col("method") == "PUT"
    active = F.coalesce(F.col("active"), F.lit(True)) if "active" in messages.columns else F.lit(True)
    open_put = put & active
    rows = messages.withColumn("_drain", F.floor(epoch_seconds("ts") / F.lit(drain_seconds)).cast("bigint"))
    rows = running(rows, {"_put": F.when(open_put, 1).otherwise(0)}, keys=("channel", "_drain"), order=ORDER)
    limit = F.coalesce(F.col("limit_size"), F.lit(0)) if "limit_size" in messages.columns else F.lit(0)
    full = (limit > 0) & (F.col("_put") > limit)
    status = F.when(~put, 405).when(~active, 521).when(full, 507)
    return rows.withColumns({
        "status": F.coalesce(status, F.when(F.col("method").isNull(), F.lit(405))).cast("int"),
        "queue_limit": F.when(open_put & full, limit.cast("bigint")),
    }).drop("_drain", "_put")


# What each class of queue does, by name: SyncQueue replays its channels, SyncSAPI runs handlers.
QUEUE, HANDLER = "queue", "handler"
_queue_classes: dict[str, str] = {"SyncQueue": QUEUE, "SyncSAPI": HANDLER}


def register_queue_class(name: str, kind: str) -> None:
    """Give a class of channels the behaviour of a queue or of handlers."""
    if kind not in (QUEUE, HANDLER):
        raise ValueError(f"a queue class is of kind {QUEUE!r} or {HANDLER!r}")
    _queue_classes[name] = kind


def queue_by_class(
    messages: DataFrame, handlers: dict[str, Handler | str] | None = None, column: str = "mq_class",
    handler_column: str = "sapi_class", drain_seconds: int = DRAIN_SECONDS,
) -> DataFrame:
    """All rows of all channels answered by the class each channel names, in one pass over the input.

    Adds to a replay (``status, q, pend, msgs`` …) ``reply`` and ``error`` of handlers. Rows of a class of handlers have no effect on
    queues and no counters; there is no endpoint (404) for rows of an unknown class or none. With a ``limit_size`` column queues are
    bounded.
    """
    of_kind = {k: [name for name, kind in _queue_classes.items() if kind == k] for k in (QUEUE, HANDLER)}
    queued, handled = (F.coalesce(F.col(column).isin(*of_kind[k]), F.lit(False)) for k in (QUEUE, HANDLER))
    rows = handler_queue(messages, drain_seconds).withColumnsRenamed({"status": "_status", "queue_limit": "_queue_limit"})
    rows = rows.withColumns({"_method": F.col("method"), "method": F.when(queued, F.col("method")).otherwise(_OTHER_CLASS)})
    rows = spread(rows)
    bounded = "limit_size" in messages.columns
    replay = queue_replay_bounded(rows) if bounded else queue_replay(rows).withColumn("x_mq_queue_limit", F.lit(None).cast("bigint"))
    status = F.when(queued, F.col("status")).when(handled, F.col("_status")).otherwise(404)
    replay = replay.withColumns({
        "method": F.col("_method"), "_own": status.cast("int"),
        "x_mq_queue_limit": F.when(queued, F.col("x_mq_queue_limit")).when(handled, F.col("_queue_limit")),
        **{c: F.when(queued, F.col(c)) for c in ("q", "pend", "msgs")},
    }).drop("status", "_status", "_method", "_queue_limit")
    if handler_column not in replay.columns:
        replay = replay.withColumn(handler_column, F.lit(None).cast("string"))
    made = apply_by_class(replay, handlers or {}, handler_column, where=handled & F.col("_own").isNull())
    return made.withColumn("status", F.coalesce("_own", "status")).drop("_own")
