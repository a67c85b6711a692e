"""Queues with a size limit: a PUT is refused (507) while ``limit_size`` messages wait.

The depth is a walk held between 0 and the limit, which windows cannot express. Every row maps the depth before
it to the depth after it by ``min(hi, max(lo, q + add))``, and such maps compose. Rows stream in order through
``mapInPandas``; within a batch all maps up to each row are composed by doubling in numpy, and one depth is
carried from batch to batch, so no group is ever gathered. A hot channel is cut into slices; the map of a whole
slice gives every slice its start by one short scan over the slices, and all slices replay in parallel.

A refused PUT changes nothing, so the full replay with limits is the unlimited replay of the other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylog.operators.queue import queue_replay
from relaylog.operators.slices import ORDER, is_sliced, spread
from relaylog.session import materialise

NO_LIMIT = 1 << 62
REFUSED = "refused PUT"


def _steps(messages: DataFrame) -> DataFrame:
    limit = F.when(F.coalesce("limit_size", F.lit(0)) > 0, F.col("limit_size")).otherwise(F.lit(NO_LIMIT))
    return messages.filter(F.col("method").isin("PUT", "GET")).select(
        "event_id", "ts", "channel", "method", limit.cast("bigint").alias("_limit"),
        F.when(F.col("method") == "PUT", 1).otherwise(-1).cast("bigint").alias("_step"),
        *([F.col("slice")] if is_sliced(messages) else [F.lit(-1).cast("bigint").alias("slice")]),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("channel", "slice").sortWithinPartitions("channel", "slice", *ORDER)


def _same(left: pd.Series, right: pd.Series) -> np.ndarray:
    return ((left == right) | (left.isna() & right.isna())).fillna(False).to_numpy(bool)


def _groups(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """For every row the place of its group's first row in this batch; null is a key like any other."""
    same = np.ones(len(pdf), bool)
    for key in keys:
        same &= _same(pdf[key], pdf[key].shift())
    same[:1] = False
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(pdf))))


def _compose(maps: np.ndarray, head: np.ndarray) -> np.ndarray:
    """All maps from the head of each row's group up to the row, by doubling. Columns: add, lo, hi."""
    maps, place, reach = maps.copy(), np.arange(len(maps)), 1
    while reach < len(maps):
        at = np.flatnonzero(place - reach >= head)
        if not len(at):
            break
        before, own = maps[at - reach], maps[at]
        low, high = (np.minimum(own[:, 2], np.maximum(own[:, 1], before[:, c] + own[:, 0])) for c in (1, 2))
        maps[at] = np.stack([before[:, 0] + own[:, 0], low, high], axis=1)
        reach *= 2
    return maps


def _apply(maps: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.minimum(maps[:, 2], np.maximum(maps[:, 1], q + maps[:, 0]))


def _row_maps(pdf: pd.DataFrame) -> np.ndarray:
    limit = pdf["_limit"].to_numpy(np.int64)
    return np.stack([pdf["_step"].to_numpy(np.int64), np.zeros(len(pdf), np.int64), limit], axis=1)


def _continues(last: pd.DataFrame | None, pdf: pd.DataFrame, keys: list[str]) -> bool:
    return last is not None and all(_same(last[k].reset_index(drop=True), pdf[k].iloc[:1].reset_index(drop=True))[0] for k in keys)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, q, keys = None, 0, ["channel", "slice"]
    for pdf in batches:
        if not len(pdf):
            continue
        head, step, limit = _groups(pdf, keys), pdf["_step"].to_numpy(np.int64), pdf["_limit"].to_numpy(np.int64)
        start = pdf["_start"].to_numpy(np.int64)[head]
        if _continues(last, pdf, keys):
            start[head == 0] = q
        after = _apply(_compose(_row_maps(pdf), head), start)
        before = np.where(head == np.arange(len(pdf)), start, np.concatenate([[0], after[:-1]]))
        status = np.where(step > 0, np.where(before < limit, 202, 507), np.where(before > 0, 200, 204))
        last, q = pdf[keys].iloc[-1:], int(after[-1])
        yield pdf[["event_id", "channel", "method", "_limit"]].assign(status=status.astype("int32"), q=after)


def _slice_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The composed map of every slice."""
    names, keys, carried = ["add", "lo", "hi"], ["channel", "slice"], None
    for pdf in batches:
        if not len(pdf):
            continue
        head = _groups(pdf, keys)
        maps = _compose(_row_maps(pdf), head)
        ends = np.flatnonzero(np.append(head[1:] != head[:-1], True))
        done = pdf[keys].iloc[ends].reset_index(drop=True)
        done[names] = maps[ends]
        if _continues(carried, pdf, keys):
            both = np.stack([carried[names].to_numpy(np.int64)[0], done[names].to_numpy(np.int64)[0]])
            done.loc[:0, names] = _compose(both, np.zeros(2, np.int64))[1:]
        elif carried is not None:
            yield carried
        yield done.iloc[:-1]
        carried = done.iloc[-1:]
    if carried is not None:
        yield carried


def _slice_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, q, keys = None, 0, ["channel"]
    for pdf in batches:
        if not len(pdf):
            continue
        head = _groups(pdf, keys)
        start = np.where((head == 0) & _continues(last, pdf, keys), q, 0)
        after = _apply(_compose(pdf[["add", "lo", "hi"]].to_numpy(np.int64), head), start)
        before = np.where(head == np.arange(len(pdf)), start, np.concatenate([[0], after[:-1]]))
        last, q = pdf[keys].iloc[-1:], int(after[-1])
        yield pdf[["channel", "slice"]].assign(_start=before)


def _schema(rows: DataFrame, *fields: str) -> T.StructType:
    """Fields of the input by name, others as ``name type``; keys keep the type they come with."""
    made = [f.split() for f in fields]
    return T.StructType([
        T.StructField(f[0], T._parse_datatype_string(f[1]) if len(f) > 1 else rows.schema[f[0]].dataType) for f in made
    ])


def bounded_queue(messages: DataFrame) -> DataFrame:
    """Status (PUT 202/507, GET 200/204) and depth after every PUT and GET; other methods leave the depth alone
    and are not returned (``queue_replay_bounded`` answers them all).

    Rows carry ``limit_size`` (0 or null = no limit). A refusal names the limit in ``queue_limit``.
    """
    rows = _steps(messages)
    if is_sliced(messages):
        rows = materialise(rows, "steps")
        maps = _in_order(rows.filter(F.col("slice") >= 0)).mapInPandas(
            _slice_maps, _schema(rows, "channel", "slice bigint", "add bigint", "lo bigint", "hi bigint")
        )
        starts = maps.repartition("channel").sortWithinPartitions("channel", "slice").mapInPandas(
            _slice_starts, _schema(rows, "channel", "slice bigint", "_start bigint")
        )
        starts = starts.withColumnsRenamed({"channel": "_channel", "slice": "_slice"})
        same = F.col("channel").eqNullSafe(F.col("_channel")) & (F.col("slice") == F.col("_slice"))
        rows = rows.join(starts, same, "left").drop("_channel", "_slice").fillna(0, ["_start"])
    else:
        rows = rows.withColumn("_start", F.lit(0).cast("bigint"))
    walked = _in_order(rows).mapInPandas(
        _walk, _schema(rows, "event_id", "channel", "method", "_limit bigint", "status int", "q bigint")
    )
    return walked.withColumn("queue_limit", F.when(F.col("status") == 507, F.col("_limit"))).drop("_limit")


def queue_replay_bounded(messages: DataFrame) -> DataFrame:
    """``queue_replay`` of all methods with limits: refused PUTs get 507 and the limit, and hold nothing.

    Rows carry ``limit_size``. ``(channel, event_id)`` names a row.
    """
    refused = bounded_queue(messages).filter(F.col("status") == 507).select(
        F.col("channel").alias("_channel"), F.col("event_id").alias("_event_id"), F.col("queue_limit").alias("x_mq_queue_limit")
    )
    same = F.col("channel").eqNullSafe(F.col("_channel")) & (F.col("event_id") == F.col("_event_id"))
    marked = messages.join(refused, same, "left").drop("_channel", "_event_id")
    over = F.col("x_mq_queue_limit").isNotNull()
    replay = queue_replay(spread(marked.withColumn("method", F.when(over, REFUSED).otherwise(F.col("method")))))
    over = F.col("method") == REFUSED
    return replay.withColumns({"status": F.when(over, 507).otherwise(F.col("status")), "method": F.when(over, "PUT").otherwise(F.col("method"))})
