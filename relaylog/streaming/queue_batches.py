"""The request/reply queue as a chain of batch replays, for streams with hot channels.

A stateful processor owns a channel in one task. Here every micro-batch is replayed by the batch
operators instead, which cut a hot channel into slices, and the state travels in generations of
tables (``sources/generations.py``): a batch reads and rewrites only the messages it touches.

State and output belong to a batch id and are overwritten when that batch runs again, so a
failure between two writes leaves neither a gap nor a second copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.operators.slices import ROWS_PER_SLICE
from relaylog.schema import MESSAGE
from relaylog.sources.generations import Generations, advance, overwritten

RESULT = ("event_id", "channel", "method", "status", "q", "pend", "msgs")
_COLUMNS = [f.name for f in MESSAGE.fields]


def queue_batches(
    root: str, delay: str, rows_per_slice: int = ROWS_PER_SLICE
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that replays rows in order once they are ``delay`` old.

    Under ``root`` it writes ``replay`` (results), ``late`` (rows behind the replayed time, not
    applied) and ``pending`` (not yet due), each by ``batch_id``, and ``state``.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = Generations(spark, f"{root}/state", batch_id - 1, spark.createDataFrame([], MESSAGE))
        done = state.horizon
        batch = batch.select(*_COLUMNS).persist()
        try:
            behind = F.lit(False) if done is None else F.col("ts") <= F.lit(done).cast("timestamp_ntz")
            overwritten(batch.filter(behind), f"{root}/late/batch_id={batch_id}")
            rows = batch.filter(~behind)
            if batch_id > 0:
                rows = rows.unionByName(spark.read.schema(MESSAGE).parquet(f"{root}/pending/batch_id={batch_id - 1}"))
            newest = rows.agg((F.max("ts") - F.expr(f"interval {delay}")).cast("string").alias("t")).first().t
            horizon = max(filter(None, (newest, done)), default=None)
            ready = F.lit(False) if horizon is None else F.col("ts") <= F.lit(horizon).cast("timestamp_ntz")
            overwritten(rows.filter(~ready), f"{root}/pending/batch_id={batch_id}")
            due = overwritten(rows.filter(ready), f"{root}/state/work/gen={batch_id}/due")
        finally:
            batch.unpersist()
        if due.isEmpty():
            state.carry(horizon, batch_id)
            result = due.select("event_id", "channel", "method", F.lit(0).alias("status"), *[F.lit(0).cast("bigint").alias(c) for c in ("q", "pend", "msgs")])
        else:
            result, _ = advance(state, due, horizon, batch_id, rows_per_slice)
        overwritten(result.select(*RESULT), f"{root}/replay/batch_id={batch_id}")

    return step
