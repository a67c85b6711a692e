"""Message uids: arrival second in the high 32 bits, arrival counter in the low 32 bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylog.operators.slices import ORDER, epoch_seconds, running


def message_uid(ts: Column | str, counter: Column | str) -> Column:
    counter = F.col(counter) if isinstance(counter, str) else counter
    low = counter.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.shiftleft(epoch_seconds(ts), 32).bitwiseOR(low)


def uid_second(uid: Column | str) -> Column:
    return F.shiftrightunsigned(uid, 32)


def uid_counter(uid: Column | str) -> Column:
    uid = F.col(uid) if isinstance(uid, str) else uid
    return uid.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def assign_uids(messages: DataFrame, keys: Sequence[str] = ("process",), order: Sequence[str] = ORDER) -> DataFrame:
    """Uids for a log without ids: the counter is the arrival number within the process.

    The numbering is a running count per process. One process usually holds the whole log, so
    pass rows with a ``slice`` column (see ``plan_slices``): the counts then run in parallel.
    """
    counted = running(messages, {"_n": F.lit(1)}, keys=keys, order=order)
    return counted.withColumn("uid", message_uid("ts", F.col("_n") - 1)).drop("_n")
