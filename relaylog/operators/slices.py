"""Ordered scans that stay parallel when one key holds a large share of all rows.

A queue is replayed in arrival order per channel, which a window partitioned by the channel
expresses directly. That puts a whole channel in one task, so a channel above
``rows_per_slice`` is cut into time slices. Every scan then runs inside ``(key, slice)``; the
slice totals, one narrow row per slice, are scanned per key and added back as offsets.

A slice spans as many ticks as its channel's busiest one allows. A tick with more rows than a slice may have is cut by
splitters on ``(ts, event_id)``, taken from a hash sample (which adds up over tasks) and checked by exact counts, with a
denser sample until no part exceeds the bound. Only rows equal in both stay together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "event_id")
ROWS_PER_SLICE = 4_000_000
TICK_SECONDS = 60
MAX_BROADCAST_KEYS = 10_000


# Parts of one tick are numbered within this many.
_PARTS = 1 << 20
# Rows of a sample for each part.
_SAMPLED = 64
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Slicing:
    """Which keys are cut, and how: one row ``(keys…, first_tick, width)`` per hot key, and ``(keys…, number, dense)`` with the ticks
    that are cut themselves, and their splitters, for each span of ``width`` ticks that has some."""

    keys: tuple[str, ...]
    hot: DataFrame | None
    tick_seconds: int
    small: bool
    dense: DataFrame | None = None
    dense_small: bool = True


def epoch_seconds(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(ts.cast("timestamp"))


def _tick(ts: Column | str, seconds: int) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(seconds)).cast("bigint")


def _moment() -> Column:
    """Place of a row in its channel; a row without an id comes after the others of its time."""
    return F.struct(F.col("ts"), F.coalesce(F.col("event_id").cast("bigint"), F.lit(_LAST)).alias("event_id"))


def _join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which null is a key like any other."""
    other = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(other, same, how).drop(*[f"_k_{k}" for k in keys])


def _bounded(rows: DataFrame, bound: int) -> tuple[DataFrame | None, bool]:
    """A table as local rows where it has at most ``bound``, as it is above that, None where it is empty."""
    head = rows.take(bound + 1)
    if not head:
        return None, True
    return (rows.sparkSession.createDataFrame(head, rows.schema), True) if len(head) <= bound else (rows, False)


def plan_slices(
    df: DataFrame,
    keys: Sequence[str] = ("channel",),
    rows_per_slice: int = ROWS_PER_SLICE,
    tick_seconds: int = TICK_SECONDS,
    max_broadcast: int = MAX_BROADCAST_KEYS,
) -> Slicing:
    """Find the keys that need slicing: one pre-aggregated count per key, and more only where some key is hot.

    At most ``rows / rows_per_slice`` keys can be hot, and as many ticks dense. Up to ``max_broadcast`` of them become a
    small local table, above that they stay a DataFrame that is joined by shuffle.
    """
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") > rows_per_slice)
    hot, small = _bounded(totals.select(*keys), max_broadcast)
    if hot is None:
        return Slicing(tuple(keys), None, tick_seconds, True)
    rows = _join_null_safe(df, F.broadcast(hot) if small else hot, keys, "inner")
    per_tick = rows.groupBy(*keys, _tick("ts", tick_seconds).alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    peak = F.max(F.when(F.col("n") <= rows_per_slice, F.col("n")))
    widths = per_tick.groupBy(*keys).agg(F.min("tick").alias("first_tick"), peak.alias("peak")).select(
        *keys, "first_tick", F.greatest(F.lit(1), F.floor(F.lit(rows_per_slice) / F.coalesce("peak", F.lit(rows_per_slice)))).cast("bigint").alias("width"),
    )
    hot, small = _bounded(widths, max_broadcast)
    dense, dense_small = _bounded(per_tick.filter(F.col("n") > rows_per_slice), max_broadcast)
    if dense is not None:
        splits = _split(rows, dense, dense_small, keys, rows_per_slice, tick_seconds, max_broadcast)
        splits = _join_null_safe(splits, F.broadcast(hot) if small else hot, keys, "inner").withColumn("number", _span(F.col("tick")))
        ticks = F.sort_array(F.collect_list(F.struct("tick", "splitters")))
        dense, dense_small = _bounded(splits.groupBy(*keys, "number").agg(ticks.alias("dense")), max_broadcast)
    return Slicing(tuple(keys), hot, tick_seconds, small, dense, dense_small)


def _split(
    rows: DataFrame, dense: DataFrame, small: bool, keys: Sequence[str], rows_per_slice: int, tick_seconds: int, max_broadcast: int,
) -> DataFrame:
    """``keys, tick, splitters`` of the dense ticks: a part begins at each splitter."""
    every = max(1, rows_per_slice // _SAMPLED)
    rows = rows.select(*keys, _tick("ts", tick_seconds).alias("tick"), "ts", "event_id")
    rows = _join_null_safe(rows, (F.broadcast(dense) if small else dense).select(*keys, "tick"), [*keys, "tick"], "inner")
    while True:
        # With all rows in the sample parts are exact, otherwise they aim at half the bound.
        step = rows_per_slice if every == 1 else max(1, rows_per_slice // (2 * every))
        drawn = F.pmod(F.xxhash64("ts", "event_id"), F.lit(every)) == 0
        moments = F.sort_array(F.collect_list(_moment()))
        at = F.sequence(F.lit(step), F.size("m") - 1, F.lit(step))
        splits = rows.filter(drawn).groupBy(*keys, "tick").agg(moments.alias("m")).select(
            *keys, "tick", F.when(F.size("m") > step, F.transform(at, lambda i: F.get("m", i))).otherwise(F.slice("m", 1, 0)).alias("splitters"),
        )
        splits, splits_small = _bounded(splits, max_broadcast)
        if splits is not None:
            parts = _join_null_safe(rows, F.broadcast(splits) if splits_small else splits, [*keys, "tick"])
            most = parts.groupBy(*keys, "tick", _part(F.col("splitters")).alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            if every == 1 or most <= rows_per_slice:
                return splits
        every = max(1, every // 4)


def _part(splitters: Column) -> Column:
    moment = _moment()
    return F.coalesce(F.size(F.filter(splitters, lambda s: s <= moment)), F.lit(0))


def _span(tick: Column) -> Column:
    return F.floor((tick - F.col("first_tick")) / F.col("width")).cast("bigint")


def add_slice(df: DataFrame, slicing: Slicing | None) -> DataFrame:
    """Add ``slice``: number of the slice for hot keys, -1 for all others. Numbers follow the order ``(ts, event_id)``.

    Without hot keys the rows are returned as they are, and later scans need no offsets.
    """
    if slicing is None or slicing.hot is None:
        return df
    hot = F.broadcast(slicing.hot) if slicing.small else slicing.hot
    tick = _tick("ts", slicing.tick_seconds)
    out = _join_null_safe(df, hot, slicing.keys)
    if slicing.dense is None:
        out = out.withColumn("slice", F.coalesce(_span(tick), F.lit(-1)))
    else:
        # A dense tick ends the slice before it, and another slice begins after it.
        dense = F.broadcast(slicing.dense) if slicing.dense_small else slicing.dense
        out = _join_null_safe(out.withColumns({"tick": tick, "number": _span(tick)}), dense, [*slicing.keys, "number"])
        now = F.col("tick")
        own = F.get(F.filter("dense", lambda d: d["tick"] == now), 0)
        last = F.array_max(F.transform(F.filter("dense", lambda d: d["tick"] < now), lambda d: d["tick"]))
        begin = F.greatest(F.col("number") * F.col("width"), last + 1 - F.col("first_tick")) * _PARTS
        cut = (now - F.col("first_tick")) * _PARTS + 1 + _part(own["splitters"])
        number = F.when(own.isNotNull(), cut).otherwise(begin)
        out = out.withColumn("slice", F.coalesce(number, F.lit(-1)).cast("bigint")).drop("tick", "number", "dense")
    out = out.drop("first_tick", "width")
    return out if slicing.small and slicing.dense_small else spread(out, slicing.keys)


def spread(df: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Partition sliced rows by ``(keys, slice)``.

    Needed after a shuffle join on the keys alone: Spark would take that partitioning as good
    enough for a window over ``(keys, slice)`` and leave a hot key in one task.
    """
    return df.repartition(*keys, "slice") if is_sliced(df) else df


def is_sliced(df: DataFrame) -> bool:
    return "slice" in df.columns


def running(
    df: DataFrame,
    sums: dict[str, Column],
    lows: dict[str, tuple[str, bool]] | None = None,
    keys: Sequence[str] = ("channel",),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Running sums per key in ``order``, and running minima of those sums.

    ``sums`` maps a new column to the step to add per row. ``lows`` maps a new column to
    ``(sum column, include current row)``. All windows share one shuffle and one sort.
    """
    lows = lows or {}
    part = [*keys, "slice"] if is_sliced(df) else list(keys)
    spec = Window.partitionBy(*part).orderBy(*order)
    here = spec.rowsBetween(Window.unboundedPreceding, 0)
    past = spec.rowsBetween(Window.unboundedPreceding, -1)

    out = df.withColumns({name: F.sum(step).over(here) for name, step in sums.items()})
    if lows:
        out = out.withColumns(
            {name: F.min(src).over(here if current else past) for name, (src, current) in lows.items()}
        )
    if not is_sliced(df):
        return out

    # Sums need no order; only minima are taken from the rows after the scan.
    totals = (
        (out if lows else df).filter(F.col("slice") >= 0)
        .groupBy(*part)
        .agg(
            *[F.sum(step).alias(f"_t_{name}") for name, step in sums.items()],
            *[F.min(src).alias(f"_l_{name}") for name, (src, _) in lows.items()],
        )
    )
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumns({f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in sums})
    if lows:
        offsets = offsets.withColumns(
            {f"_m_{n}": F.min(F.col(f"_o_{src}") + F.col(f"_l_{n}")).over(before) for n, (src, _) in lows.items()}
        )
    offsets = offsets.select(*part, *[f"_o_{n}" for n in sums], *[f"_m_{n}" for n in lows])
    # Null is a key like any other, as it is for the windows.
    offsets = offsets.withColumnsRenamed({c: f"_k_{c}" for c in part})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part])
    joined = out.join(offsets, same, "left").drop(*[f"_k_{c}" for c in part])
    shifted = {n: F.col(n) + F.coalesce(f"_o_{n}", F.lit(0)) for n in sums}
    shifted |= {
        n: F.least(F.col(f"_m_{n}"), F.col(n) + F.coalesce(f"_o_{src}", F.lit(0))) for n, (src, _) in lows.items()
    }
    return joined.withColumns(shifted).drop(*[f"_o_{n}" for n in sums], *[f"_m_{n}" for n in lows])


def carry_forward(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = ("channel",),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Fill nulls of ``columns`` with the last value seen before, per key in ``order``."""
    part = [*keys, "slice"] if is_sliced(df) else list(keys)
    here = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({c: F.last(c, ignorenulls=True).over(here) for c in columns})
    if not is_sliced(df):
        return out
    known = F.struct(*columns)
    moment = F.struct(*order)
    ends = (
        out.filter(F.col("slice") >= 0)
        .groupBy(*part)
        .agg(F.max_by(known, moment).alias("_end"))
        .select(*part, *[F.col(f"_end.{c}").alias(f"_c_{c}") for c in columns])
    )
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_c_{c}": F.last(f"_c_{c}", ignorenulls=True).over(before) for c in columns})
    ends = ends.withColumnsRenamed({c: f"_k_{c}" for c in part})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in part])
    return (
        out.join(ends, same, "left").drop(*[f"_k_{c}" for c in part])
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_c_{c}")) for c in columns})
        .drop(*[f"_c_{c}" for c in columns])
    )
