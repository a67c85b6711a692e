"""Traffic, latency and uniqueness reports over replayed queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylog.session import materialise

# A summary's ranks are off by n / ACCURACY at most, so by nothing for less than half as many values; others are found by narrowing.
ACCURACY = 10_000
BUCKETS = 1024
FRACTIONS = {"p50": 0.5, "p95": 0.95}
# Size of a sketch of uids: 2^12 registers.
SKETCH_BITS = 12
STAGES = ("wait", "service", "total")


def traffic_stats(replay: DataFrame) -> DataFrame:
    return replay.groupBy("channel", "method", "status").agg(F.count(F.lit(1)).alias("requests"))


def telemetry(trace: DataFrame, reading_at: Column | None = None, finished_at: Column | None = None) -> DataFrame:
    """The five timestamps of a message in epoch microseconds, null while unset.

    Reading and finishing are no operations of the queue: give them as columns of the trace, from a telemetry
    header for instance. A consumer that hits an already answered message (503) leaves no timestamp.
    """
    unknown = F.lit(None).cast("bigint")
    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    return trace.select(
        "channel",
        "uid",
        micros("put_ts").alias("created_at"),
        (unknown if reading_at is None else reading_at).alias("reading_at"),
        F.when(F.col("get_status") == 200, micros("get_ts")).alias("emplaced_at"),
        micros("post_ts").alias("extracted_at"),
        (unknown if finished_at is None else finished_at).alias("finished_at"),
    )


def stage_latency(tele: DataFrame) -> DataFrame:
    return tele.withColumns({
        "wait": F.col("emplaced_at") - F.col("created_at"),
        "service": F.col("extracted_at") - F.col("emplaced_at"),
        "total": F.col("finished_at") - F.col("created_at"),
    })


def latency_stats(tele: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Count, min, max, sum, median and 95th percentile of wait, service and total per channel, all exact.

    Percentiles are values that occur (lower rank). One pass of mergeable summaries is exact for channels of less than
    ``accuracy / 2`` messages; for busier ones ``narrowed_ranks`` replaces them.
    """
    stages = stage_latency(tele)
    aggs = []
    for stage in STAGES:
        aggs += [
            F.count(stage).alias(f"{stage}_n"),
            F.min(stage).alias(f"{stage}_min"),
            F.max(stage).alias(f"{stage}_max"),
            F.sum(stage).alias(f"{stage}_sum"),
            *[F.percentile_approx(stage, f, accuracy).alias(f"{stage}_{name}") for name, f in FRACTIONS.items()],
        ]
    stats = materialise(stages.groupBy("channel").agg(*aggs), "latency")
    busy = stats.filter(2 * F.greatest(*[F.col(f"{s}_n") for s in STAGES]) >= accuracy)
    if busy.isEmpty():
        return stats
    values = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("value")) for s in STAGES])
    rows = stages.join(busy.select(F.col("channel").alias("_channel")), F.col("channel").eqNullSafe(F.col("_channel")), "left_semi")
    rows = rows.select("channel", F.explode(values).alias("v")).select("channel", "v.*").filter(F.col("value").isNotNull())
    rows = materialise(rows, "latency-values")
    ranks = narrowed_ranks(rows, ("channel", "stage"), "value", FRACTIONS, accuracy)
    wide = ranks.groupBy("channel").agg(F.lit(True).alias("_busy"), *[
        F.max(F.when((F.col("stage") == s) & (F.col("name") == name), F.col("value"))).alias(f"_{s}_{name}") for s in STAGES for name in FRACTIONS
    ])
    both = stats.join(wide.withColumnRenamed("channel", "_channel"), F.col("channel").eqNullSafe(F.col("_channel")), "left")
    exact = {f"{s}_{name}": F.when(F.col("_busy"), F.col(f"_{s}_{name}")).otherwise(F.col(f"{s}_{name}")) for s in STAGES for name in FRACTIONS}
    return both.withColumns(exact).select(*stats.columns)


def narrowed_ranks(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], small: int = ACCURACY) -> DataFrame:
    """``keys, name, value``: for each key and fraction the smallest whole number with at least that share of values at or below it.

    Each round counts the values between two bounds in ``BUCKETS`` buckets for each key, fraction and bucket (added up
    before the shuffle), and takes the bucket that holds the rank for new bounds, until it is one number wide or holds at most
    ``small`` values, which are then ranked. No task sees the values of a key; a range of 2^40 takes four rounds.
    """
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f).alias("f")) for n, f in fractions.items()])
    state = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).filter(F.col("n") > 0)
    state = state.select(*keys, "lo", "hi", "n", F.explode(names).alias("_f")).select(
        *keys, "_f.name", "lo", "hi", "n", F.greatest(F.lit(1), F.ceil(F.col("_f.f") * F.col("n"))).cast("bigint").alias("rank"),
    )

    def between(state: DataFrame) -> DataFrame:
        bounds = state.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        met = rows.select(*keys, F.col(value).alias("_v")).join(bounds, same)
        return met.filter(F.col("_v").between(F.col("lo"), F.col("hi"))).drop(*[f"_{k}" for k in keys])

    def holding(counted: DataFrame, order: str) -> DataFrame:
        """Of each key and fraction the row in which the rank is reached, with ``before``, the values in front of it."""
        spec = Window.partitionBy(*keys, "name").orderBy(order)
        reached = F.sum("c").over(spec)
        out = counted.withColumns({"_reached": reached, "before": reached - F.col("c")})
        return out.filter((F.col("_reached") >= F.col("rank")) & (F.col("before") < F.col("rank"))).drop("_reached")

    while True:
        state = materialise(state, "ranks")
        if state.filter((F.col("hi") > F.col("lo")) & (F.col("n") > small)).isEmpty():
            break
        width = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(BUCKETS)).cast("bigint")
        buckets = between(state).withColumns({"_w": width, "_b": F.floor((F.col("_v") - F.col("lo")) / width).cast("bigint")})
        found = holding(buckets.groupBy(*keys, "name", "lo", "hi", "rank", "_w", "_b").agg(F.count(F.lit(1)).alias("c")), "_b")
        begin = F.col("lo") + F.col("_b") * F.col("_w")
        state = found.select(
            *keys, "name", begin.alias("lo"), F.least("hi", begin + F.col("_w") - 1).alias("hi"), F.col("c").alias("n"), (F.col("rank") - F.col("before")).alias("rank"),
        )
    last = between(state).groupBy(*keys, "name", "rank", "_v").agg(F.count(F.lit(1)).alias("c"))
    return holding(last, "_v").select(*keys, "name", F.col("_v").alias("value"))


def rollup_hours(messages: DataFrame, value: str, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """One row per key and hour: exact count, sum, least and greatest value, and two sketches that can be merged.

    ``distinct_uids`` is a sketch of the uids, ``quantiles`` one of the values. Hours are what a monitor keeps; days, weeks or all
    channels together come from them by ``merge_rollups``, without the messages.
    """
    return messages.groupBy(*keys, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("period")).agg(
        F.count(F.lit(1)).alias("requests"), F.count(value).alias("measured"), F.sum(value).alias("total"), F.min(value).alias("least"),
        F.max(value).alias("greatest"), F.hll_sketch_agg("uid", F.lit(SKETCH_BITS)).alias("distinct_uids"), F.kll_sketch_agg_bigint(value).alias("quantiles"),
    )


def merge_rollups(rollups: DataFrame, unit: str, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Roll rows of ``rollup_hours`` up to a longer ``unit`` (day, week, month) and perhaps fewer keys; the result can be rolled up again."""
    return rollups.groupBy(*keys, F.date_trunc(unit, "period").cast("timestamp_ntz").alias("period")).agg(
        *[F.sum(c).alias(c) for c in ("requests", "measured", "total")], F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct_uids").alias("distinct_uids"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"),
    )


def read_rollups(rollups: DataFrame, fractions: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Rollups with ``uids`` (estimated: off by about 1.6 % at one standard error) and ``p…`` (rank off by about 1.3 %) in place of sketches."""
    read = rollups.withColumn("uids", F.hll_sketch_estimate("distinct_uids"))
    for f in fractions:
        read = read.withColumn(f"p{round(100 * f)}", F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_bigint("quantiles", F.lit(f))))
    return read.drop("distinct_uids", "quantiles")


def dedupe(messages: DataFrame, uid: str = "uid") -> DataFrame:
    """First row per uid in arrival order.

    The rank bound is applied in every task before the shuffle, so copies of one uid collapse
    where they are read.
    """
    arrival = Window.partitionBy(uid).orderBy("ts", "event_id")
    return messages.withColumn("_n", F.row_number().over(arrival)).filter(F.col("_n") == 1).drop("_n")
