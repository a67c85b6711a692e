"""Percentiles by narrowing, rollups and uniqueness against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

import model
from relaylog.operators import monitor
from relaylog.operators.queue import message_trace
from relaylog.plans import fixtures as fx
from test_queue import frame


def disc(values, f):
    """The smallest value with at least a share ``f`` at or below it."""
    values = sorted(values)
    return values[max(1, -int(-f * len(values) // 1)) - 1] if values else None


def test_percentiles_are_exact_at_any_accuracy(spark, small):
    tele = fx.telemetry(message_trace(fx.log(spark, small)))
    exact = sorted(map(str, monitor.latency_stats(tele).collect()))
    assert sorted(map(str, monitor.latency_stats(tele, accuracy=10).collect())) == exact


def test_ranks_of_a_busy_channel(spark):
    df = spark.range(100_000).select((F.col("id") % 2 * 7).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**12)) - 10**11).alias("v"))
    df = df.unionByName(spark.createDataFrame([(1, None), (2, 5), (None, 3), (None, 3), (None, 4)], "k long, v long"))
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    values = {}
    for r in df.collect():
        values.setdefault(r.k, []).append(r.v)
    for small in (1, 1000):
        got = {(r.k, r.name): r.value for r in monitor.narrowed_ranks(df, ["k"], "v", fractions, small).collect()}
        want = {(k, n): disc([x for x in v if x is not None], f) for k, v in values.items() for n, f in fractions.items() if any(x is not None for x in v)}
        assert got == want


def test_ties_and_extreme_values(spark):
    rows = [(1, v) for v in [7] * 50 + [-(10**15)] + [10**15] + [8] * 10]
    got = {r.name: r.value for r in monitor.narrowed_ranks(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.9, "d": 1.0}, 1).collect()}
    assert got == {"a": -(10**15), "b": 7, "c": 8, "d": 10**15}
    assert monitor.narrowed_ranks(spark.createDataFrame([], "k long, v long"), ["k"], "v", {"a": 0.5}).count() == 0


def test_days_from_hours_equal_days_from_rows(spark, small):
    rows = fx.to_messages(fx.table(spark, small, "events")).withColumn("size", F.col("k").cast("bigint"))
    days = monitor.read_rollups(monitor.merge_rollups(monitor.rollup_hours(rows, "size"), "day"))
    exact = rows.groupBy("channel", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period")).agg(
        F.count("*").alias("requests"), F.count("size").alias("measured"), F.sum("size").alias("total"), F.min("size").alias("least"), F.max("size").alias("greatest"),
    )
    counts = exact.columns
    assert sorted(map(tuple, days.select(counts).collect())) == sorted(map(tuple, exact.collect()))
    everything = monitor.read_rollups(monitor.merge_rollups(monitor.merge_rollups(monitor.rollup_hours(rows, "size"), "day"), "year", keys=())).first()
    n = rows.count()
    assert everything.requests == n and abs(everything.uids - n) <= 0.05 * n
    for f in (0.5, 0.95):
        at = getattr(everything, f"p{round(100 * f)}")
        below, upto = rows.filter(F.col("size") < at).count(), rows.filter(F.col("size") <= at).count()
        assert below - 0.03 * n <= f * n <= upto + 0.03 * n
