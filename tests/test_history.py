"""Uniqueness against a history, with filters that err."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

import model
from relaylog.operators import history, monitor
from relaylog.session import new_folder

SCHEMA = "event_id long, ts timestamp_ntz, uid long"


def log(spark, seed, n, days=9, uids=200):
    rnd = random.Random(seed)
    rows = sorted((model.START + timedelta(days=rnd.randrange(days), seconds=rnd.randrange(86_400)), i) for i in range(n))
    return spark.createDataFrame([(i, ts, rnd.choice([None, *range(uids)])) for ts, i in rows], SCHEMA)


def first(df):
    return sorted((r.event_id for r in df.select("event_id").collect()))


def test_batches_equal_the_whole_log(spark):
    df = log(spark, 1, 800)
    parts = [df.filter(F.dayofmonth("ts").between(3 * i + 1, 3 * i + 3)) for i in range(3)]
    want = first(monitor.dedupe(df))
    for bits in (1 << 12, 64):  # the second is full: every uid hits every day
        assert first(history.dedupe_batches(spark, parts, new_folder(spark, "uids"), 4, bits)) == want


def test_only_days_that_may_hold_a_uid_are_read(spark):
    root = new_folder(spark, "uids")
    kept = history.UidHistory(spark, root, 4, 1 << 14)
    days = spark.range(5000).select("id", (F.lit(model.START).cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") / 500).cast("int"))).alias("ts"), F.col("id").alias("uid"))
    kept.add(days, 0)
    asked = spark.createDataFrame([(700, model.START), (720, model.START), (99_999, model.START), (99_998, model.START)], "uid long, ts timestamp_ntz")
    hits = kept.hits(asked)
    assert {(r.uid, r.day.day) for r in hits.collect() if r.uid < 5000} == {(700, 2), (720, 2)}
    assert sorted(r.uid for r in kept.seen(asked).collect()) == [700, 720]
    plan = kept.seen(asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-02" in plan


def test_a_batch_added_again_replaces_itself(spark):
    kept = history.UidHistory(spark, new_folder(spark, "uids"), 2, 1 << 10)
    rows = log(spark, 2, 50)
    kept.add(rows, 0)
    kept.add(rows, 0)
    assert kept.batches == [0] and kept._read("uids", history._UIDS).count() == 50
    assert kept.first_seen(rows).count() == 0
    assert kept.first_seen(rows.limit(0)).count() == 0 and history.UidHistory(spark, "none").first_seen(rows).count() == monitor.dedupe(rows).count()
