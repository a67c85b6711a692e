import pandas as pd
from pyspark.sql import functions as F

from relaylog.operators import handlers, monitor, policy
from relaylog.operators.slices import add_slice, plan_slices
import model
from test_queue import frame


def test_one_bad_message_costs_one_reply(spark):
    def picky(batch: pd.DataFrame) -> pd.Series:
        if (batch["n"] == 13).any():
            raise ValueError("thirteen")
        return ("n" + batch["n"].astype(str)).where(batch["n"] != 7, None)

    df = spark.range(200).select(F.col("id").alias("n")).coalesce(1)
    got = {r.n: (r.status, r.reply) for r in handlers.apply_handler(df, picky).collect()}
    assert len(got) == 200
    assert {n for n, (s, _) in got.items() if s == 503} == {7, 13}
    assert got[5] == (200, "n5") and got[13][1] == handlers.ERROR_TEXT


def test_by_class_covers_unknown_and_null(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "sapi_class string, n int")
    got = handlers.apply_by_class(df, {"a": lambda b: b["n"].astype(str)}).collect()
    assert sorted((r.n, r.status) for r in got) == [(1, 200), (2, 503), (3, 503)]


def test_rate_limit_sliced_equals_plain(spark):
    df = frame(spark, model.random_log(3, 500)).withColumns(
        {"limit_seconds": F.lit(3600), "max_requests": F.lit(5)}
    )
    plain = policy.rate_limit(df).select("event_id", "bucket", "request_no", "over_limit")
    cut = policy.rate_limit(add_slice(df, plan_slices(df, rows_per_slice=30))).select(*plain.columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_peak(spark):
    rows = [(0, "2024-01-01 00:00:00", 1, "2024-01-01 00:00:10", 2), (0, "2024-01-01 00:00:05", 3, None, None),
            (0, "2024-01-01 00:00:20", 4, "2024-01-01 00:00:30", 5)]
    df = spark.createDataFrame(rows, "channel long, a string, start_id long, b string, end_id long").select(
        "channel", F.col("a").cast("timestamp_ntz").alias("start_ts"), "start_id",
        F.col("b").cast("timestamp_ntz").alias("end_ts"), "end_id",
    )
    assert policy.peak_concurrency(df).first().peak == 2
    flagged = policy.task_limit(df.withColumn("limit_tasks", F.lit(1)))
    assert sorted((r.event_id, r.over_limit) for r in flagged.collect()) == [(1, False), (3, True), (4, True)]


def test_dedupe_limits_before_the_shuffle(spark):
    df = frame(spark, model.random_log(3, 300)).withColumn("uid", (F.col("channel") >= 0).cast("long"))
    first = monitor.dedupe(df)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert [r.event_id for r in first.collect()] == [0]


def test_rate_limit_sliced_equals_plain_without_a_period(spark):
    df = frame(spark, model.random_log(4, 400)).withColumns(
        {"limit_seconds": F.when(F.col("channel") == 0, 0).when(F.col("channel") == 1, 60), "max_requests": F.lit(5)}
    )
    plain = policy.rate_limit(df).select("event_id", "bucket", "request_no", "over_limit")
    cut = policy.rate_limit(add_slice(df, plan_slices(df, rows_per_slice=30))).select(*plain.columns)
    key = lambda r: r.event_id
    assert sorted(plain.collect(), key=key) == sorted(cut.collect(), key=key)


def test_rows_of_an_unknown_class_are_answered(spark):
    df = frame(spark, model.random_log(5, 60)).withColumn("mq_class", F.when(F.col("channel") == 0, "SyncQueue").when(F.col("channel") == 1, "none"))
    got = handlers.queue_by_class(df)
    assert got.count() == 60 and got.filter("status = 404").count() == df.filter("channel > 0").count()
