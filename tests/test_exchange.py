"""Captures to replies, handler channels, and the reply of each row."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import model
from relaylog.operators import exchange as exchanges
from relaylog.operators import handlers, policy
from relaylog.plans import fixtures as fx
from relaylog.plans.registry import SCRIPTS
from test_queue import frame

CODES = {
    "queue": {200, 202, 204, 300, 400, 405, 503, 507}, "handler": {200, 405, 503, 507, 521}, "unrouted": {404}, "unparsed": {400, 405, 408, 431},
}


def setup(spark, sf, **options):
    events = fx.table(spark, sf, "events")
    captures = fx.exchange_captures(fx.with_forward(fx.to_messages(events)), fx.table(spark, sf, "pages"))
    return captures, exchanges.Settings(fx.exchange_channels(events), None, SCRIPTS, drain_seconds=86_400, **options)


def test_every_request_is_answered_once_on_its_lane(spark, small):
    captures, settings = setup(spark, small)
    got = exchanges.exchange(captures, settings).select("event_id", "lane", "code", "message", "body").collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in captures.select("event_id").collect())
    assert {lane: {r.code for r in got if r.lane == lane} for lane in exchanges.LANES} == CODES
    assert any(r.message == "OK" and r.body.startswith("PUT adds") for r in got)
    assert any(r.code == 503 and r.body.startswith("no multiples of 25") for r in got)


def test_hot_channels_are_answered_alike(spark, tiny):
    captures, settings = setup(spark, tiny)
    plain = exchanges.exchange(captures, settings)
    cut = exchanges.exchange(captures, setup(spark, tiny, rows_per_slice=20)[1])
    assert sorted(map(str, cut.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_odd_captures(spark):
    raw = [
        (1, "GET /a/ HTTP/1.1\n\n"), (1, "GET /a/ HTTP/1.1\n\n"), (None, "PUT /a/ HTTP/1.1\n\nx"), (3, None), (4, ""), (5, "TRACE /a/x HTTP/1.1\n\n"),
        (6, "PUT /a/ HTTP/1.1\nX-Msg-Forward-Uid: 99999999999999999999999\n\n" + "b" * 100_000), (7, "OPTIONS /b/ HTTP/1.1\r\n\r\n"), (8, "HEAD / HTTP/1.1\n\n"),
    ]
    captures = spark.createDataFrame([(i, model.START, "x", r) for i, r in raw], "event_id long, ts timestamp_ntz, listener string, raw string")
    channels = spark.createDataFrame([("a", "sync-queue://a/", None), ("b", "sync-sapi://b/", "python://x")], "channel string, endpoint string, sapi string")
    settings = exchanges.Settings(channels)
    got = exchanges.exchange(captures, settings).collect()
    assert sorted((r.event_id or 0, r.lane, r.code) for r in got) == [
        (0, "queue", 202), (1, "queue", 200), (1, "queue", 204), (3, "unparsed", 400), (4, "unparsed", 400), (5, "queue", 405),
        (6, "queue", 202), (7, "handler", 405), (8, "unrouted", 404),
    ]
    assert [r.allow for r in got if r.event_id == 5] == ["PUT"] == [r.allow for r in got if r.event_id == 7]
    assert exchanges.exchange(captures.limit(0), settings).count() == 0
    nobody = exchanges.exchange(captures, exchanges.Settings(channels.limit(0)))
    assert {(r.lane, r.code) for r in nobody.collect()} == {("unrouted", 404), ("unparsed", 400)}


def test_lanes_are_folders(spark, tiny, tmp_path):
    captures, settings = setup(spark, tiny)
    exchanges.write_lanes(exchanges.exchange(captures, settings), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("lane=*")) == sorted(f"lane={lane}" for lane in exchanges.LANES)
    assert spark.read.parquet(str(tmp_path / "out")).count() == captures.count()


def test_dead_letters_do_not_share_a_key(spark, tiny):
    captures, settings = setup(spark, tiny)
    rows = exchanges.routed_requests(captures, settings)
    lost = rows.filter("route is null")
    assert lost.select("channel").distinct().count() == lost.count() > 20


def test_classes_are_answered_in_one_pass(spark, tiny):
    rows = policy.with_channel_config(fx.log(spark, tiny), fx.channel_config(spark, tiny)).withColumn("content", fx.content(F.col("k")))
    plan = handlers.queue_by_class(rows.drop("limit_size"), SCRIPTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    before = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan|Scan parquet", plan)) == len(re.findall("FileScan|Scan parquet", before))


def test_by_class_reads_once_and_keeps_whole_numbers(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([("a", big, 1), ("b", None, 2), (None, big, 3), ("a", None, 13)], "sapi_class string, uid long, n int").coalesce(1)

    def picky(batch: pd.DataFrame) -> pd.Series:
        if (batch["n"] == 13).any():
            raise ValueError("thirteen")
        return batch["uid"].astype(str)

    made = handlers.apply_by_class(df, {"a": picky, "b": lambda b: b["n"].astype(str)})
    assert made._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    got = {r.n: (r.uid, r.status, r.reply, r.error) for r in made.collect()}
    assert got == {
        1: (big, 200, str(big), None), 2: (None, 200, "2", None), 3: (big, 503, handlers.ERROR_TEXT, None), 13: (None, 503, handlers.ERROR_TEXT, "thirteen"),
    }
    some = handlers.apply_by_class(df, {"a": picky}, where=F.col("n") == 1).collect()
    assert [(r.n, r.status) for r in some if r.status is not None] == [(1, 200)] and len(some) == 4


@pytest.mark.parametrize("limit,accepted", [(0, 10), (3, 6), (None, 10)])
def test_a_handler_channel_holds_its_limit_between_two_drains(spark, limit, accepted):
    rows = [(i, model.START.replace(second=i), 0, "PUT", i, None) for i in range(10)] + [(99, model.START, 0, "GET", 99, None)]
    df = frame(spark, rows).withColumns({"limit_size": F.lit(limit).cast("bigint"), "active": F.lit(True)})
    got = handlers.handler_queue(df, drain_seconds=5).collect()
    assert sum(r.status is None for r in got) == accepted and [r.status for r in got if r.method == "GET"] == [405]
    assert {r.queue_limit for r in got if r.status == 507} == ({limit} if accepted < 10 else set())
    down = handlers.handler_queue(df.withColumn("active", F.lit(False)), 5).collect()
    assert {r.status for r in down} == {521, 405}


def test_own_queue_class(spark):
    handlers.register_queue_class("Echo", handlers.HANDLER)
    try:
        df = frame(spark, [(1, model.START, 0, "PUT", 5, None)]).withColumns({"mq_class": F.lit("Echo"), "sapi_class": F.lit("e"), "content": F.lit("hi")})
        assert [(r.status, r.reply) for r in handlers.queue_by_class(df, {"e": lambda b: b["content"]}).collect()] == [(200, "hi")]
    finally:
        del handlers._queue_classes["Echo"]
    with pytest.raises(ValueError):
        handlers.register_queue_class("Echo", "other")

