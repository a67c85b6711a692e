import pytest
from pyspark.sql import functions as F

import model
from relaylog.operators import bounded, queue, slices
from relaylog.operators.slices import add_slice, plan_slices
from relaylog.plans import fixtures as fx
from relaylog.schema import MESSAGE

LOG = "event_id long, ts timestamp_ntz, channel long, method string, uid long, fwd string, k int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], LOG)


def sliced(df, rows_per_slice):
    slicing = plan_slices(df, rows_per_slice=rows_per_slice)
    assert slicing.hot is not None
    out = add_slice(df, slicing)
    assert out.filter("slice > 0").count() > 0
    return out


def result(df):
    columns = ("event_id", "status", "q", "pend", "msgs")
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_step_model(spark, seed):
    rows = model.random_log(seed, 600)
    expected = sorted(model.replay(rows))
    df = frame(spark, rows)
    assert result(queue.queue_replay(df)) == expected
    assert result(queue.queue_replay(sliced(df, 40))) == expected


def test_replay_with_many_hot_keys_joined_by_shuffle(spark):
    rows = model.random_log(9, 600, channels=4)
    df = frame(spark, rows)
    slicing = plan_slices(df, rows_per_slice=20, max_broadcast=1)
    assert not slicing.small
    assert result(queue.queue_replay(add_slice(df, slicing))) == sorted(model.replay(rows))


def test_one_uid_answered_over_and_over(spark):
    rows = [(0, model.START, 0, "PUT", 77, None)] + [
        (i, model.START.replace(minute=i // 10, second=i % 10), 0, "POST", 100 + i, "77") for i in range(1, 300)
    ]
    df = frame(spark, rows)
    expected = sorted(model.replay(rows))
    assert result(queue.queue_replay(df)) == expected
    assert result(queue.queue_replay(sliced(df, 50))) == expected


def test_expected_counts(spark, tiny):
    counts = {
        (r.method, r.status): r["count"]
        for r in queue.queue_replay(fx.log(spark, tiny)).groupBy("method", "status").count().collect()
    }
    assert counts == {
        ("PUT", 202): 401, ("GET", 200): 233, ("GET", 204): 47, ("GET", 503): 77, ("POST", 200): 121,
        ("POST", 300): 48, ("POST", 400): 30, ("HEAD", 200): 39, ("HEAD", 204): 2, ("DELETE", 405): 2,
    }


@pytest.mark.parametrize("limit", [0, 1, 3, 5])
def test_bounded_queue(spark, limit):
    rows = [r for r in model.random_log(limit + 10, 800) if r[3] in ("PUT", "GET")]
    expected = sorted((e, s if s != 503 else 200, q) for e, s, q, _, _ in model.replay(rows, limit))
    df = frame(spark, rows).withColumn("limit_size", F.lit(limit).cast("bigint"))
    for candidate in (df, sliced(df, 30)):
        got = sorted(tuple(r) for r in bounded.bounded_queue(candidate).select("event_id", "status", "q").collect())
        assert got == expected


def test_bounded_rejections_at_sf001(spark, small):
    rejected = 0
    for limit in (1, 3, 5):
        rows = fx.messages(spark, small).withColumn("limit_size", F.lit(limit).cast("bigint"))
        n = bounded.bounded_queue(rows).filter("status = 507").count()
        rejected += n
        if limit == 3:
            assert n == 1033
    assert rejected == 3762


def test_asof_state_sliced_equals_plain(spark):
    df = frame(spark, model.random_log(4, 400))
    probes = df.groupBy("channel").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(
        "channel", F.explode(F.sequence("a", "b", F.expr("interval 7 minutes"))).alias("probe_ts")
    )
    slicing = plan_slices(df, rows_per_slice=40)
    plain = queue.asof_state(queue.queue_replay(df), probes)
    cut = queue.asof_state(queue.queue_replay(add_slice(df, slicing)), probes, slicing)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_slices_are_bounded(spark):
    df = frame(spark, model.random_log(6, 2000, channels=2))
    out = add_slice(df, plan_slices(df, rows_per_slice=50, tick_seconds=1))
    most = out.filter("slice >= 0").groupBy("channel", "slice").count().agg(F.max("count")).first()[0]
    assert most <= 50


def crowded(seed, n=900):
    """A log in which 600 rows come at one time, in the middle of others, in ids that are out of order."""
    rows = model.random_log(seed, n, channels=1)
    rows.sort(key=lambda r: (r[1], r[0]))
    at = rows[150][1]
    return [(n - r[0], at if 150 <= i < 750 else r[1], *r[2:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("sampled", [64, 4])
def test_one_moment_is_cut_by_splitters(spark, monkeypatch, sampled):
    monkeypatch.setattr(slices, "_SAMPLED", sampled)
    rows = crowded(12)
    df = frame(spark, rows).repartition(4)
    slicing = plan_slices(df, rows_per_slice=50)
    out = add_slice(df, slicing)
    sizes = out.groupBy("slice").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b")).orderBy("slice").collect()
    assert max(r.n for r in sizes) <= 50 and sum(r.n for r in sizes) == 900 and len(sizes) >= 18
    assert all(x.b < y.a for x, y in zip(sizes, sizes[1:]))
    expected = sorted(model.replay(rows))
    assert result(queue.queue_replay(out)) == expected == result(queue.queue_replay(df))


def test_dense_ticks_of_many_keys_joined_by_shuffle(spark):
    rows = [(i, model.START.replace(minute=i % 4 * (i % 3)), i % 3, ("PUT", "GET", "POST")[i % 7 % 3], i, str(i - 6)) for i in range(1500)]
    df = frame(spark, rows)
    slicing = plan_slices(df, rows_per_slice=40, max_broadcast=1)
    assert not slicing.small and not slicing.dense_small
    out = add_slice(df, slicing)
    assert out.groupBy("channel", "slice").count().agg(F.max("count")).first()[0] <= 40
    assert result(queue.queue_replay(out)) == sorted(model.replay(rows))


def test_null_keys_are_cut_too(spark):
    df = frame(spark, crowded(13)).withColumn("channel", F.lit(None).cast("bigint"))
    out = add_slice(df, plan_slices(df, rows_per_slice=50))
    assert out.filter("slice >= 0").count() == 900 and out.groupBy("slice").count().agg(F.max("count")).first()[0] <= 50


def test_message_schema_matches_fixture(spark, tiny):
    log = fx.log(spark, tiny).select(*[f.name for f in MESSAGE.fields])
    assert [(f.name, f.dataType) for f in log.schema] == [(f.name, f.dataType) for f in MESSAGE.fields]


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("limit", [0, 1, 3])
def test_full_replay_with_a_limit(spark, seed, limit):
    rows = model.random_log(seed, 400)
    df = frame(spark, rows).withColumn("limit_size", F.lit(limit))
    expected = sorted(model.replay(rows, limit))
    assert result(bounded.queue_replay_bounded(df)) == expected
    assert result(bounded.queue_replay_bounded(sliced(df, 40))) == expected


def test_limits_on_text_and_null_channels(spark):
    rows = model.random_log(6, 300)
    text = frame(spark, rows).withColumns({
        "limit_size": F.lit(2), "channel": F.when(F.col("channel") > 0, F.concat(F.lit("ch-"), F.col("channel").cast("string"))),
    })
    expected = sorted(model.replay(rows, 2))
    assert result(bounded.queue_replay_bounded(text)) == expected


def test_equal_uids_and_unknown_methods(spark):
    """The first of equal uids owns the reply, plain and sliced; methods nobody knows are answered with 200."""
    rows = [(i, model.START.replace(minute=3 * i), 0, m, u, f) for i, (m, u, f) in enumerate([
        ("PUT", 7, None), ("PUT", 7, None), ("GET", 1, None), ("POST", 2, "7"), ("GET", 3, None), ("BREW", 4, None), (None, 5, None),
        ("POST", 6, "7"), ("HEAD", 8, None),
    ])]
    df = frame(spark, rows)
    plain = result(queue.queue_replay(df))
    assert plain == result(queue.queue_replay(sliced(df, 2)))
    assert [r[1] for r in plain[5:7]] == [200, 200]
