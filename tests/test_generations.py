"""State in generations against the unbroken replay and trace."""

import random

import pytest
from pyspark.sql import functions as F

import model
from relaylog.operators.queue import message_trace, queue_replay
from relaylog.session import new_folder
from relaylog.sources import generations as g
from test_queue import frame, result

COLUMNS = ["channel", "seq", "uid", "k", "put_id", "get_id", "post_id"]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


def chain(spark, rows, cuts, rows_per_slice=4_000_000):
    """Replay in parts; the rows of all parts, the last state, and its folder."""
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    state = g.Generations(spark, new_folder(spark, "state"), -1, frame(spark, []))
    out = []
    for gen, part in enumerate(parts):
        made, state = g.advance(state, frame(spark, part), None, gen, rows_per_slice)
        out += result(made)
    return sorted(out), state


@pytest.mark.parametrize("seed,cuts,rows_per_slice", [(5, [0], 10**6), (5, [100], 10**6), (6, [50, 120, 121, 300], 10**6), (7, [200, 260], 20)])
def test_parts_equal_the_unbroken_replay(spark, seed, cuts, rows_per_slice):
    rows = ordered(model.random_log(seed, 400))
    got, state = chain(spark, rows, cuts, rows_per_slice)
    assert got == sorted(model.replay(rows))
    unbroken = message_trace(frame(spark, rows)).select(COLUMNS)
    assert sorted(map(tuple, g.traced(state.root, spark, state.message_schema).select(COLUMNS).collect())) == sorted(map(tuple, unbroken.collect()))
    open_ones = unbroken.filter("get_id is null or post_id is null")
    assert sorted(map(tuple, state.messages().select(COLUMNS).collect())) == sorted(map(tuple, open_ones.collect()))


def test_bases_take_the_place_of_old_generations(spark, monkeypatch):
    monkeypatch.setattr(g, "MAX_DELTAS", 2)
    rows = ordered(model.random_log(8, 240))
    got, state = chain(spark, rows, list(range(40, 240, 40)))
    assert got == sorted(model.replay(rows)) and state.base == 5
    again = g.Generations(spark, state.root, state.gen, frame(spark, []))
    assert again.base == state.base and sorted(map(str, again.channels().collect())) == sorted(map(str, state.channels().collect()))


def test_a_batch_rewrites_what_it_touches(spark):
    """200 channels with 50 messages waiting in each; a batch of two channels writes a few rows and reads a few."""
    rows = [(i, model.START.replace(minute=i % 60, second=i // 200 % 60), i % 200, "PUT", 10_000 + i, None) for i in range(10_000)]
    root = new_folder(spark, "state")
    state = g.Generations(spark, root, -1, frame(spark, []))
    _, state = g.advance(state, frame(spark, rows), None, 0)
    late = model.START.replace(day=2)
    batch = [(20_000, late, 3, "GET", 1, None), (20_001, late, 3, "HEAD", 2, None), (20_002, late, 7, "POST", 3, str(10_000 + 7 + 200 * 40))]
    log, shift = state.resume(frame(spark, batch))
    assert log.filter("restored").count() == 2 + 2 and {r.channel for r in log.collect()} == {3, 7}
    made, after = g.advance(state, frame(spark, batch), None, 1)
    assert result(made) == [(20_000, 200, 49, 1, 50), (20_001, 200, 49, 1, 50), (20_002, 200, 50, 0, 49)]
    written = spark.read.schema(after.message_schema).parquet(f"{root}/messages/gen=1").count() + spark.read.parquet(f"{root}/channels/gen=1").count()
    assert written == 4 <= 0.02 * 10_200
    assert after.messages().count() == 10_000 and g.listing(after.messages()).filter("kind = 'locked'").count() == 1


def test_restored_rows_carry_their_message_and_spread_over_time(spark):
    rows = ordered(model.random_log(9, 300, channels=1))
    _, state = chain(spark, rows, [])
    gets = [(1000 + i, model.START.replace(year=2025), 0, "GET", 5000 + i, None) for i in range(300)]
    log, _ = state.resume(frame(spark, gets))
    puts = {r.event_id: r for r in log.filter("restored and method = 'PUT'").collect()}
    original = {r[0]: r for r in rows}
    assert len(puts) > 20 and all((r.uid, str(r.ts)) == (original[i][4], str(original[i][1])) for i, r in puts.items())
    assert len({r.ts for r in puts.values()}) > 10


def test_a_batch_that_runs_again_changes_nothing(spark):
    rows = ordered(model.random_log(10, 200))
    state = g.Generations(spark, new_folder(spark, "state"), -1, frame(spark, []))
    _, first = g.advance(state, frame(spark, rows[:100]), "x", 0)
    once, _ = g.advance(first, frame(spark, rows[100:]), None, 1)
    once = result(once)
    again = g.Generations(spark, first.root, 0, frame(spark, []))
    twice, end = g.advance(again, frame(spark, rows[100:]), None, 1)
    assert again.horizon == "x" and result(twice) == once
    assert sorted(map(tuple, end.messages().select(COLUMNS).collect())) == sorted(
        map(tuple, message_trace(frame(spark, rows)).filter("get_id is null or post_id is null").select(COLUMNS).collect()))


def test_text_channels_null_channels_and_content(spark):
    rows = ordered(model.random_log(11, 200))
    channel = F.when(F.col("channel") > 0, F.concat(F.lit("ch-"), F.col("channel").cast("string")))
    log = frame(spark, rows).withColumns({"channel": channel, "content": F.concat(F.lit("c"), "event_id")})
    state = g.Generations(spark, new_folder(spark, "state"), -1, log.limit(0), keep=("k", "content"))
    _, state = g.advance(state, log.filter(F.col("event_id") % 1000 < 100), None, 0)
    assert state.messages().filter("content = concat('c', put_id)").count() == state.messages().count() > 0
    unbroken = result(queue_replay(log))
    ids = [r[0] for r in rows]
    state = g.Generations(spark, new_folder(spark, "state"), -1, log.limit(0), keep=("k", "content"))
    out = []
    for gen, part in enumerate((ids[:90], ids[90:])):
        made, state = g.advance(state, log.filter(F.col("event_id").isin(part)), None, gen)
        out += result(made)
    assert sorted(out) == unbroken
    nothing, after = g.advance(state, log.limit(0), None, 2)
    assert nothing.count() == 0 and after.messages().count() == state.messages().count()
