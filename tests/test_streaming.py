import json
import random
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import model
from relaylog.operators.queue import queue_replay
from relaylog.plans import stream_queries as sq
from relaylog.schema import MESSAGE
from relaylog.session import new_folder
from relaylog.sources.messages import stream_messages
from relaylog.streaming import jobs, queue_state
from relaylog.streaming.queue_batches import queue_batches
from relaylog.streaming.queue_state import stream_queue
from test_queue import frame


def run(spark, folder, out, state, delay):
    with jobs.rocksdb_state(spark):
        stream = stream_queue(stream_messages(spark, folder, max_files=2), delay)
        jobs.start_append(stream, out, state, once=True).awaitTermination()


def test_queue_over_a_restart_equals_step_model(spark):
    rows = model.random_log(21, 400)
    expected = sorted(model.replay(rows))
    folder, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    log = frame(spark, rows)
    half = rows[200][1]
    cut = F.lit(str(half)).cast("timestamp_ntz")
    sq._stage(spark, log.filter(F.col("ts") < cut), folder, files=3)
    run(spark, folder, out, state, "1 day")
    sq._stage(spark, log.filter(F.col("ts") >= cut), folder, files=3)
    sq._stage(spark, sq._sentinel(spark), folder)
    run(spark, folder, out, state, "1 day")
    done = spark.read.parquet(out).filter("channel >= 0")
    assert sorted(tuple(r) for r in done.select("event_id", "status", "q", "pend", "msgs").collect()) == expected


def spaced_log(seed, n):
    """A random log without equal times, so that no row is as old as the watermark."""
    return [(i, model.START + timedelta(seconds=i), *r[2:]) for i, r in enumerate(model.random_log(seed, n))]


def test_state_is_kept_between_releases(spark):
    """A short delay and files in order release rows in several steps."""
    rows = spaced_log(22, 300)
    folder, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    log = frame(spark, rows)
    for start in range(0, 300, 100):
        sq._stage(spark, log.filter(F.col("event_id").between(start, start + 99)), folder, files=1)
        run(spark, folder, out, state, "0 seconds")
    sq._stage(spark, sq._sentinel(spark), folder)
    run(spark, folder, out, state, "0 seconds")
    done = spark.read.parquet(out).filter("channel >= 0")
    got = sorted(tuple(r) for r in done.select("event_id", "status", "q", "pend", "msgs").collect())
    assert got == sorted(model.replay(rows))


def test_messages_without_a_uid_are_not_named_by_odd_headers(spark):
    rows = [(i, model.START + timedelta(seconds=i), 0, m, u, f) for i, (m, u, f) in enumerate([
        ("PUT", None, None), ("POST", 2, "99999999999999999999"), ("POST", 3, "-1"), ("PUT", -1, None), ("POST", 5, "-1"), ("POST", 6, "-1"),
        ("GET", 7, None), ("PUT", 8, None), ("PUT", 8, None), ("POST", 9, "8"), ("GET", 10, None), ("GET", 11, None), ("GET", 12, None),
    ])]
    log = frame(spark, rows)
    folder, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    sq._stage(spark, log, folder)
    sq._stage(spark, sq._sentinel(spark), folder)
    run(spark, folder, out, state, "1 day")
    done = spark.read.parquet(out).filter("channel >= 0")
    got = sorted(tuple(r) for r in done.select("event_id", "status", "q", "pend", "msgs").collect())
    assert got == sorted(tuple(r) for r in queue_replay(log).select("event_id", "status", "q", "pend", "msgs").collect())


class Store(dict):
    """State variables of one processor as plain values; counts the calls on them."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def __getattr__(self, name):
        return lambda variable, *_: Variable(self, variable)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.discard(ms)


class Variable:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def __getattr__(self, call):
        self.store.calls += 1
        values, name = self.store.values, self.name
        return {
            "get": lambda: values.get(name, [] if name == "buffer" else None),
            "appendList": lambda new: values.setdefault(name, []).extend(new),
            "put": lambda new: values.__setitem__(name, list(new)),
            "update": lambda value: values.__setitem__(name, value),
            "clear": lambda: values.pop(name, None),
            "getValue": lambda key: values.get((name, key)),
            "containsKey": lambda key: (name, key) in values,
            "updateValue": lambda key, value: values.__setitem__((name, key), value),
            "removeKey": lambda key: values.pop((name, key)),
        }[call]


class Clock:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def stepped(rows, steps):
    """Results and calls of a processor that gets ``rows`` (in order) in some steps, each released up to its last row."""
    store, got = Store(), []
    processor = queue_state.QueueProcessor()
    processor.init(store)
    for part in steps:
        at = {r: int((rows[r][1] - model.START).total_seconds() * 1e6) for r in part}
        texts = [json.dumps([str(rows[r][2]), str(at[r]), str(rows[r][0]), rows[r][3], f"u{rows[r][4]}" if rows[r][4] is not None else "",
                             f"u{rows[r][5]}" if rows[r][5] else "", "false"]) for r in part]
        random.Random(len(part)).shuffle(texts)
        list(processor.handleInputRows((0,), iter([pd.DataFrame({"us": [int(json.loads(t)[1]) for t in texts], "row": texts})]), None))
        # The newest rows wait for the next step.
        for pdf in processor.handleExpiredTimer((0,), Clock(at[part[-1]] - (3_000_000 if part is not steps[-1] else 0)), None):
            got += pdf.itertuples(index=False, name=None)
    return sorted((r[0], *r[3:]) for r in got), store


def queue_log(n, channels=1):
    """PUT, GET and POST so that a backlog grows over many packs and is used up again; (event_id, time, channel, method, uid, fwd)."""
    rnd, rows, open_ = random.Random(n), [], {c: [] for c in range(channels)}
    for i in range(n):
        channel, growing = rnd.randrange(channels), i < n // 2
        method = rnd.choices(["PUT", "GET", "POST", "HEAD"], [6, 2, 1, 1] if growing else [1, 4, 6, 1])[0]
        fwd = None
        if method == "PUT":
            open_[channel].append(i)
        elif method == "POST":
            held = open_[channel]
            fwd = str(held.pop(rnd.randrange(len(held))) if held else 10**9)
        rows.append((i, model.START + timedelta(seconds=i), channel, method, i, fwd))
    return rows


@pytest.mark.parametrize("channels, step", [(1, 3000), (1, 97), (7, 500), (7, 10)])
def test_state_in_packs_equals_step_model(channels, step):
    rows = queue_log(3000, channels)
    steps = [range(i, min(i + step, 3000)) for i in range(0, 3000, step)]
    got, store = stepped(rows, steps)
    assert got == sorted(model.replay(rows))
    kept = got[-1]
    held = sum(len(json.loads(v[0])) for k, v in store.values.items() if k[0] == "held")
    last = {r[2]: dict((g[0], g) for g in got)[r[0]] for r in rows}
    assert held == sum(g[4] for g in last.values()) and kept


def test_calls_on_the_state_do_not_follow_the_rows():
    """A run of many rows takes few calls, and one of few rows takes few calls on a long backlog."""
    rows = queue_log(20_000, 5)
    assert stepped(rows, [range(10_000), range(10_000, 20_000)])[1].calls < 2_000
    before = stepped(rows, [range(10_000)])[1].calls
    assert stepped(rows, [range(10_000), range(10_000, 10_020)])[1].calls - before < 150


def test_channels_share_the_keys_of_the_state(spark):
    log = frame(spark, [(i, model.START + timedelta(seconds=i), i, "PUT", i, None) for i in range(20_000)])
    log = log.select(*[f.name for f in MESSAGE.fields])
    folder, out, state = (new_folder(spark, n) for n in ("in", "out", "state"))
    sq._stage(spark, log, folder)
    sq._stage(spark, sq._sentinel(spark), folder)
    with jobs.rocksdb_state(spark):
        query = jobs.start_append(stream_queue(stream_messages(spark, folder), "1 day"), out, state, once=True)
        query.awaitTermination()
    assert spark.read.parquet(out).filter("channel >= 0 and status = 202 and q = 1 and msgs = 1").count() == 20_000
    # A buffer row, a timer and its two indexes for each key at most, not for each channel.
    assert max(o.numRowsTotal for o in query.recentProgress[0].stateOperators) < 20_000


@pytest.mark.parametrize("rows_per_slice", [4_000_000, 15])
def test_batch_chain_equals_step_model(spark, rows_per_slice):
    rows = spaced_log(23, 300)
    log = frame(spark, rows).select(*[f.name for f in MESSAGE.fields])
    root = new_folder(spark, "chain")
    step = queue_batches(root, "40 seconds", rows_per_slice)
    parts = [(0, 99, 0), (100, 199, 1), (100, 199, 1), (200, 299, 2)]
    for low, high, batch_id in parts:
        step(log.filter(F.col("event_id").between(low, high)), batch_id)
    step(log.filter("event_id = 3").union(sq._sentinel(spark).select(*log.columns)), 3)
    done = spark.read.parquet(f"{root}/replay").filter("channel >= 0")
    got = sorted(tuple(r) for r in done.select("event_id", "status", "q", "pend", "msgs").collect())
    assert got == sorted(model.replay(rows))
    assert [r.event_id for r in spark.read.parquet(f"{root}/late").collect()] == [3]


def test_replies_are_written_once_per_batch(spark, tmp_path):
    write = jobs.reply_writer(str(tmp_path), {"even": F.col("id") % 2 == 0, "odd": F.col("id") % 2 == 1})
    for _ in range(2):
        write(spark.range(10), 4)
    assert spark.read.parquet(str(tmp_path / "even")).count() == 5
    assert spark.read.parquet(str(tmp_path / "odd")).count() == 5
