"""Capture files and the two-phase sink: boundaries, restarts, attempts that die."""

import os
import random
import time
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relaylog.session import new_folder
from relaylog.sources import connections as c
from relaylog.streaming import reply_sink

WHEN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def write(folder, rows, prefix="part", size=50):
    """A capture file of ``(connection, data)``."""
    writer = c._Writer({"path": folder, "prefix": prefix})
    batches = [
        pa.record_batch({
            "connection": pa.array([r[0] for r in rows[i : i + size]], pa.int64()), "ts": pa.array([WHEN] * len(rows[i : i + size]), pa.timestamp("us", "UTC")),
            "listener": [":80"] * len(rows[i : i + size]), "data": pa.array([r[1] for r in rows[i : i + size]], pa.binary()),
        })
        for i in range(0, len(rows), size)
    ]
    writer.commit([writer.write(iter(batches))])


def request(n, body=b""):
    return b"PUT /a/%d HTTP/1.1\r\nContent-Length: %d\r\n\r\n%s" % (n, len(body), body)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=6), st.booleans())
def test_requests_of_a_connection(bodies, broken):
    requests = [request(i, b) for i, b in enumerate(bodies)]
    data = b"".join(requests) + (b"GET /x HTTP/1.1\r\nno end" if broken else b"")
    assert list(c.requests_of(data)) == requests + ([b"GET /x HTTP/1.1\r\nno end"] if broken else [])


def test_line_feeds_and_missing_lengths():
    assert list(c.requests_of(b"GET /a HTTP/1.1\n\nGET /b HTTP/1.1\n\n")) == [b"GET /a HTTP/1.1\n\n", b"GET /b HTTP/1.1\n\n"]
    assert list(c.requests_of(b"PUT /a HTTP/1.1\ncontent-length: 99\n\nshort")) == [b"PUT /a HTTP/1.1\ncontent-length: 99\n\nshort"]
    assert list(c.requests_of(b"")) == []


@pytest.mark.parametrize("read", [20, 37, 1 << 20])
def test_parts_of_any_size_hold_every_frame_once(tmp_path, monkeypatch, read):
    monkeypatch.setattr(c, "_READ", read)
    rnd = random.Random(read)
    rows = [(i, rnd.randbytes(rnd.choice([0, 1, 15, 16, 17, 300]))) for i in range(120)]
    write(str(tmp_path), rows)
    (name, size), = c.complete_files(str(tmp_path))
    for part_bytes in (7, 64, 1000, 10**9):
        got = [(f[0], f[3]) for p in c._parts(str(tmp_path), name, 0, size, part_bytes) for f in c.frames(p)]
        assert got == rows


def test_batch_read(spark, tmp_path):
    c.register(spark)
    rows = [(i, b"".join(request(k, b"x" * k) for k in range(i % 4))) for i in range(200)]
    write(str(tmp_path), rows)
    write(str(tmp_path), [(999, b"\xff\xfe broken")], prefix="a")
    open(tmp_path / "_unfinished", "wb").close()
    got = spark.read.format("connections").options(path=str(tmp_path), partBytes=300).load()
    assert got.filter("connection < 999").count() == sum(i % 4 for i in range(200))
    assert got.filter("connection = 999").first().raw.endswith("broken")
    assert got.select("connection", "number").distinct().count() == got.count() and got.first().listener == ":80"
    nothing = spark.read.format("connections").option("path", str(tmp_path / "none")).load()
    assert nothing.count() == 0


def stream(spark, folder, journal, out, state, batches=None):
    stream = spark.readStream.format("connections").options(path=folder, journal=journal, maxBytes=900, partBytes=250).load()
    query = stream.writeStream.format("replies").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
    try:
        if batches is None:
            query.processAllAvailable()
        else:
            while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] + 1 < batches):
                query.awaitTermination(1)
    finally:
        query.stop()
    return stream.schema


def test_restart_in_the_middle_of_a_file(spark, tmp_path):
    c.register(spark)
    reply_sink.register(spark)
    folder, journal, out, state = (str(tmp_path / n) for n in ("in", "journal", "out", "state"))
    rows = [(i, request(i, b"y" * (i % 50)) + request(i)) for i in range(60)]
    write(folder, rows)
    schema = stream(spark, folder, journal, out, state, batches=2)
    part = reply_sink.read_replies(spark, out, schema).count()
    assert 0 < part < 120
    write(folder, [(1000 + i, request(i)) for i in range(20)], prefix="z")
    stream(spark, folder, journal, out, state)
    got = [(r.connection, r.number) for r in reply_sink.read_replies(spark, out, schema).collect()]
    assert sorted(got) == sorted([(i, k) for i in range(60) for k in (0, 1)] + [(1000 + i, 0) for i in range(20)])
    entries = [n for n in os.listdir(journal) if not n.startswith("_")]
    assert len(entries) > 5


def test_offsets_never_go_back(tmp_path):
    write(str(tmp_path / "in"), [(i, request(i)) for i in range(50)])
    options = {"path": str(tmp_path / "in"), "journal": str(tmp_path / "j"), "maxBytes": "500"}
    first = c._StreamReader(options)
    offsets = [first.latestOffset()["entry"] for _ in range(3)] + [c._StreamReader(options).latestOffset()["entry"] for _ in range(20)]
    assert offsets == sorted(offsets) and offsets[:4] == [1, 2, 3, 4] and offsets[-1] == offsets[-2]
    reader = c._StreamReader(options)
    read = [f[0] for p in reader.partitions({"entry": 0}, {"entry": offsets[-1]}) for f in c.frames(p)]
    assert read == list(range(50))
    assert reader.partitions({"entry": 3}, {"entry": 3}) == []


def test_attempts_that_die_leave_no_second_copy(spark, tmp_path):
    writer = reply_sink.ReplyWriter(str(tmp_path))
    batch = pa.record_batch({"id": pa.array([1, 2], pa.int64())})
    writer.write(iter([batch]))  # killed after writing, before anybody heard of it
    done = writer.write(iter([batch]))

    def dies():
        yield batch
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    schema = spark.createDataFrame([], "id long").schema
    assert reply_sink.read_replies(spark, str(tmp_path), schema).count() == 0
    writer.commit([done, None, writer.write(iter([]))], 0)
    writer.commit([writer.write(iter([batch]))], 0)
    assert reply_sink.read_replies(spark, str(tmp_path), schema).count() == 2
    assert len(os.listdir(tmp_path / "data")) == 4


def test_an_aborted_batch_is_invisible(spark, tmp_path):
    writer = reply_sink.ReplyWriter(str(tmp_path))
    message = writer.write(iter([pa.record_batch({"id": pa.array([1], pa.int64())})]))
    writer.abort([message], 3)
    assert reply_sink.committed_files(str(tmp_path)) == [] == reply_sink.committed_files(new_folder(spark, "none").removeprefix("file:"))


def test_each_byte_of_a_part_is_read_once(tmp_path, monkeypatch):
    rows = [(i, request(i)) for i in range(3000)]
    write(str(tmp_path), rows)
    (name, size), = c.complete_files(str(tmp_path))
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def __getattr__(self, attribute):
            return getattr(self.f, attribute)

        def read(self, n):
            data = self.f.read(n)
            read.append(len(data))
            return data

    class Files:
        def open_input_file(self, path):
            return Counted(c.fs.LocalFileSystem().open_input_file(path))

    monkeypatch.setattr(c, "opened", lambda path: (Files(), path))
    for part_bytes in (size // 10, 10**9):
        read.clear()
        parts = c._parts(str(tmp_path), name, 0, size, part_bytes)
        assert [(f[0], f[3]) for p in parts for f in c.frames(p)] == rows
        assert sum(read) < 1.1 * size and len(read) < 10 * len(parts)


def test_a_long_connection_takes_time_in_proportion():
    def seconds(n):
        data = request(0) * n
        begin = time.perf_counter()
        assert sum(1 for _ in c.requests_of(data)) == n
        return time.perf_counter() - begin

    assert seconds(100_000) < 35 * min(seconds(10_000) for _ in range(3))


def test_shares_take_every_file_once_and_the_journal_is_listed_once(tmp_path, monkeypatch):
    for n in range(12):
        write(str(tmp_path / "in"), [(100 * n + i, request(i)) for i in range(10)], prefix=f"p{n:02}")
    listed, selector = [], c.fs.FileSelector
    monkeypatch.setattr(c.fs, "FileSelector", lambda root: listed.append(root) or selector(root))
    got, entries = [], 0
    for n in range(3):
        options = {"path": str(tmp_path / "in"), "journal": str(tmp_path / f"j{n}"), "maxBytes": "300", "share": f"{n}/3"}
        reader, last = c._StreamReader(options), -1
        while (entry := reader.latestOffset()["entry"]) != last:
            last = entry
        assert listed.count(options["journal"]) <= 1
        entries += last
        got += [f[0] for p in c._StreamReader(options).partitions({"entry": 0}, {"entry": last}) for f in c.frames(p)]
    assert sorted(got) == [100 * n + i for n in range(12) for i in range(10)] and entries > 12
