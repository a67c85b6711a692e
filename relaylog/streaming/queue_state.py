"""The request/reply queue as a stateful stream, one queue per channel.

Micro-batches bring rows in any order. Rows wait in a buffer until the watermark has passed
them, then run in ``(ts, event_id)`` order. Each key of the state, and each call on it, is a round
trip to the JVM, so channels share a key by hash, with one buffer and one timer, and state is kept
in packs: buffered rows by the thousand, a channel's waiting messages by place and its unanswered
ones by hash of their uid. An operation touches packs of bounded size, so a long backlog costs no
more than a short one; a pack is read and written at most once in a run, and what is made and used
up within one run never reaches the store.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from relaylog.operators.queue import NOT_SERVED, forward_status, forward_uid
from relaylog.streaming.jobs import timed

OUTPUT = "event_id long, channel long, method string, status int, q long, pend long, msgs long"
# Messages go by "u" and their uid; one without a uid, or with that of a message still held, by "p" and its place: no POST can name it.
_ROW = ["channel", "us", "event_id", "method", "uid", "target", "bad"]
_RESULT = ["event_id", "channel", "method", "status", "q", "pend", "msgs"]
ROWS_PER_PACK = 1_000
PLACES_PER_PACK = 256
UIDS_PER_PACK = 64
# Keys of the state. The rows of one key that fall due at once are sorted in memory; like the number of shuffle partitions, this is fixed for the life of a stream.
GROUPS = 4_096
_FRAME = 10_000


def _packs(rows: list[str], us: list[int]) -> list[tuple[int, str]]:
    """Rows, each a JSON text, as JSON lists of bounded length, each with its earliest time."""
    cuts = [slice(i, i + ROWS_PER_PACK) for i in range(0, len(rows), ROWS_PER_PACK)]
    return [(min(us[cut]), f"[{','.join(rows[cut])}]") for cut in cuts]


class _Line:
    """Places of waiting messages → uid, from ``head`` on and before ``tail``; a pack holds the places with one quotient."""

    def __init__(self, state, channel: str, head: int, tail: int):
        self.state, self.channel, self.head, self.tail = state, channel, head, tail
        self.stored = range(head // PLACES_PER_PACK, (tail - 1) // PLACES_PER_PACK + 1) if head < tail else range(0)
        # Quotient → the first place and the uids from there on.
        self.packs: dict[int, tuple[int, list[str]]] = {}
        self.changed: set[int] = set()

    def _pack(self, place: int) -> tuple[int, list[str]]:
        n = place // PLACES_PER_PACK
        if n not in self.packs:
            if n in self.stored:
                first, uids = self.state.getValue((self.channel, n))
                self.packs[n] = first, json.loads(uids)
            else:
                self.packs[n] = place, []
        return self.packs[n]

    def put(self, uid: str) -> None:
        self._pack(self.tail)[1].append(uid)
        self.changed.add(self.tail // PLACES_PER_PACK)
        self.tail += 1

    def take(self) -> str:
        first, uids = self._pack(self.head)
        uid = uids[self.head - first]
        self.head += 1
        if self.head % PLACES_PER_PACK == 0:
            del self.packs[self.head // PLACES_PER_PACK - 1]
        return uid

    def write(self) -> None:
        # An empty line keeps no pack, so the next message starts one of its own.
        kept = range(self.head // PLACES_PER_PACK, (self.tail - 1) // PLACES_PER_PACK + 1) if self.head < self.tail else range(0)
        for n in self.stored:
            if n not in kept:
                self.state.removeKey((self.channel, n))
        for n in sorted(self.changed):
            if n in kept:
                first, uids = self.packs[n]
                done = max(0, self.head - first)
                self.state.updateValue((self.channel, n), (first + done, json.dumps(uids[done:])))


class _Held:
    """Uid → taken flag of the ``size`` unanswered messages, in packs by hash whose number doubles as they grow."""

    def __init__(self, state, channel: str, packs: int, size: int):
        self.state, self.channel, self.count, self.empty = state, channel, packs, size == 0
        self.packs: dict[int, dict[str, int]] = {}
        self.stored: set[int] = set()
        self.changed: set[int] = set()

    def _number(self, uid: str, packs: int) -> int:
        return zlib.crc32(uid.encode()) % packs

    def _pack(self, n: int) -> dict[str, int]:
        if n not in self.packs:
            found = None if self.empty else self.state.getValue((self.channel, n))
            if found is not None:
                self.stored.add(n)
            self.packs[n] = json.loads(found[0]) if found is not None else {}
        return self.packs[n]

    def taken(self, uid: str) -> int | None:
        """Flag of an unanswered message, None when there is no such message."""
        return self._pack(self._number(uid, self.count)).get(uid)

    def set(self, uid: str, flag: int | None) -> None:
        n = self._number(uid, self.count)
        if flag is None:
            del self._pack(n)[uid]
        else:
            self._pack(n)[uid] = flag
        self.changed.add(n)

    def _write(self, n: int, pack: dict[str, int], stored: bool) -> None:
        if pack:
            self.state.updateValue((self.channel, n), (json.dumps(pack),))
        elif stored:
            self.state.removeKey((self.channel, n))

    def write(self, size: int) -> int:
        """Write what changed and return the number of packs."""
        packs = self.count
        while packs * UIDS_PER_PACK < size:
            packs *= 2
        if packs == self.count:
            for n in sorted(self.changed):
                self._write(n, self.packs[n], n in self.stored)
            return packs if size else 1
        for n in range(self.count):
            # The entries of a pack go to the packs whose number leaves the same rest.
            parts: dict[int, dict[str, int]] = {n: {}}
            for uid, flag in self._pack(n).items():
                parts.setdefault(self._number(uid, packs), {})[uid] = flag
            for m, part in parts.items():
                self._write(m, part, m in self.stored)
            del self.packs[n]
        return packs


class QueueProcessor(StatefulProcessor):
    """State of a group of channels: ``buffer`` rows not yet due, ``due`` time of the timer, and by channel ``counts`` places,
    pending count and packs of ``held``, ``line`` place → uid of waiting messages, ``held`` uid → taken flag of unanswered ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "first long, rows string")
        self.line = handle.getMapState("line", "channel string, pack long", "first long, uids string")
        self.held = handle.getMapState("held", "channel string, pack long", "uids string")
        self.counts = handle.getMapState("counts", "channel string", "head long, tail long, pend long, msgs long, packs long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            new = _packs(pdf["row"].tolist(), pdf["us"].tolist())
            if new:
                self.buffer.appendList(new)
                low = min(first for first, _ in new)
                earliest = low if earliest is None else min(earliest, low)
        if earliest is not None:
            self._wake_at(-(-earliest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest, kept = [], [], []
        for first, texts in self.buffer.get():
            if first > limit:
                kept.append((first, texts))
                continue
            for row in json.loads(texts):
                (ready if int(row[1]) <= limit else rest).append(row)
        # Sorted, so that the next time most packs are not due as a whole.
        rest.sort(key=lambda r: int(r[1]))
        kept += _packs([json.dumps(r) for r in rest], [int(r[1]) for r in rest])
        self.due.clear()
        if kept:
            self.buffer.put(kept)
            self._wake_at(-(-min(first for first, _ in kept) // 1000))
        else:
            self.buffer.clear()
        ready.sort(key=lambda r: (r[0] or "", int(r[1]), int(r[2])))
        out: list[tuple] = []
        for channel, due in groupby(ready, key=lambda r: r[0]):
            for result in self._run(channel, due):
                out.append(result)
                if len(out) == _FRAME:
                    yield pd.DataFrame(out, columns=_RESULT)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=_RESULT)

    def close(self) -> None:
        pass

    def _wake_at(self, ms: int) -> None:
        """Keep one timer, for the earliest row."""
        pending = self.due.get()
        if pending is not None:
            if pending[0] <= ms:
                return
            self.handle.deleteTimer(pending[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def _run(self, name: str | None, rows: Iterator[list]) -> Iterator[tuple]:
        key, channel = name or "", None if name is None else int(name)
        head, tail, pend, msgs, packs = self.counts.getValue((key,)) or (0, 0, 0, 0, 1)
        line, held = _Line(self.line, key, head, tail), _Held(self.held, key, packs, msgs)
        for _, _, event_id, method, uid, target, bad in rows:
            status = 200
            if method == "PUT":
                if not uid or held.taken(uid) is not None:
                    uid = f"p{line.tail}"
                line.put(uid)
                held.set(uid, 0)
                msgs, status = msgs + 1, 202
            elif method == "GET":
                if line.head == line.tail:
                    status = 204
                else:
                    front, pend = line.take(), pend + 1
                    if held.taken(front) is None:
                        status = 503
                    else:
                        held.set(front, 1)
            elif method == "POST":
                if bad == "true":
                    status = 400
                elif not target or (taken := held.taken(target)) is None:
                    status = 300
                else:
                    pend -= taken
                    held.set(target, None)
                    msgs -= 1
            elif method == "HEAD":
                status = 200 if line.head < line.tail else 204
            elif method in NOT_SERVED:
                status = 405
            yield int(event_id), channel, method, status, line.tail - line.head, pend, msgs
        line.write()
        self.counts.updateValue((key,), (line.head, line.tail, pend, msgs, held.write(msgs)))


def stream_queue(stream: DataFrame, delay: str) -> DataFrame:
    """Replay a message stream; rows later than ``delay`` behind the newest are dropped and
    show up in the query's progress as rows dropped by watermark."""
    fields = {
        "channel": F.col("channel"), "us": F.unix_micros("ts"), "event_id": F.col("event_id"), "method": F.col("method"),
        "uid": F.coalesce(F.concat(F.lit("u"), "uid"), F.lit("")),
        "target": F.coalesce(F.concat(F.lit("u"), forward_uid()), F.lit("")), "bad": forward_status().isNotNull(),
    }
    # One text for each row: Python gets a row as it is stored.
    row = F.to_json(F.array(*[fields[f].cast("string") for f in _ROW]))
    rows = timed(stream, delay).select(
        F.pmod(F.xxhash64("channel"), F.lit(GROUPS)).alias("group"), "ts", fields["us"].alias("us"), row.alias("row")
    )
    return rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=QueueProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
