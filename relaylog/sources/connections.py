"""Captured connections as a source, batch and stream, and as a sink: Spark data source ``connections``.

A capture file starts with a marker of its own. Each connection follows as the marker, a line ``id ts_us listener
length`` and its bytes, so reading can begin anywhere in a file: a frame belongs to the part of the file in which its
marker starts. A connection carries any number of requests one after another; each becomes a row.

As a stream the source admits at most ``maxBytes`` a batch. What it admits, as parts of files, it first writes to a
journal under ``journal``; offsets count journal entries, so they never go back, and a restart in the middle of a file
goes on where the last batch ended. Files are taken in the order of their names once they are complete; the sink
writes them under names beginning with ``_`` and renames them when all tasks are done. ``share`` ``i/n`` lets n streams,
each with a journal of its own, take a folder side by side: each file belongs to one of them by its name.

``path`` and ``journal`` are folders that pyarrow's file systems can open from all machines.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

REQUESTS = "connection bigint, number int, ts timestamp, listener string, raw string"
CONNECTIONS = "connection bigint, ts timestamp, listener string, data binary"
PART_BYTES = 32 << 20
_MARKER = 16
_READ = 1 << 20
_LINE = 256
_END = re.compile(rb"\r\n\r\n|\n\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def complete_files(path: str) -> list[tuple[str, int]]:
    """Name and size of the files that are complete, by name."""
    system, root = opened(path)
    if system.get_file_info(root).type == fs.FileType.NotFound:
        return []
    found = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(root)) if i.is_file]
    return sorted((name, size) for name, size in found if not name.startswith(("_", ".")))


def requests_of(data: bytes) -> Iterator[bytes]:
    """The requests of a connection, cut by the end of each head and its content length. What has no end of head is the last one."""
    at = 0
    while at < len(data):
        # One search that ends at the nearer separator; looking for each of them would run to the end of the data for every request.
        ended = _END.search(data, at)
        if not ended:
            yield data[at:]
            return
        length = _LENGTH.search(data, at, ended.end())
        end = ended.end() + (int(length[1]) if length else 0)
        yield data[at:end]
        at = end


@dataclass
class Part(InputPartition):
    """The frames of a file whose marker starts from ``start`` on and before ``end``."""

    path: str
    name: str
    start: int
    end: int


def frames(part: Part) -> Iterator[tuple[int, int, str, bytes]]:
    """Connection, time in microseconds, listener and bytes of each frame of a part."""
    system, root = opened(part.path)
    with system.open_input_file(f"{root}/{part.name}") as f:
        marker = f.read(_MARKER)
        at = max(part.start, _MARKER)
        f.seek(at)
        # ``held`` are the bytes from ``at`` on, the first ``used`` of them done; each byte of the file is read once.
        held, used = b"", 0
        while True:
            found = held.find(marker, used)
            while found < 0:
                # A marker may lie across two reads; one that starts before the end needs no byte behind ``room``.
                at, held, used = at + max(used, len(held) - _MARKER + 1), held[max(used, len(held) - _MARKER + 1) :], 0
                room = part.end + _MARKER - 1 - at - len(held)
                more = f.read(min(_READ, room)) if room > 0 else b""
                if not more:
                    return
                held += more
                found = held.find(marker)
            if at + found >= part.end:
                return
            head = found + _MARKER
            while (line := held.find(b"\n", head)) < 0:
                more = f.read(_LINE)
                if not more:
                    raise EOFError(f"{part.name} ends inside the line of a frame")
                held += more
            number, ts, listener, size = held[head:line].decode().split(" ", 3)
            used = line + 1 + int(size)
            data = held[line + 1 : used]
            if used > len(held):
                data += f.read(used - len(held))
                at, held, used = at + used, b"", 0
            yield int(number), int(ts), listener, data


def _rows(part: Part) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("connection", pa.int64()), ("number", pa.int32()), ("ts", pa.timestamp("us", "UTC")), ("listener", pa.string()), ("raw", pa.string()),
    ])
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(5)], schema=schema)

    for connection, ts, listener, data in frames(part):
        for number, raw in enumerate(requests_of(data)):
            rows.append((connection, number, ts, listener, raw.decode("utf-8", "replace")))
            size += len(raw)
        if size >= _READ:
            yield batch()
            rows.clear()
            size = 0
    if rows:
        yield batch()


def _parts(path: str, name: str, start: int, end: int, part_bytes: int) -> list[Part]:
    return [Part(path, name, at, min(at + part_bytes, end)) for at in range(start, end, part_bytes)]


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part_bytes = options["path"], int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Part]:
        return [p for name, size in complete_files(self.path) for p in _parts(self.path, name, 0, size, self.part_bytes)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        # Without any part Spark asks for one that is None.
        return iter(()) if partition is None else _rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.journal = options["path"], options["journal"]
        self.part_bytes, self.most = int(options.get("partBytes", PART_BYTES)), int(options.get("maxBytes", 1 << 62))
        self.share, self.shares = (int(n) for n in options.get("share", "0/1").split("/"))
        self.last: int | None = None

    def _entry(self, number: int) -> dict | None:
        system, root = opened(self.journal)
        if system.get_file_info(f"{root}/{number}.json").type == fs.FileType.NotFound:
            return None
        with system.open_input_file(f"{root}/{number}.json") as f:
            return json.loads(f.read())

    def _last(self) -> int:
        """The newest entry. The journal is listed once; from then on one look for the next entry is enough, however long it grows."""
        system, root = opened(self.journal)
        if self.last is None:
            if system.get_file_info(root).type == fs.FileType.NotFound:
                return 0
            self.last = max((int(i.base_name[:-5]) for i in system.get_file_info(fs.FileSelector(root)) if re.fullmatch(r"\d+\.json", i.base_name)), default=0)
        while system.get_file_info(f"{root}/{self.last + 1}.json").type != fs.FileType.NotFound:
            self.last += 1
        return self.last

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        """Admit the next bytes, up to the bound, and note them before Spark hears of them."""
        last = self._last()
        before = self._entry(last) if last else {"file": "", "at": 0, "parts": []}
        room, file, at, parts = self.most, before["file"], before["at"], []
        for name, size in complete_files(self.path):
            start = at if name == file else 0
            if name < file or start >= size or room <= 0 or zlib.crc32(name.encode()) % self.shares != self.share:
                continue
            end = min(size, start + room)
            parts.append([name, start, end])
            room, file, at = room - (end - start), name, end
        if not parts:
            return {"entry": last}
        system, root = opened(self.journal)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_{last + 1}.json") as f:
            f.write(json.dumps({"file": file, "at": at, "parts": parts}).encode())
        system.move(f"{root}/_{last + 1}.json", f"{root}/{last + 1}.json")
        return {"entry": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        admitted = [p for n in range(start["entry"] + 1, end["entry"] + 1) for p in self._entry(n)["parts"]]
        return [p for name, a, b in admitted for p in _parts(self.path, name, a, b, self.part_bytes)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.prefix = options.get("prefix", "part")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        name, marker = f"{self.prefix}-{uuid.uuid4().hex}", uuid.uuid4().bytes
        written = False
        with system.open_output_stream(f"{root}/_{name}") as f:
            f.write(marker)
            for batch in iterator:
                micros = batch.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
                for number, ts, listener, data in zip(batch.column("connection").to_pylist(), micros, batch.column("listener").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    f.write(marker + f"{number} {ts} {listener} {len(data)}\n".encode() + data)
                    written = True
        return _Written([name] if written else [])

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = opened(self.path)
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        """Files that were not renamed are not read."""


class Connections(DataSource):
    @classmethod
    def name(cls) -> str:
        return "connections"

    def schema(self) -> str:
        return REQUESTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read``, ``readStream`` and ``write`` know the format ``connections``."""
    spark.dataSource.register(Connections)
