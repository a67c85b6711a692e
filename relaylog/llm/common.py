"""Shared helpers: folds, bounded samples, Arrow slices and word tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SLICE_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept out of all training; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False)) if isinstance(doc_id, str) else (
        F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False)))


def trainable(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int | dict, seed: int = 17) -> DataFrame:
    """About ``per_class`` rows of each label (or as many as it says for the label), and never more than twice that.

    Rows are chosen by a hash of ``key``. One counting pass fixes the share of each label; the sample is a filter.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return rows.limit(0)
    wanted = {row[label]: per_class[row[label]] if isinstance(per_class, dict) else per_class for row in counts}
    shares = [(row[label], min(1.0, wanted[row[label]] / row["n"])) for row in counts]
    schema = StructType([rows.schema[label], StructField("_share", DoubleType())])
    shares = rows.sparkSession.createDataFrame(shares, schema)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(F.broadcast(shares), label).filter(draw < F.col("_share")).select(*rows.columns).limit(2 * sum(wanted.values()))


def text_blocks(rows: DataFrame, column: str, max_chars: int) -> DataFrame:
    """The rows, once for each block of about ``max_chars`` characters of their text, cut at white space where there is some."""

    def cut(text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > max_chars:
            space = text.rfind(" ", at + max_chars // 2, at + max_chars)
            end = space + 1 if space >= 0 else at + max_chars
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                blocks = [cut(t) if t is not None else [None] for t in part.column(column).to_pylist()]
                row = pa.array(np.repeat(np.arange(len(blocks)), [len(b) for b in blocks]))
                columns = [pa.array([t for b in blocks for t in b], pa.string()) if n == column else part.column(n).take(row) for n in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts add up to about ``max_bytes``; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size + 64)
    start = 0
    while start < len(size):
        base = ends[start] - size[start] - 64
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_slices(
    rows: DataFrame, column: str, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str,
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``work()`` (made once per task) to every slice of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                yield step(part)

    return rows.mapInArrow(run, schema)


def keep_rows(
    rows: DataFrame, column: str, work: Callable[[], Callable[[list], np.ndarray]], max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The rows, unchanged and with all columns, for whose text ``work()`` says True."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                yield part.filter(pa.array(np.asarray(step(part.column(column).to_pylist()), bool)))

    return rows.mapInArrow(run, rows.schema)


def code_points(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words as one flat array of code points, a line feed before, between and after them; and their numbers.

    The second array holds, for every position, the number of the word that ends at the next line feed.
    """
    flat = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(flat == 10) - 1
    return flat, word


def gram_hashes(flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` code points that lie in one word with its two ends; and their starts."""
    count = len(flat) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(count, n, np.uint64)
    inner = np.ones(count, bool)
    for i in range(n):
        part = flat[i : i + count]
        h = (h ^ part) * MIX
        h ^= h >> np.uint64(29)
        if 0 < i < n - 1:
            inner &= part != 10
    if n == 1:
        inner &= flat[:count] != 10
    elif n == 2:
        inner &= ~((flat[:count] == 10) & (flat[1 : 1 + count] == 10))
    start = np.flatnonzero(inner)
    return h[start], start


class WordTable:
    """Numbers distinct words and keeps one row of values for each; emptied when it has ``limit`` words.

    ``rows_of(words)`` computes the values of new words together, so that Python work per token is one look-up.
    """

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], limit: int = 200_000):
        self.rows_of, self.limit = rows_of, limit
        self.number: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.used = 0

    def look_up(self, words: list[str]) -> np.ndarray:
        """Values of the words, one row each."""
        new = list(set(words).difference(self.number))
        if new:
            if self.used + len(new) > self.limit:
                self.number, self.values, self.used = {}, None, 0
                new = list(set(words))
            made = self.rows_of(new)
            need = self.used + len(new)
            if self.values is None or need > len(self.values):
                room = np.empty((max(need, 2 * self.used), *made.shape[1:]), made.dtype)
                if self.used:
                    room[: self.used] = self.values[: self.used]
                self.values = room
            self.values[self.used : need] = made
            self.number.update(zip(new, range(self.used, need), strict=True))
            self.used = need
        if not words:
            return self.rows_of([])
        index = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return self.values[index]
