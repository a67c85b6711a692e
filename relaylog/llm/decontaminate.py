"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

A test item may differ from its copy in a document by ``budget`` edits, one for every ``PIECE`` characters but
the first. It is cut into ``budget + 1`` pieces: by the pigeonhole principle one of them is in any such copy
unchanged. One automaton finds all pieces of all items in a text; around each hit the item is matched with
Myers' bit-parallel distance, the whole item being one machine integer.

Items are a stated query set: they are dealt to blocks of a bounded size, and each block is held against all
documents. Texts and items are compared in lower case with single spaces; offsets are those of that form.

Defined results: null and empty texts have no hits; items without a word are skipped; equal items are reported
each; repeated rows are reported each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.llm.common import keep_rows, map_slices

PIECE = 16
BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id bigint, item_id bigint, distance int, budget int, start int, stop int"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(item: str, piece: int = PIECE) -> int:
    return max(0, len(item) // piece - 1)


def pieces_of(item: str, piece: int = PIECE) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of about equal length that make up the item, with their offsets."""
    count = budget_of(item, piece) + 1
    cuts = [round(i * len(item) / count) for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_match(item: str, text: str, masks: dict[str, int]) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any part of ``text``, and the first end of such a part."""
    size = len(item)
    high, full = 1 << (size - 1), (1 << size) - 1
    up, down, score = full, 0, size
    best, end = size, 0
    for i, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, i
    return best, end


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE):
        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            text = normal(text)
            if text:
                by_text.setdefault(text, []).append(item_id)
        self.items = list(by_text.items())
        self.budget = [budget_of(t, piece) for t, _ in self.items]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _) in enumerate(self.items):
            for offset, part in pieces_of(text, piece):
                places.setdefault(part, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for part, found in places.items():
            self.automaton.add_word(part, (len(part), found))
        if places:
            self.automaton.make_automaton()

    def _masks(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            made: dict[str, int] = {}
            for i, c in enumerate(self.items[k][0]):
                made[c] = made.get(c, 0) | 1 << i
            self.masks[k] = made
        return self.masks[k]

    def hits(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """``(item number, distance, start, stop)`` of the best match of each item that is within its budget."""
        if not self.items or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for k, offset in found:
                start = end - size + 1 - offset
                spans = windows.setdefault(k, [])
                reach = self.budget[k]
                low, up = start - reach, start + len(self.items[k][0]) + reach
                if spans and low <= spans[-1][1] and spans[-1][0] <= up:
                    spans[-1] = (min(spans[-1][0], low), max(spans[-1][1], up))
                else:
                    spans.append((low, up))
        out = []
        for k, spans in windows.items():
            item = self.items[k][0]
            at = text.find(item)
            best = (0, at, at + len(item)) if at >= 0 else None
            for low, up in spans if best is None else ():
                part = text[max(0, low) : up]
                distance, end = best_match(item, part, self._masks(k))
                if distance <= self.budget[k] and (best is None or distance < best[0]):
                    stop = max(0, low) + end
                    best = (distance, max(0, stop - len(item)), stop)
            if best is not None:
                out.append((k, *best))
                if first:
                    break
        return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about ``block_bytes``; a longer item is a block of its own.

    Items are dealt by a hash to twice as many shares as the total size asks for; a share that is still too
    large is cut on arrival.
    """
    items = benchmark.select("item_id", "text").filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for share in range(shares):
        part: list[tuple[int, str]] = []
        size = 0
        for row in items.filter(F.pmod(F.xxhash64("text"), F.lit(shares)) == share).toLocalIterator():
            if part and size + len(row.text) > block_bytes:
                yield part
                part, size = [], 0
            part.append((row.item_id, row.text))
            size += len(row.text)
        if part:
            yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, distance, budget, start, stop``: the best match of each item in each document that has it."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", "text")

    def against(items: list[tuple[int, str]]) -> DataFrame:
        shared = sc.broadcast(items)

        def work():
            matcher = Matcher(shared.value, piece)

            def step(part: pa.RecordBatch) -> pa.RecordBatch:
                out: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for k, distance, start, stop in matcher.hits(normal(text)):
                        out.extend((doc_id, i, distance, matcher.budget[k], start, stop) for i in matcher.items[k][1])
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                names = ["doc_id", "item_id", "distance", "budget", "start", "stop"]
                return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

            return step

        return map_slices(rows, "text", work, SCHEMA)

    found = [against(items) for items in blocks(benchmark, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, in which no item is found."""
    for items in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def work(shared=shared):
            matcher = Matcher(shared.value, piece)
            return lambda texts: np.array([not matcher.hits(normal(t), first=True) for t in texts], bool)

        docs = keep_rows(docs, "text", work)
    return docs
