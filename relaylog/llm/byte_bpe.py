"""Byte-level BPE encoding and decoding with the ranks of a given vocabulary.

A text is cut into pieces by the vocabulary's pattern. A piece that is a token is that token; any other piece
starts as bytes, and the neighbouring pair with the lowest rank, the leftmost of equals, is merged until no pair
has a rank. A segment tree over the byte positions holds the leftmost lowest pair at its root, so each merge
needs only three point updates of logarithmic length: at the merged pair, at the byte it swallows, and at the
live neighbour on the left.

All new pieces of a slice are encoded together: one row of arrays per piece, and each step merges once in every
piece that still has a pair. Encoded pieces are kept, up to ``CACHE`` of them.

Defined results: a null or empty text has no ids and decodes to no bytes. Special tokens are ordinary text.
Repeated rows get equal results, extra columns are ignored.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from relaylog.llm.common import MIX, map_slices

CACHE = 300_000
CELLS = 1 << 19
NONE = np.int64(1 << 62)


@dataclass(frozen=True)
class Vocabulary:
    """The lines of a rank file, and the pattern that cuts texts into pieces."""

    lines: bytes
    pattern: str


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """The rank file at a path that the driver can open; it is sent to the tasks."""
    with open(path, "rb") as f:
        return Vocabulary(f.read(), pattern)


class Merger:
    """Ranks of tokens and of pairs of tokens."""

    def __init__(self, lines: bytes):
        pairs = (line.split() for line in lines.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        found = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        keys = np.array(list(found), np.int64)
        # Open addressing: every key sits at the first free place after its hash.
        self.room = 1 << (4 * len(keys) + 2).bit_length()
        self.keys = np.full(self.room + 64, -1, np.int64)
        self.pair_ranks = np.full(self.room + 64, NONE)
        wait, ranks = keys, np.array(list(found.values()), np.int64)
        place = self._place(wait)
        while len(wait):
            free = self.keys[place] == -1
            _, first = np.unique(place[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[place[taken]], self.pair_ranks[place[taken]] = wait[taken], ranks[taken]
            rest = np.ones(len(wait), bool)
            rest[taken] = False
            wait, ranks, place = wait[rest], ranks[rest], place[rest] + 1
        size = int(self.byte_id.max()) + 1
        at = np.arange(size)
        self.byte_pairs = self.rank_of(np.repeat(at, size), np.tile(at, size)).reshape(size, size)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX) >> np.uint64(65 - self.room.bit_length())).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE where the pair is no token."""
        key = (left << 32) | right
        place = self._place(key)
        there = self.keys[place]
        out = np.where(there == key, self.pair_ranks[place], NONE)
        wait = np.flatnonzero((there != key) & (there != -1))
        while len(wait):
            place[wait] += 1
            there = self.keys[place[wait]]
            hit = there == key[wait]
            out[wait[hit]] = self.pair_ranks[place[wait[hit]]]
            wait = wait[~hit & (there != -1)]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        rest: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                rest.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
        for size, members in rest.items():
            step = max(1, CELLS // size)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most ``size`` bytes (a power of two), one segment tree each, merged in step.

        All arrays are flat: byte ``i`` of piece ``k`` is at ``k * size + i``, node ``j`` of its tree at
        ``k * 2 * size + j``. A leaf is ``rank * size + i``, so the smallest is the leftmost lowest pair.
        """
        count = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, count)
        place = np.arange(size)
        inside = place < length[:, None]
        token = np.zeros((count, size), np.int64)
        token[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((count, 2 * size), NONE)
        pair = inside[:, 1:]
        rank = self.byte_pairs[token[:, :-1][pair], token[:, 1:][pair]]
        leaves = tree[:, size : 2 * size - 1]
        leaves[pair] = np.where(rank < NONE, rank * size + np.nonzero(pair)[1], NONE)
        level = size // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        token, tree, live = token.ravel(), tree.ravel(), inside.ravel().copy()
        after, before = np.tile(place + 1, count), np.tile(place - 1, count)

        active = np.flatnonzero(tree[1 :: 2 * size] < NONE)
        while len(active):
            row, root = active * size, active * (2 * size)
            best = tree[root + 1]
            at, merged = best % size, best // size
            gone = after[row + at]
            follow = after[row + gone]
            token[row + at] = merged
            after[row + at] = follow
            live[row + gone] = False
            has_next = np.flatnonzero(follow < length[active])
            before[row[has_next] + follow[has_next]] = at[has_next]
            left = before[row + at]
            has_left = np.flatnonzero(left >= 0)
            # New ranks of the merged pair and of its left neighbour, found together.
            first = np.concatenate([merged[has_next], token[row[has_left] + left[has_left]]])
            second = np.concatenate([token[row[has_next] + follow[has_next]], merged[has_left]])
            rank = self.rank_of(first, second)
            column = np.concatenate([at[has_next], left[has_left]])
            value = np.where(rank < NONE, rank * size + column, NONE)
            # Three point updates: the swallowed byte, the pair at the merged token, the pair before it.
            tree[root + gone + size] = NONE
            tree[root + at + size] = NONE
            base = np.concatenate([root[has_next], root[has_left]])
            tree[base + column + size] = value
            base = np.concatenate([base, root, root])
            node = np.concatenate([column, at, gone]) + size
            for _ in range(size.bit_length() - 1):
                node >>= 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
            active = active[tree[root + 1] < NONE]
        ids = token[live].astype("<u4").tobytes()
        ends = np.cumsum(live.reshape(count, size).sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def merger(lines: bytes) -> Merger:
    """One per Python worker, which serves many tasks."""
    return Merger(lines)


class Encoder:
    """Whole texts to ids, with the ids of pieces seen before."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.merger, self.cut, self.cache = merger(vocabulary.lines), regex.compile(vocabulary.pattern), cache
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut.findall(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > self.cache:
            self.known = {}
            new = list(set().union(*cut))
        self.known.update(zip(new, self.merger.encode([p.encode() for p in new]), strict=True))
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]


def encode(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row, ids packed as little-endian unsigned 32-bit integers.

    With ``decoded`` the bytes that the ids stand for come along, so that a round trip needs one pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        encoder = Encoder(shared.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder(part.column("text").to_pylist())
            columns, names = [part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"]
            if decoded:
                columns.append(pa.array(map(encoder.merger.decode, ids), pa.binary()))
                names.append("decoded")
            return pa.record_batch(columns, names)

        return step

    schema = "doc_id bigint, ids binary" + (", decoded binary" if decoded else "")
    return map_slices(docs.select("doc_id", "text"), "text", work, schema, max_bytes=2 << 20)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, decoded`` (bytes) of rows with packed ids; null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        own = merger(shared.value.lines)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            made = [own.decode(ids or b"") for ids in part.column("ids").to_pylist()]
            return pa.record_batch([part.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "decoded"])

        return step

    return map_slices(encoded.select("doc_id", "ids"), "ids", work, "doc_id bigint, decoded binary")
