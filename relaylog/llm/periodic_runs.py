"""Periodic runs of words by maximal pairs in the LCP-interval tree.

A run is a stretch of words with a smallest period q (words q apart are equal) and a length of at least
max(``LEAST``, 2q) that no neighbouring word extends. A maximal pair is a pair of places whose words agree on L
words, but neither before nor after them. Its two places are q apart; where L >= q the stretch from the first place
to the end of the second match has period q and cannot be extended, so it is a run without further work. Multiples of
a run's period give pairs of the same stretch; the smallest stays.

So only pairs with q <= L and L + q >= LEAST count, hence L >= LEAST / 2, and only the LCP-interval tree from that
depth on is needed. For all texts of a slice at once, in numpy:

* windows of LEAST / 2 words that come twice in a text are found by hash (a superset; equal windows never differ),
* the suffixes there are sorted by prefix doubling, ranks kept, and the LCPs of neighbours read off the ranks,
* subtrees are left out that hold no pair: all left words equal, or places farther apart than their longest match.

The rest of each tree is walked bottom up. A node's places are kept by position, cut into classes of equal left
word; the smaller child is merged into the larger. For each place of the smaller one only places of another left
word within the node's depth are read, whole classes are jumped over. That costs O(log n) steps for every place,
besides the pairs themselves, of which a text of n words has O(n).

Defined results: null and empty texts have no words and no runs. Equal rows get equal results, a null ``doc_id`` is an
id like others. Extra columns are ignored. Of runs of equal length the first start is the longest, then the smallest
period. Memory in a task is a multiple of the slice (2 MB of text, or one text if that is longer).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from relaylog.llm.common import map_slices
from relaylog.llm.dart_minhash import mix
from relaylog.llm.words import numbered, split_words

LEAST = 12
DEPTH = LEAST // 2

# Given the ids of the texts, their numbers of words: for every word the place (in its own text) of the word to stand there.
Rewrite = Callable[[list, np.ndarray], np.ndarray]


class Places:
    """Positions of a subtree in order, and where a class of equal left words begins among them."""

    def __init__(self, position: int):
        self.at, self.heads = [position], [position]

    def add(self, p: int, left: dict[int, int]) -> None:
        i = bisect_left(self.at, p)
        before = left[self.at[i - 1]] if i else None
        after = left[self.at[i]] if i < len(self.at) else None
        own = left[p]
        if after is not None and (after == before) != (after == own):
            if after == own:
                self.heads.pop(bisect_left(self.heads, self.at[i]))
            else:
                insort(self.heads, self.at[i])
        if own != before:
            insort(self.heads, p)
        self.at.insert(i, p)

    def others(self, p: int, reach: int, left: dict[int, int]) -> list[int]:
        """Positions at most ``reach`` from ``p`` whose left word is another one."""
        at, heads, own, out = self.at, self.heads, left[p], []
        i = first = bisect_left(at, p)
        while i < len(at) and at[i] <= p + reach:
            if left[at[i]] != own:
                out.append(at[i])
                i += 1
            else:
                head = bisect_right(heads, at[i])
                if head == len(heads):
                    break
                i = bisect_left(at, heads[head])
        i = first - 1
        while i >= 0 and at[i] >= p - reach:
            if left[at[i]] != own:
                out.append(at[i])
                i -= 1
            else:
                i = bisect_left(at, heads[bisect_right(heads, at[i]) - 1]) - 1
        return out


def pairs_of_subtree(position: list[int], lcp: list[int], left: dict[int, int]) -> list[tuple[int, int, int]]:
    """Maximal pairs ``(first place, distance, match)`` with distance <= match, in one subtree of the LCP-interval tree.

    ``position`` are its suffixes in order, ``lcp[i]`` is the match of suffixes i - 1 and i.
    """
    found: list[tuple[int, int, int]] = []

    def merge(a: Places, b: Places, depth: int) -> Places:
        if len(a.at) < len(b.at):
            a, b = b, a
        for p in b.at:
            found.extend((min(p, x), abs(p - x), depth) for x in a.others(p, depth, left))
        for p in b.at:
            a.add(p, left)
        return a

    open_nodes: list[tuple[int, Places]] = []
    for i, p in enumerate(position):
        if i:
            depth = lcp[i]
            while open_nodes and open_nodes[-1][0] > depth:
                inner, places = open_nodes.pop()
                done = merge(places, done, inner)
            if open_nodes and open_nodes[-1][0] == depth:
                done = merge(open_nodes.pop()[1], done, depth)
            open_nodes.append((depth, done))
        done = Places(p)
    while open_nodes:
        inner, places = open_nodes.pop()
        done = merge(places, done, inner)
    return found


def repeated_windows(code: np.ndarray, text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places whose window of DEPTH words comes again in the text, and perhaps a few more."""
    count = len(code) - DEPTH + 1
    if count < 2:
        return np.zeros(0, np.int64)
    own = mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    h = mix(text[:count].astype(np.uint64))
    for j in range(DEPTH):
        h += own[j : j + count] * np.uint64(0xD1B54A32D192ED03 + 0x5851F42D4C957F2C * j & (1 << 64) - 1 | 1)
    place = np.flatnonzero(np.arange(count) + DEPTH <= end[:count])
    h = h[place]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(place), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return place[again]


def sorted_suffixes(code: np.ndarray, text: np.ndarray, end: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``again`` and just after it, in order within their text, and the LCP of each with the one before.

    LCPs under DEPTH come as 0. Two suffixes that agree on k >= DEPTH words have places k - DEPTH later that are in
    ``again``, so the ranks that prefix doubling asks for are always there.
    """
    spread = again[:, None] + np.arange(DEPTH + 1)
    near = np.unique(spread[spread < end[again][:, None]])
    where = np.full(len(code) + 1, -1, np.int64)
    where[near] = np.arange(len(near))

    padded = np.append(code, np.zeros(DEPTH, np.int64))
    window = [np.where(near + j < end[near], padded[near + j], 0) for j in range(DEPTH)]
    keys = [text[near]] + [(window[j] << 32) | window[j + 1] for j in range(0, DEPTH, 2)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    levels, size = [(DEPTH, rank)], DEPTH
    while True:
        many = np.bincount(rank, minlength=len(rank))[rank] > 1
        live = np.flatnonzero(many)
        if not len(live):
            break
        later = near[live] + size
        second = np.where(later < end[near[live]], rank[where[np.minimum(later, len(code))]], -1)
        order = np.lexsort((second, rank[live]))
        base, second = rank[live][order], second[order]
        at = np.arange(len(order))
        group = np.ones(len(order), bool)
        group[1:] = base[1:] != base[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        start = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[live[order]] = base + np.maximum.accumulate(np.where(part, at, 0)) - start
        size *= 2
        levels.append((size, rank))

    suffix = np.empty(len(near), np.int64)
    suffix[rank] = near
    a, b = suffix[:-1], suffix[1:]
    match = np.zeros(len(a), np.int64)
    for step, known in reversed(levels):
        i, j = where[np.minimum(a + match, len(code))], where[np.minimum(b + match, len(code))]
        within = (i >= 0) & (j >= 0) & (a + match < end[a]) & (b + match < end[b])
        match += np.where(within & (known[i] == known[j]), step, 0)
    open_pair = match >= DEPTH
    for _ in range(DEPTH):
        i, j = a + match, b + match
        open_pair &= (i < end[a]) & (j < end[b])
        open_pair &= padded[np.minimum(i, len(code))] == padded[np.minimum(j, len(code))]
        match += open_pair
    return suffix, np.concatenate([[0], np.where(match >= DEPTH, match, 0)])


def runs(code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start (in its text), length and period of all runs of the texts, in this order.

    ``code`` numbers the words of all texts in order, ``counts`` says how many each text has.
    """
    code = code + 1
    stop = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(stop, counts)
    begin = np.repeat(stop - counts, counts)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    again = repeated_windows(code, text, end)
    if not len(again):
        return none
    suffix, lcp = sorted_suffixes(code, text, end, again)
    left = np.where(suffix > begin[suffix], code[suffix - 1], 0)
    joined = lcp >= DEPTH
    subtree = np.cumsum(~joined) - 1
    heads = np.flatnonzero(~joined)
    diverse = np.zeros(len(suffix), bool)
    diverse[1:] = joined[1:] & (left[1:] != left[:-1])
    by_place = np.lexsort((suffix, subtree))
    gap = np.full(len(suffix), len(code))
    gap[1:] = np.where(joined[1:], np.diff(suffix[by_place]), len(code))
    wanted = np.add.reduceat(diverse, heads, dtype=np.int64) > 0
    wanted &= np.minimum.reduceat(gap, heads) <= np.maximum.reduceat(lcp, heads)
    ends = np.append(heads[1:], len(suffix))
    found: list[tuple[int, int, int]] = []
    for node in np.flatnonzero(wanted):
        part = slice(heads[node], ends[node])
        position = suffix[part].tolist()
        found += pairs_of_subtree(position, lcp[part].tolist(), dict(zip(position, left[part].tolist(), strict=True)))
    if not found:
        return none
    start, period, match = np.array(found, np.int64).T
    length = match + period
    long = length >= LEAST
    start, period, length = start[long], period[long], length[long]
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, period, length = start[first], period[first], length[first]
    order = np.lexsort((period, start))
    start, period, length = start[order], period[order], length[order]
    return text[start], start - begin[start], length, period


class Analysed:
    """The words of some texts, their runs, and which words stay when each run is cut to its first period."""

    def __init__(self, ids: list, texts: pa.Array, rewrite: Rewrite | None):
        self.words, self.counts = split_words(texts)
        self.before = np.cumsum(self.counts) - self.counts
        if rewrite:
            place = rewrite(ids, self.counts) + np.repeat(self.before, self.counts)
            self.words = self.words.take(pa.array(place))
        self.text, self.start, self.length, self.period = runs(numbered(self.words)[0], self.counts)
        steps = np.zeros(len(self.words) + 1, np.int64)
        at = self.before[self.text] + self.start
        np.add.at(steps, at + self.period, 1)
        np.add.at(steps, at + self.length, -1)
        self.stays = np.cumsum(steps[:-1]) == 0

    def collapsed(self) -> pa.Array:
        """Every text's remaining words, joined by one blank."""
        offsets = np.concatenate([[0], np.cumsum(self.stays)])[np.append(self.before, len(self.words))]
        kept = self.words.filter(pa.array(self.stays))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), kept), pa.scalar(" ", kept.type))


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, start, length, period`` of every run, counted in words from 0."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            made = Analysed(part.column("doc_id").to_pylist(), part.column("text"), rewrite)
            columns = [part.column("doc_id").take(pa.array(made.text)), *(pa.array(c) for c in (made.start, made.length, made.period))]
            return pa.record_batch(columns, ["doc_id", "start", "length", "period"])

        return step

    return map_slices(docs.select("doc_id", "text"), "text", work, "doc_id bigint, start bigint, length bigint, period bigint")


def collapse_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, text`` with every run cut to its first period; white space becomes one blank."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            made = Analysed(part.column("doc_id").to_pylist(), part.column("text"), rewrite)
            return pa.record_batch([part.column("doc_id"), made.collapsed().cast(pa.string())], ["doc_id", "text"])

        return step

    return map_slices(docs.select("doc_id", "text"), "text", work, "doc_id bigint, text string")


RUN_DIGEST = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def run_digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row for every text: number of runs, the longest one, and digests of all runs and of the collapsed text."""

    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            made = Analysed(part.column("doc_id").to_pylist(), part.column("text"), rewrite)
            n = part.num_rows
            number = np.bincount(made.text, minlength=n)
            order = np.lexsort((made.period, made.start, -made.length, made.text))
            has, first = np.unique(made.text[order], return_index=True)
            best = np.full(n, -1)
            best[has] = order[first]
            lines = [f"{s},{length},{q}\n" for s, length, q in zip(made.start.tolist(), made.length.tolist(), made.period.tolist(), strict=True)]
            cut = np.searchsorted(made.text, np.arange(n + 1))
            of_runs = [digest("".join(lines[a:b]).encode()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            texts = made.collapsed().cast(pa.large_binary()).to_pylist()

            def longest(values: np.ndarray) -> pa.Array:
                return pa.array(values[best] if len(values) else np.zeros(n, np.int64), pa.int64(), mask=best < 0)

            columns = [
                part.column("doc_id"), pa.array(number, pa.int64()), longest(made.start), longest(made.length), longest(made.period),
                longest(1000 * made.length // np.maximum(made.period, 1)), pa.array(of_runs), pa.array([digest(t) for t in texts]),
            ]
            return pa.record_batch(columns, [c.split()[0] for c in RUN_DIGEST.split(", ")])

        return step

    return map_slices(docs.select("doc_id", "text"), "text", work, RUN_DIGEST)
