"""Ranked lexical search by NRA: no random access, sequential reads of impact-sorted lists, score intervals.

The score of a document for an item is a sum over the item's terms of an impact, fixed by the term's weight, its
occurrences and the document's length. The index holds, for every document, its length and its terms that some item
has; it is written once, and the corpus statistics (N, L, document frequencies) are added up from it.

Search is partitioned by document. A task takes its part of the index shard by shard (``SHARD_POSTINGS``), turns it
into one list per term, sorted by falling impact, and reads an item's lists in rounds of growing blocks:

* Each document seen has a lower bound, the sum of what was read, and an upper bound: what the lists it was not yet
  seen in can still give, at most the next impact of each.
* The bar is the k-th best lower bound, in the shard or among all the task has found before.
* Once the next impacts together stay under the bar no unseen document can matter. From then on only documents whose
  upper bound reaches the bar are followed (equal ones too, since ties are decided by ``doc_id``).
* Reading goes on until every interval of those is a point. A list in which all of them were seen is read no further.

So scores, membership and ties are exact. A task emits k documents an item at most; the best k of all are ranked in
two steps, first by item and a salt, so that no task sees all candidates of an item. Items are taken in blocks of
``BLOCK_BYTES`` of terms, by a hash of their id; each block is one more pass over the documents, and only one block is
held by driver and tasks at a time.

Defined results: null texts have no term and are not counted in N. Items of one ``item_id`` are one item with the terms
of all. Items without a term that occurs have no rows. Repeated documents are all ranked, a null ``doc_id`` after
others of its score. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relaylog.llm.common import map_slices
from relaylog.llm.words import split_terms
from relaylog.session import materialise

SHARD_POSTINGS = 1_500_000
FIRST_READ = 128
BLOCK_BYTES = 32 << 20
SALTS = 16
RANKED = "item_id bigint, rank int, doc_id bigint, score bigint"


@dataclass(frozen=True)
class Items:
    """A block of items: ids, and the distinct numbers of each one's terms in the vocabulary."""

    ids: list[int | None]
    terms: list[np.ndarray]
    vocabulary: pa.Array


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``, each once."""

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            terms, counts = split_terms(part.column("text"))
            row = np.repeat(np.arange(part.num_rows), counts)
            return pa.record_batch([part.column("item_id").take(pa.array(row)), terms.cast(pa.string())], ["item_id", "term"])

        return step

    return map_slices(items.select(F.col("item_id").cast("bigint"), "text"), "text", work, "item_id bigint, term string").distinct()


def collected(terms: DataFrame) -> Items:
    """A block of items on the driver."""
    table = terms.toArrow()
    words = pc.dictionary_encode(table.column("term").combine_chunks().cast(pa.large_string()))
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    of_item: dict[int | None, list[int]] = {}
    for item, number in zip(table.column("item_id").to_pylist(), words.indices.to_pylist(), strict=True):
        of_item.setdefault(item, []).append(number)
    ids = sorted(of_item, key=lambda i: (i is None, i or 0))
    return Items(ids, [np.sort(np.array(of_item[i], np.int64)) for i in ids], words.dictionary)


def index(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``doc_id, n, terms, tfs``: length, and the numbers of the vocabulary's terms with their occurrences, packed as u4."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            words, counts = split_terms(part.column("text"))
            number = pc.index_in(words, value_set=shared.value).fill_null(-1).to_numpy().astype(np.int64)
            text = np.repeat(np.arange(part.num_rows), counts)
            known = number >= 0
            key, tf = np.unique(text[known] << 32 | number[known], return_counts=True)
            cut = (np.searchsorted(key >> 32, np.arange(part.num_rows + 1)) * 4).tolist()
            terms, tfs = (key & 0xFFFFFFFF).astype("<u4").tobytes(), tf.astype("<u4").tobytes()
            packed = [pa.array([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for raw in (terms, tfs)]
            return pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), *packed], ["doc_id", "n", "terms", "tfs"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_slices(rows, "text", work, "doc_id bigint, n bigint, terms binary, tfs binary")


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, their terms with repeats, and each term's documents."""

    documents: int
    length: int
    frequency: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1))) for df in self.frequency.tolist()], np.int64)


def statistics(indexed: DataFrame, terms: int) -> Statistics:
    """Corpus counts; each task adds up its own part first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(terms + 2, np.int64)
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy()
                count[terms] += np.count_nonzero(n)
                count[terms + 1] += n.sum()
                count[:terms] += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4"), minlength=terms)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some), pa.array(count[some])], ["term", "n"])

    rows = indexed.select("n", "terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(terms + 2, np.int64)
    for row in rows:
        count[row.term] = row.n
    return Statistics(int(count[terms]), int(count[terms + 1]), count[:terms])


class Shard:
    """Impact-sorted lists of the terms of some documents."""

    def __init__(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, known: Statistics, weight: np.ndarray):
        m = 50 + 50 * n * known.documents // max(known.length, 1)
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
        some = impact > 0
        row, term, impact = row[some], term[some], impact[some]
        most = int(impact.max(initial=0))
        if (most + 1) * (len(weight) + 1) < 1 << 62:
            order = np.argsort(term * (most + 1) + (most - impact))
        else:
            order = np.lexsort((-impact, term))
        self.row, self.impact = row[order], impact[order]
        self.cut = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.lower = np.zeros(len(n), np.int64)
        self.place = np.full(len(n), -1, np.int64)

    def best(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of all documents that may be among the best k, given that k others reach ``bar`` elsewhere."""
        spans = [(a, b) for a, b in zip(self.cut[terms].tolist(), self.cut[terms + 1].tolist(), strict=True) if a < b]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, end = (np.array(c, np.int64) for c in zip(*spans, strict=True))
        lower, seen = self.lower, np.zeros((len(spans), len(self.lower)), bool)
        lower[:] = 0
        bar, step, impact = max(bar, 1), FIRST_READ, np.append(self.impact, 0)

        def following() -> np.ndarray:
            """The most that each list can still give to a document not yet seen in it."""
            return np.where(at < end, impact[at], 0)

        while True:
            for t in np.flatnonzero(at < end).tolist():
                stop = min(at[t] + step, end[t])
                rows = self.row[at[t] : stop]
                lower[rows] += self.impact[at[t] : stop]
                seen[t, rows] = True
                at[t] = stop
            step *= 2
            ahead = following()
            if len(lower) >= k:
                bar = max(bar, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            if ahead.sum() < bar:
                break

        rows = np.flatnonzero(lower + ahead.sum() >= bar)
        score, met = lower[rows], seen[:, rows]
        while True:
            upper = score + ahead @ ~met
            if len(score) >= k:
                bar = max(bar, int(np.partition(score, len(score) - k)[len(score) - k]))
            stays = upper >= bar
            if not stays.all():
                rows, score, met, upper = rows[stays], score[stays], met[:, stays], upper[stays]
            if (upper == score).all():
                return rows, score
            self.place[rows] = np.arange(len(rows))
            for t in np.flatnonzero((at < end) & ~met.all(axis=1)).tolist():
                stop = min(at[t] + step, end[t])
                place = self.place[self.row[at[t] : stop]]
                here = place >= 0
                score[place[here]] += self.impact[at[t] : stop][here]
                met[t, place[here]] = True
                at[t] = stop
            self.place[rows] = -1
            step *= 2
            # A list in which all were seen is not read on; it has nothing more to give to them.
            ahead = following()


class Best:
    """The best k documents of every item so far."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        empty = np.zeros((3, 0), np.int64)
        self.found = [empty for _ in items.ids]

    def bar(self, i: int) -> int:
        found = self.found[i]
        return int(found[0, -1]) if found.shape[1] == self.k else 0

    def add(self, i: int, score: np.ndarray, nameless: np.ndarray, doc_id: np.ndarray) -> None:
        both = np.concatenate([self.found[i], np.stack([score, nameless, doc_id])], axis=1)
        order = np.lexsort((both[2], both[1], -both[0]))[: self.k]
        self.found[i] = both[:, order]

    def batch(self) -> pa.RecordBatch:
        number = np.repeat(np.arange(len(self.found)), [f.shape[1] for f in self.found])
        score, nameless, doc_id = np.concatenate(self.found, axis=1) if self.found else np.zeros((3, 0), np.int64)
        ids = pa.array(self.items.ids, pa.int64()).take(pa.array(number))
        return pa.record_batch([ids, pa.array(doc_id, mask=nameless.astype(bool)), pa.array(score)], ["item_id", "doc_id", "score"])


def search_index(indexed: DataFrame, items: Items, known: Statistics, k: int, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """``item_id, doc_id, score`` of the best k documents of every item in each task's part of the index."""
    weight = known.weights()
    shared = indexed.sparkSession.sparkContext.broadcast((items, known, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, weight = shared.value
        best = Best(items, k)
        held: list[pa.RecordBatch] = []
        size = 0

        def search() -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            n = part.column("n").to_numpy()
            term, tf = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("terms", "tfs"))
            row = np.repeat(np.arange(len(n)), pc.binary_length(part.column("terms")).to_numpy() // 4)
            doc_id = part.column("doc_id")
            nameless = doc_id.is_null().to_numpy().astype(np.int64)
            doc_id = doc_id.fill_null(0).to_numpy()
            shard = Shard(n, row, term, tf, known, weight)
            for i, terms in enumerate(items.terms):
                rows, score = shard.best(terms, k, best.bar(i))
                best.add(i, score, nameless[rows], doc_id[rows])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("terms")).to_numpy() // 4 + 8)
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + shard_postings - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= shard_postings or start < batch.num_rows:
                    search()
                    held, size = [], 0
        if held:
            search()
        yield best.batch()

    return indexed.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of every item, ranked from 1."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of every item."""
    spark = docs.sparkSession
    terms = materialise(item_terms(items), "search-items")
    total = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = []
    for number in range(blocks):
        held = collected(terms.filter(block == number))
        if not held.ids:
            continue
        indexed = materialise(index(docs, held.vocabulary), "search-index")
        found = ranked(search_index(indexed, held, statistics(indexed, len(held.vocabulary)), k), k)
        parts.append(materialise(found, "search-ranks") if blocks > 1 else found)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RANKED)
