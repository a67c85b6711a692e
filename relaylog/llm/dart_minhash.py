"""Near-duplicate classes by weighted minwise hashing with darts.

A text is a weighted set: its shingles of five words, weighted by how often they come. Every shingle owns a
region, as high as its weight; darts fall on all regions at one rate, ordered by rank, at places that a hash
decides, so equal regions get equal darts in every text. Each dart names one of ``K`` coordinates; a text keeps
for each coordinate the earliest dart that hits one of its regions. Two texts agree on a coordinate with a
probability equal to their weighted Jaccard similarity. On average a text needs about ``K ln K + 2 K`` darts,
however long it is, besides one look at each shingle.

``ROWS`` coordinates form a band; texts that agree on a band share a bucket. Nobody's bucket is gathered:

* Copies of a text are one node (by a 64-bit hash of the text).
* Each bucket elects a hub, the first in an order of all texts, by a minimum that is added up before the shuffle; other
  members are compared with the hub only. As the order is the same everywhere, the buckets of a large group agree on
  few hubs. The links give components.
* Buckets that still hold several components are compared in full, in salted blocks: members outside the bucket's
  largest component with each other and with that component. Inside a unit of two blocks the shared shingles of all
  pairs are counted by one matrix product over the shingles that come twice in the unit; pairs of one component are not
  looked at. Of the links found a unit returns a spanning forest, so never more rows than it has members.

Nothing is estimated and no candidate is dropped: a pair of texts is lost only if it shares no bucket. With 30 bands of 5,
that has a probability of 7e-6 at a similarity of exactly 0.8, and of 2e-8 at 0.85. The work is linear but for the second
step, where it grows with (members outside the largest component) x (members) of a bucket.

Similarity is computed from 32-bit numbers of the shingles. Two different shingles of a pair of 500 words fall on one number
for one pair in 10,000, which then counts one shingle too many.

Defined results: texts with fewer than five words are one shingle. Null texts and texts without a word are classes
of their own. Words are compared in lower case. Repeated rows belong to one class. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylog.llm.common import WordTable, map_slices
from relaylog.llm.components import components
from relaylog.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
K = BANDS * ROWS
# A block has at most about so many members and so many bytes of shingle numbers.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
COLUMNS = 2048
PAIRS_PER_HUB = 256
# So many 64-bit hashes may be broadcast; beyond it the same join runs by shuffle.
BROADCAST_NODES = 500_000
HOT_KEYS = 5_000
# What str.split takes for white space, in sketches.
SPACES = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> WordTable:
    return WordTable(lambda words: np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)))


def weighted_shingles(texts: list[str | None], table: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of every distinct shingle, by text and hash."""
    split = [(t or "").lower().split() for t in texts]
    size = np.array([len(s) for s in split], np.int64)
    h = table.look_up([w for s in split for w in s])
    ends = np.cumsum(size)
    count = np.where(size > 0, np.maximum(size - SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends - size, count)
    end = np.repeat(ends, count)
    shingle = np.full(len(start), 0x1234567, np.uint64)
    for j in range(SHINGLE):
        at = start + j
        word = np.where(at < end, h[np.minimum(at, len(h) - 1)], np.uint64(0)) if len(h) else h
        shingle = mix(shingle ^ word) + np.uint64(j)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(text)))
    return text[first], shingle[first], weight.astype(float)


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, count: int, k: int = K) -> np.ndarray:
    """``count`` x ``k``: rank of the earliest dart per coordinate, infinite for sets without weight.

    A region of weight w is cut into cells [0, 1), [1, 2), [2, 4), [4, 8) … Each cell has a stream of darts whose
    gaps in rank are exponential with the cell's width as rate; darts above w miss the region. Streams are
    followed up to the rank by which a set of this weight expects k ln k + 2 k darts, and further, twice as far each
    time, for sets with an empty coordinate.
    """
    out = np.full((count, k), np.inf)
    total = np.bincount(owner, weight, count)
    reach = np.zeros(count)
    filled = total > 0
    reach[filled] = (k * np.log(k) + 2 * k) / total[filled]
    cells = np.maximum(np.ceil(np.log2(np.maximum(weight, 1e-300))), 0).astype(np.int64) + 1
    cells = np.where(weight > 0, cells, 0)
    which = np.repeat(np.arange(len(owner)), cells)
    cell = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, np.exp2(cell - 1.0), 0.0)
    width = np.where(cell > 0, low, 1.0)
    seed = mix(element[which] + cell.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    own, limit_weight = owner[which], weight[which]
    todo, gold = filled.copy(), np.uint64(0x9E3779B97F4A7C15)
    while todo.any():
        live = np.flatnonzero(todo[own])
        rank, step = np.zeros(len(live)), np.zeros(1, np.uint64)
        while len(live):
            # Wraps around, as all arithmetic on hashes does.
            step = step + gold
            draw = mix(seed[live] + step)
            rank = rank - np.log1p(-((draw >> np.uint64(11)) * 2.0**-53)) / width[live]
            within = rank <= reach[own[live]]
            live, rank, draw = live[within], rank[within], mix(draw[within] ^ np.uint64(0xA0761D6478BD642F))
            place = low[live] + (draw >> np.uint64(40)) * 2.0**-24 * width[live]
            hit = np.flatnonzero(place < limit_weight[live])
            coordinate = ((draw[hit] & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(out.reshape(-1), own[live[hit]] * k + coordinate, rank[hit])
        todo &= np.isinf(out).any(axis=1)
        reach[todo] *= 2
    return out


def numbers(texts: list[str | None], table: WordTable) -> list[np.ndarray]:
    """The shingles of each text as a sorted set of 32-bit numbers; a shingle of weight w has w numbers, the same in all texts."""
    owner, element, weight = weighted_shingles(texts, table)
    times = weight.astype(np.int64)
    which = np.repeat(np.arange(len(owner)), times)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    number = mix(element[which] + copy.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
    key = np.unique(owner[which].astype(np.uint64) << np.uint64(32) | number)
    cut = np.searchsorted(key >> np.uint64(32), np.arange(len(texts) + 1))
    number = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
    return [number[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def similar(shared: np.ndarray | int, total: np.ndarray | int) -> np.ndarray | bool:
    """Whether ``shared`` of ``total`` shingles, both sides counted, make a weighted Jaccard similarity of at least SIMILARITY."""
    # shared / (total - shared) >= 4 / 5, in whole numbers.
    return 9 * shared >= 4 * total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets, each as sorted hashes and weights."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (total - shared))


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, h, sig, size``: a hash of the text, two bytes of each coordinate, number of shingles; null for texts without a word."""

    def work():
        table = word_hashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column("text").to_pylist()
            owner, element, weight = weighted_shingles(texts, table)
            ranks = dart_signatures(owner, element, weight, len(texts))
            short = (mix(ranks.view(np.uint64)) >> np.uint64(48)).astype("<u2")
            size = np.bincount(owner, weight, len(texts)).astype(np.int64)
            full = size > 0
            h = part.column("h").to_pylist()
            return pa.record_batch([
                part.column("doc_id"),
                pa.array([x if ok else None for x, ok in zip(h, full, strict=True)], pa.int64()),
                pa.array([s.tobytes() if ok else None for s, ok in zip(short, full, strict=True)], pa.binary()),
                pa.array(size),
            ], ["doc_id", "h", "sig", "size"])

        return step

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return map_slices(rows, "text", work, "doc_id bigint, h bigint, sig binary, size bigint")


def _hubs(rows: DataFrame) -> DataFrame:
    """Pairs of every member of a bucket and the bucket's hub. A partial minimum runs before the shuffle."""
    hub = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("h").alias("o"), F.col("h"))).alias("hub"), F.count(F.lit(1)).alias("n"))
    hub = hub.filter(F.col("n") > 1).select("bucket", F.col("hub.h").alias("hub"))
    return rows.join(hub, "bucket")


def _shingles(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``h, shingles`` of the texts that share a bucket. Copies fall together before the shuffle."""
    wanted = members.select("h").distinct()
    if wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64("text").alias("h"), "text").filter(F.col("text").isNotNull()).join(wanted, "h", "left_semi")

    def work():
        table = word_hashes()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            made = numbers(part.column("text").to_pylist(), table)
            return pa.record_batch([part.column("h"), pa.array([m.tobytes() for m in made], pa.binary())], ["h", "shingles"])

        return step

    return map_slices(texts.groupBy("h").agg(F.first("text").alias("text")), "text", work, "h bigint, shingles binary")


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """``a, b`` of the pairs with a weighted Jaccard similarity of at least SIMILARITY.

    A hub's shingles travel once for every ``PAIRS_PER_HUB`` of its members, which follow it in the sorted partition.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_HUB).cast("int").alias("salts"))
    hubs = (
        salts.join(shingles.select(F.col("h").alias("b"), "shingles"), "b")
        .select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("a"), "shingles")
    )
    members = (
        pairs.select("a", "b").join(salts, "b")
        .select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
        .join(shingles.select(F.col("h").alias("a"), "shingles"), "a").select("b", "salt", "a", "shingles")
    )
    rows = hubs.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "shingles"))
            for a, b, raw in zip(*columns, strict=True):
                shingles = np.frombuffer(raw, "<u4")
                if a is None:
                    hub, own = b, shingles
                elif hub == b and similar(_shared(shingles, own), len(shingles) + len(own)):
                    found.append((a, b))
            columns = zip(*found, strict=True) if found else ([], [])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted lists share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _with_root(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``root`` for ``h``: a text without links is its own root. Both sides have a text once, or a text in its buckets."""
    if roots is None:
        return rows.withColumn("root", F.col("h"))
    found = roots.select(F.col("node").alias("h"), F.col("root").alias("_root"))
    return rows.join(found, "h", "left").withColumn("root", F.coalesce("_root", "h")).drop("_root")


def classes(docs: DataFrame, sketches: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The sketch of every row, and ``node, root`` for every text that is linked to another (None: there is none)."""
    rows = materialise(sketch(docs), "dart-sketches") if sketches is None else sketches
    nodes = rows.filter(F.col("h").isNotNull()).groupBy("h").agg(F.first("sig").alias("sig"), F.first("size").alias("size"))
    # Both uses of the buckets read these.
    nodes = materialise(nodes, "dart-nodes")
    bands = nodes.select("h", "size", F.explode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(sig, b * {2 * ROWS} + 1, {2 * ROWS})))"
    )).alias("bucket"))
    members = materialise(_hubs(bands), "dart-buckets")
    if members.isEmpty():
        return rows, None
    shingles = materialise(_shingles(docs, members), "dart-shingles")
    pairs = members.filter("h != hub").select(F.col("h").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialise(verified(pairs, shingles), "dart-links")
    roots = None if links.isEmpty() else components(links)
    fresh = materialise(_across(members, roots, shingles), "dart-links")
    if not fresh.isEmpty():
        # The components so far are a forest; only its edges meet the new links.
        forest = fresh if roots is None else fresh.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(forest)
    return rows, roots


def _across(members: DataFrame, roots: DataFrame | None, shingles: DataFrame) -> DataFrame:
    """Links between the components that meet in a bucket, a spanning forest of them for each unit of blocks.

    The members outside the bucket's largest component are cut into blocks 0 to n - 1 by a hash, those of the largest
    one into blocks from n on. A unit is a block of the former with one of either.
    """
    known = materialise(_with_root(members.select("bucket", "h", "size"), roots), "dart-known")
    parts = known.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed = parts.groupBy("bucket").agg(
        F.max(F.struct("n", "size", "root")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")
    ).filter(F.col("n") > F.col("top.n"))

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(4 * size / BLOCK_BYTES)).cast("int")

    mixed = mixed.select(
        "bucket", F.col("top.root").alias("top"), blocks(F.col("top.n"), F.col("top.size")).alias("n_top"),
        blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("n_rest"),
    )
    placed = known.select("bucket", "h", "root").join(mixed, "bucket")
    drawn = F.xxhash64("h", "bucket")
    in_top = F.col("root") == F.col("top")
    own = F.when(in_top, F.col("n_rest") + F.pmod(drawn, F.col("n_top"))).otherwise(F.pmod(drawn, F.col("n_rest"))).cast("int")
    others = F.sequence(F.lit(0), F.when(in_top, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_top")) - 1)
    dealt = placed.select("bucket", "h", "root", own.alias("own"), F.explode(others).alias("other"))
    units = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "root", "h")
    units = units.join(shingles, "h").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "own", "root", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            unit = pa.Table.from_batches(parts)
            own, root, h = (unit.column(c).to_numpy() for c in ("own", "root", "h"))
            sets = [np.frombuffer(raw, "<u4") for raw in unit.column("shingles").to_pylist()]
            left = own == unit.column("lo")[0].as_py()
            i, j = unit_links(sets, root, left, left if left.all() else ~left)
            return pa.record_batch([pa.array(h[i]), pa.array(h[j])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if held and key != tuple(keys[start]):
                    yield found(held)
                    held = []
                key = tuple(keys[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield found(held)

    return units.mapInArrow(run, "a bigint, b bigint").distinct()


def unit_links(sets: list[np.ndarray], root: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs of a left and a right member of different roots: a spanning forest of the roots."""
    none = np.zeros(0, np.int64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), size)
    if not len(row) or not left.any() or not right.any():
        return none, none
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    counts = np.zeros((len(i), len(j)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        there = np.zeros((len(sets), COLUMNS), np.float32)
        there[row[a:b], column[a:b] - first] = 1
        counts += there[i] @ there[j].T
    near = similar(counts.astype(np.float64), size[i][:, None] + size[j][None, :]) & (root[i][:, None] != root[j][None, :])
    a, b = np.nonzero(near)
    a, b = i[a], j[b]
    return _forest(a, b, root)


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same roots as all of them, without a circle."""
    lowest, highest = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
    order = np.lexsort((highest, lowest))
    once = np.ones(len(order), bool)
    once[1:] = (lowest[order[1:]] != lowest[order[:-1]]) | (highest[order[1:]] != highest[order[:-1]])
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := above.get(r, r)) != r:
            above[r] = above.get(up, up)
            r = up
        return r

    kept = []
    for k in order[once].tolist():
        x, y = top(int(root[a[k]])), top(int(root[b[k]]))
        if x != y:
            above[max(x, y)] = min(x, y)
            kept.append(k)
    return a[kept], b[kept]


def _spread_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join with a table that has every key once and says how many rows of ``left`` have it.

    Keys of more than one in ``HOT_KEYS`` rows are at most ``HOT_KEYS``; they are broadcast, so no task gets all rows of one.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total // HOT_KEYS
    few, many = F.broadcast(right.filter(hot).drop(count)), right.filter(~hot).drop(count)
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(many, key))


def class_of_texts(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``h, class_id, class_size, n`` of every text: the smallest ``doc_id`` and the rows of its class, and its own rows."""
    texts = rows.filter(F.col("h").isNotNull()).groupBy("h").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    placed = materialise(_with_root(texts, roots), "dart-classes")
    sizes = placed.groupBy("root").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts")
    )
    return _spread_join(placed.select("h", "root", "n"), sizes, "root", "texts").drop("root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size`` of every row; the class is named by its smallest ``doc_id``."""
    rows, roots = classes(docs)
    texts = materialise(class_of_texts(rows, roots), "dart-classes")
    named = _spread_join(rows.filter(F.col("h").isNotNull()).select("doc_id", "h"), texts, "h", "n")
    alone = rows.filter(F.col("h").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return named.select("doc_id", "class_id", F.col("class_size").cast("bigint").alias("class_size")).unionByName(alone)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of every class: that of the smallest ``doc_id``. Rows without words all stay."""
    rows, roots = classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    texts = rows.filter(F.col("h").isNotNull()).groupBy("h").agg(first.alias("least"))
    keeper = _with_root(texts, roots).groupBy("root").agg(F.min(F.struct("least", "h")).alias("keep"))
    keeper = keeper.select(F.col("keep.h").alias("_h"), F.col("keep.least.doc_id").alias("_id"))
    # How often the row that stays is in the table.
    same = rows.filter(F.col("h").isNotNull()).groupBy(F.col("h").alias("_h"), F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_times"))
    named = (F.col("k._h") == F.col("s._h")) & F.col("k._id").eqNullSafe(F.col("s._id"))
    keeper = materialise(keeper.alias("k").join(same.alias("s"), named).select("k._h", "k._id", "s._times"), "dart-keepers")
    wordless = F.coalesce(F.translate("text", SPACES, ""), F.lit("")) == ""
    marked = docs.withColumn("_h_", F.xxhash64("text"))
    mine = (F.col("_h") == F.col("_h_")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    kept = marked.join(keeper.filter("_times = 1"), mine)
    repeated = keeper.filter("_times > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(marked.join(repeated, mine).dropDuplicates(["_h_", "doc_id"]))
    return kept.select(*docs.columns).unionByName(docs.filter(wordless))
