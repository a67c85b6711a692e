"""Sharding by a k-d tree over metadata of the texts, with leaves of equal bytes.

A node is split along its widest dimension at the weighted median, weights being bytes, until every leaf has
the target size. Medians are found without sorting: all nodes of a level share one histogram job, which is
narrowed to the bin that holds the median until that bin is light.

Dimensions depend on the text alone, and ties are ordered by a hash of the text, so equal texts always land in
the same leaf, wherever they are. Groups of equal texts that are heavy for a leaf would tip the scales: there can
be only ``shards / heavy`` of them, so they are known by hash, dealt to the lighter side first, and the median
of the light rest makes up the difference.

Defined results: a null text counts as an empty one. Repeated rows are rows of their own. Extra columns are
ignored. With fewer distinct texts than shards some shards stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylog.session import materialise

BINS = 4096
LEVEL_BITS = 20
HASH_BITS = 40
HEAVY = 0.02
TOLERANCE = 0.0005
ROWS_PER_CHUNK = 20_000
DIMENSIONS = ("log_size", "bytes_per_char", "gap_share", "log_lines")


@dataclass(frozen=True)
class Split:
    node: int
    dimension: int
    threshold: int  # the last key that goes left
    left: int
    right: int


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, h`` and the dimensions of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text)
    chars = F.greatest(F.char_length(text), F.lit(1))
    gaps = F.char_length(text) - F.char_length(F.translate(text, " ", ""))
    lines = F.char_length(text) - F.char_length(F.translate(text, "\n", ""))
    return docs.select(
        "doc_id",
        (size + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.log2(size + F.lit(1.0)).alias("log_size"),
        (size / chars).alias("bytes_per_char"),
        (gaps / chars).alias("gap_share"),
        F.log2(lines + F.lit(1.0)).alias("log_lines"),
    )


def _keyed(rows: DataFrame, low: list[float], wide: list[float]) -> DataFrame:
    """One sortable number per dimension: the value in 2^20 steps, then a hash of the text."""
    tie = F.shiftrightunsigned(F.xxhash64("h"), 64 - HASH_BITS)

    def key(j: int) -> Column:
        step = F.floor((F.col(DIMENSIONS[j]) - F.lit(low[j])) / F.lit(wide[j]) * F.lit(float((1 << LEVEL_BITS) - 1)))
        return F.shiftleft(step.cast("bigint"), HASH_BITS).bitwiseOR(tie).alias(f"k{j}")

    return rows.select("doc_id", "size", "text_crc32", "h", *[key(j) for j in range(len(DIMENSIONS))])


def _of_node(values: dict[int, int | None], otherwise: int | None = None) -> Column:
    """The value of each row's node: a literal array, one entry per node."""
    listed = [values.get(n, otherwise) for n in range(max(values, default=0) + 1)]
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in listed]), F.col("node"))


def _pick(dimension: Column) -> Column:
    out = F.col("k0")
    for j in range(1, len(DIMENSIONS)):
        out = F.when(dimension == j, F.col(f"k{j}")).otherwise(out)
    return out


def _medians(rows: DataFrame, aims: dict[int, tuple[int, float]], total: float) -> dict[int, int]:
    """For each node ``(dimension, bytes to go left)``: the last key that goes left.

    A narrowing round is one job with one row per node and bin, whatever the number of rows.
    """
    top = 1 << (LEVEL_BITS + HASH_BITS)
    found = {node: -1 for node, (_, aim) in aims.items() if aim <= 0}
    # node: dimension, lower end and width of the range, bytes still to go left
    open_ = {node: (dim, 0, top, aim) for node, (dim, aim) in aims.items() if aim > 0}
    while open_:
        low = _of_node({n: lo for n, (_, lo, _, _) in open_.items()})
        high = _of_node({n: lo + w for n, (_, lo, w, _) in open_.items()})
        step_of = _of_node({n: max(1, -(-w // BINS)) for n, (_, _, w, _) in open_.items()})
        counted = (
            rows.withColumns({"lo": low, "hi": high, "step": step_of, "key": _pick(_of_node({n: d for n, (d, _, _, _) in open_.items()}))})
            .filter((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
            .groupBy("node", F.expr("(key - lo) div step").alias("bin"))
            .agg(F.sum("size").alias("size"))
            .collect()
        )
        bins: dict[int, list[tuple[int, int]]] = {}
        for r in counted:
            bins.setdefault(r.node, []).append((r.bin, r.size))
        narrowed = {}
        for node, (dim, lo, width, aim) in open_.items():
            step = max(1, -(-width // BINS))
            before = 0
            for b, size in sorted(bins.get(node, [])):
                if before + size < aim:
                    before += size
                    continue
                start = lo + b * step
                if step == 1 or size <= TOLERANCE * total:
                    near = before + size - aim <= aim - before
                    found[node] = start + step - 1 if near else start - 1
                else:
                    narrowed[node] = (dim, start, step, aim - before)
                break
            else:
                found[node] = lo + width - 1
        open_ = narrowed
    return found


def build(rows: DataFrame, shards: int) -> tuple[list[list[Split]], dict[int, int], dict[int, int]]:
    """Splits by level, the shard of every leaf, and the shard of every heavy group."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy_rows = rows.groupBy("h").agg(F.sum("size").alias("size")).filter(F.col("size") > HEAVY * total / shards).collect()
    heavy = {r.h: [r.size, 0] for r in heavy_rows}  # size, node
    spans = {0: (0, shards)}  # node: first shard, number of shards
    serial = 1
    # Heavy groups stand outside the tree, at no node.
    current = rows.withColumn("node", F.when(F.col("h").isin(list(heavy)), -1).otherwise(0))
    while any(n > 1 for _, n in spans.values()):
        keys = [f"k{j}" for j in range(len(DIMENSIONS))]
        ends = [f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]
        facts = {r.node: r for r in current.filter(F.col("node") >= 0).groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()}
        aims, next_spans, children = {}, {}, {}
        for node, (first, count) in spans.items():
            if count == 1:
                next_spans[node] = (first, count)
                continue
            left_count = count // 2
            left, right = serial, serial + 1
            serial += 2
            next_spans[left], next_spans[right] = (first, left_count), (first + left_count, count - left_count)
            mine = sorted(((s, h) for h, (s, n) in heavy.items() if n == node), reverse=True)
            light = facts[node].size if node in facts else 0
            goal = (light + sum(s for s, _ in mine)) * left_count / count
            rest = light + sum(s for s, _ in mine) - goal
            taken = [0, 0]
            for size, h in mine:
                side = 0 if (goal - taken[0]) / max(goal, 1) >= (rest - taken[1]) / max(rest, 1) else 1
                taken[side] += size
                heavy[h][1] = (left, right)[side]
            if node in facts:
                wide = [facts[node][f"max_k{j}"] - facts[node][f"min_k{j}"] for j in range(len(DIMENSIONS))]
                aims[node] = (wide.index(max(wide)), min(max(goal - taken[0], 0), light))
                children[node] = (left, right)
        found = _medians(current, aims, max(total / shards, 1)) if aims else {}
        level = [Split(n, aims[n][0], found[n], *children[n]) for n in found]
        # Written once a level: the expression of a node would hold that of its parent several times over.
        current = materialise(descend(current, level), "shard-nodes")
        spans = next_spans
    final = {node: first for node, (first, _) in spans.items()}
    placed = {h: final[n] for h, (_, n) in heavy.items()}
    return current, final, placed


def descend(rows: DataFrame, level: list[Split]) -> DataFrame:
    """Move every row to the child of its node. There is one literal per node, so at most two per shard."""
    if not level:
        return rows
    dim, threshold = _of_node({s.node: s.dimension for s in level}), _of_node({s.node: s.threshold for s in level})
    lower, upper = _of_node({s.node: s.left for s in level}), _of_node({s.node: s.right for s in level})
    child = F.when(dim.isNull(), F.col("node")).when(_pick(dim) <= threshold, lower).otherwise(upper)
    return rows.withColumn("node", child.cast("int"))


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Give the number of shards, or the bytes a shard should have. ``slot`` counts from 0 in each shard by
    ``doc_id``. The law is ``bytes``, so ``grown_shard`` is null.
    """
    rows = measured(docs)
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    rows = materialise(rows, "shard-measures")
    facts = rows.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n"), *ends).first()
    if shards is None:
        shards = max(1, round((facts.total or 0) / (target_bytes or 128 << 20)))
    low = [float(facts[f"min_{d}"] or 0) for d in DIMENSIONS]
    wide = [max(float(facts[f"max_{d}"] or 0) - lo, 1e-9) for d, lo in zip(DIMENSIONS, low, strict=True)]
    keyed = _keyed(rows, low, wide)
    out, final, placed = build(materialise(keyed, "shard-keys"), shards)
    leaf = F.coalesce(_of_node(final), F.lit(0)).cast("int")
    if placed:
        # At most shards / HEAVY groups, whatever the input.
        own = docs.sparkSession.createDataFrame(list(placed.items()), "h bigint, own int")
        out = out.join(F.broadcast(own), "h", "left").withColumn("shard", F.coalesce("own", leaf))
    else:
        out = out.withColumn("shard", leaf)
    # Slots: rows are numbered in chunks of bounded size, and each chunk starts where the one before ends.
    chunks = max(1, facts.n // ROWS_PER_CHUNK)
    out = out.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(chunks)).cast("int"))
    sizes = out.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "h")) - 1
    return (
        out.withColumn("place", place).join(starts, ["shard", "chunk"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("place")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
