"""Wildcard routes: path patterns to channels, one winner per message.

``*`` accepts the rest of the path, ``?`` one segment; a route also matches when either side is
a prefix of the other. The first segment has to be equal.

Routes form a trie whose nodes are rows. A pattern is read up to its ``*``; a segment that ends in ``?`` becomes its
own text and a mark, and the places of such segments are the pattern's mask. A path brought into the form of a mask
meets patterns of that mask by equality of texts alone:

* the pattern is a prefix of the path: the path's prefix of that length is a node where a pattern ends,
* the path is a prefix of the pattern: the whole path is a node above the end of a pattern.

Each node keeps the best pattern that ends there and the best below it, both by a maximum that is added up before the
shuffle. So a message looks up one key for each mask and length of pattern that occurs, however many routes there
are under one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nodes up to about this size are broadcast, and up to so many look-ups of a message are joined one after another.
MAX_BROADCAST_BYTES = 32 << 20
MAX_LOOKUPS = 24
_MARK = "\x01"
_SPECIAL = r"([\\^$.|?*+()\[\]{}])"


def first_segment(path: Column | str) -> Column:
    return F.regexp_extract(path, "^/?([^/]*)", 1)


def valid_pattern(pattern: Column | str) -> Column:
    """``?`` has to fill its segment: the next character is ``/``, ``*`` or the end."""
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    return ~F.substring_index(pattern, "*", 1).rlike(r"\?[^/]")


def pattern_regex(pattern: Column | str) -> Column:
    """Regular expression of a pattern: nested optional tails, so that a path may end anywhere."""
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    chars = F.filter(F.split(F.substring_index(pattern, "*", 1), ""), lambda c: c != "")

    def nest(tail: Column, char: Column) -> Column:
        token = F.when(char == "?", F.lit("[^/]*")).otherwise(F.regexp_replace(char, _SPECIAL, r"\\$1"))
        return F.concat(F.lit("(?:$|"), token, tail, F.lit(")"))

    return F.concat(F.lit("^"), F.aggregate(F.reverse(chars), F.lit(".*"), nest))


def compile_routes(routes: DataFrame) -> DataFrame:
    """``channel, pattern`` with ``seg`` (first segment), ``mask`` (places of ``?``, each with the length of the text
    before it in its segment), ``text`` (the pattern before ``*``, ``?`` as a mark) and ``spec`` (literal prefix length).

    Patterns that are not supported take no part; ``rejected_routes`` lists them.
    """
    lit = F.substring_index("pattern", "*", 1)
    place = F.transform(F.split(lit, "/"), lambda s, i: F.when(F.endswith(s, F.lit("?")), F.concat_ws(":", i, F.length(s) - 1)))
    return routes.filter(valid_pattern("pattern")).withColumns({
        "seg": first_segment("pattern"),
        "mask": F.array_join(F.array_compact(place), ","),
        "text": F.translate(lit, "?", _MARK),
        "spec": F.length(F.regexp_extract("pattern", r"^([^?*]*)", 1)),
    })


def masked(path: Column, mask: str) -> Column:
    """The path in the form of a mask: its segments at the places of ``?`` end in the mark."""
    if not mask:
        return path
    places = [tuple(map(int, part.split(":"))) for part in mask.split(",")]

    def segment(s: Column, i: Column) -> Column:
        out = s
        for at, length in places:
            fits = (i == at) & (F.length(s) >= length)
            out = F.when(fits, F.concat(F.substring(s, 1, length), F.lit(_MARK))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(path, "/"), segment), "/")


def trie(compiled: DataFrame) -> DataFrame:
    """``mask, seg, key, here, below``: for each prefix of a pattern from its first segment on, the best that ends there and below."""
    best = F.struct("spec", "channel")
    first = F.length(F.regexp_extract("text", "^/?[^/]*", 0))
    ends = F.when(F.length("text") > 0, F.sequence(F.least(first, F.length("text")), F.length("text"))).otherwise(F.array(F.lit(0)))
    rows = compiled.select("mask", "seg", "text", best.alias("best"), F.explode(ends).alias("n"))
    whole = F.col("n") == F.length("text")
    return rows.groupBy("mask", "seg", F.substring(F.col("text"), F.lit(1), F.col("n")).alias("key")).agg(
        F.max(F.when(whole, F.col("best"))).alias("here"), F.max(F.when(~whole, F.col("best"))).alias("below")
    )


def rejected_routes(routes: DataFrame) -> DataFrame:
    """Routes that can match nothing, with the reason."""
    bad = ~F.coalesce(valid_pattern("pattern"), F.lit(False))
    return routes.filter(bad).withColumn("reason", F.lit("invalid_pattern"))


def route_match(messages: DataFrame, routes: DataFrame, path: str = "path") -> DataFrame:
    """Add ``route``: the channel of the most specific matching route, null when none matches.

    One small pass over the routes finds which masks and lengths occur, and the size of the trie. A small trie is
    broadcast once and looked up in turn, without a shuffle of messages. Otherwise the distinct paths are looked up,
    all keys of a path as rows, and messages take the route of their path.
    """
    compiled = compile_routes(routes)
    length = F.length("text")
    shapes = compiled.groupBy("mask", length.alias("n")).agg(F.sum(length * (length + 1) / 2 + 64 * (length + 1)).alias("bytes")).collect()
    nodes = trie(compiled)
    lengths: dict[str, list[int]] = {}
    for row in sorted(shapes, key=lambda r: (r.mask, r.n)):
        lengths.setdefault(row.mask, []).append(row.n)
    lookups = sum(len(n) + 1 for n in lengths.values())
    small = sum(row.bytes for row in shapes) <= MAX_BROADCAST_BYTES
    if messages.isStreaming or small and lookups <= MAX_LOOKUPS:
        return _looked_up_in_turn(messages, F.broadcast(nodes) if small else nodes, lengths, path)
    return _looked_up_by_path(messages, nodes, lengths, path)


def _looked_up_in_turn(messages: DataFrame, nodes: DataFrame, lengths: dict[str, list[int]], path: str) -> DataFrame:
    out = messages.withColumn("_seg", first_segment(path))
    found: list[Column] = []
    for number, (mask, sizes) in enumerate(lengths.items()):
        out = out.withColumn("_path", masked(F.col(path), mask))
        for size in [None, *sizes]:
            name = f"_best{len(found)}"
            own = nodes.select(
                F.col("mask").alias("_m"), F.col("seg").alias("_s"), F.col("key").alias("_k"),
                (F.greatest("here", "below") if size is None else F.col("here")).alias(name),
            )
            key = F.col("_path") if size is None else F.when(F.length("_path") > size, F.substring("_path", 1, size))
            out = out.join(own, (F.col("_m") == F.lit(mask)) & (F.col("_s") == F.col("_seg")) & (F.col("_k") == key), "left")
            out = out.drop("_m", "_s", "_k")
            found.append(F.col(name))
    if not found:
        return out.withColumn("route", F.lit(None).cast("string")).drop("_seg")
    best = F.greatest(*found) if len(found) > 1 else found[0]
    return out.withColumn("route", best["channel"]).drop("_seg", "_path", *[f"_best{i}" for i in range(len(found))])


def _looked_up_by_path(messages: DataFrame, nodes: DataFrame, lengths: dict[str, list[int]], path: str) -> DataFrame:
    paths = messages.select(F.col(path).alias("_p")).filter(F.col("_p").isNotNull()).distinct()

    def keys_of(mask: str, sizes: list[int]) -> Column:
        form = masked(F.col("_p"), mask)
        whole = F.array(F.struct(F.lit(mask).alias("mask"), form.alias("key"), F.lit(True).alias("whole")))
        shorter = F.filter(F.array(*map(F.lit, sizes)), lambda n: n < F.length(form))
        parts = F.transform(shorter, lambda n: F.struct(
            F.lit(mask).alias("mask"), F.substring(form, F.lit(1), n).alias("key"), F.lit(False).alias("whole")))
        return F.concat(whole, parts)

    if not lengths:
        return messages.withColumn("route", F.lit(None).cast("string"))
    keys = F.flatten(F.array(*[keys_of(mask, sizes) for mask, sizes in lengths.items()]))
    asked = paths.select("_p", first_segment("_p").alias("seg"), F.explode(keys).alias("k")).select("_p", "seg", "k.*")
    best = F.when(F.col("whole"), F.greatest("here", "below")).otherwise(F.col("here"))
    won = asked.join(nodes, ["mask", "seg", "key"]).groupBy("_p").agg(F.max(best).alias("_best"))
    won = won.select("_p", F.col("_best.channel").alias("route"))
    return messages.join(won, F.col(path) == F.col("_p"), "left").drop("_p")


def route_miss(messages: DataFrame, routes: DataFrame, path: str = "path") -> DataFrame:
    """Messages without a route; they are answered with 404."""
    missed = route_match(messages, routes, path).filter(F.col("route").isNull()).drop("route")
    return missed.withColumn("status", F.lit(404))
