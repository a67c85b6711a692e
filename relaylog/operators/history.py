"""Uniqueness against everything seen before: a batch of messages meets a log of any length.

Beside the log of uids, in folders by day, lie Bloom filters: for each day (and batch that added to it) one for each of
``shards`` parts of the uids. The uids of a batch are dealt to the same parts and looked up in all filters of their part,
which a task holds while the uids stream by. A filter never misses a uid, so a uid without a hit is new; the days of the
hits, and no others, are read to tell hits from false ones.

A filter has ``bits`` bits. With up to a tenth as many uids of a part and day it errs for one uid in a hundred; with more
it only sends more uids to the exact check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylog.operators.monitor import dedupe
from relaylog.session import materialise

SHARDS = 64
BITS = 1 << 20
HASHES = 5
_FILTERS = "day date, shard int, bits binary"
_UIDS = "uid bigint, day date"


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter, one row each."""
    first, step = h.astype(np.uint64) >> np.uint64(32), h.astype(np.uint64) & np.uint64(0xFFFFFFFF) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class UidHistory:
    """The uids seen so far, under ``root``. Batches are named by a number; one that is added again replaces itself."""

    def __init__(self, spark: SparkSession, root: str, shards: int = SHARDS, bits: int = BITS):
        self.spark, self.root, self.shards, self.bits = spark, root, shards, bits
        self.batches: list[int] = []

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return rows.select(
            "uid", F.to_date("ts").alias("day"), F.pmod(F.xxhash64("uid"), F.lit(self.shards)).cast("int").alias("shard"),
            F.xxhash64("uid", F.lit(1)).alias("h"),
        )

    def add(self, rows: DataFrame, batch: int) -> None:
        """Remember the uids of ``rows`` (``uid, ts``)."""
        bits = self.bits
        keyed = self._keyed(rows)
        keyed.select("uid", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/uids/batch={batch}")
        dealt = keyed.select("day", "shard", "h").repartition("day", "shard").sortWithinPartitions("day", "shard")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, np.zeros(0, np.uint8)

            def done() -> pa.RecordBatch:
                packed = np.packbits(held).tobytes()
                return pa.record_batch([pa.array([key[0]], pa.date32()), pa.array([key[1]], pa.int32()), pa.array([packed], pa.binary())], ["day", "shard", "bits"])

            for part in batches:
                if not part.num_rows:
                    continue
                days = part.column("day").cast(pa.int32()).fill_null(-(1 << 31)).to_numpy()
                shard, h = part.column("shard").to_numpy(), part.column("h").to_numpy()
                cuts = [0, *(np.flatnonzero((days[1:] != days[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), part.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own = (part.column("day")[a].as_py(), int(shard[a]))
                    if own != key:
                        if key is not None:
                            yield done()
                        key, held = own, np.zeros(bits, np.uint8)
                    held[_places(h[a:b], bits).ravel()] = 1
            if key is not None:
                yield done()

        dealt.mapInArrow(build, _FILTERS).write.mode("overwrite").parquet(f"{self.root}/filters/batch={batch}")
        if batch not in self.batches:
            self.batches.append(batch)

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{name}/batch={b}" for b in self.batches]
        parts = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def hits(self, rows: DataFrame) -> DataFrame:
        """``uid, day`` of every day whose filter has the uid; most are true."""
        bits = self.bits
        asked = self._keyed(rows).select("shard", F.lit(1).alias("kind"), "uid", "h", F.lit(None).cast("date").alias("day"), F.lit(None).cast("binary").alias("bits"))
        known = self._read("filters", _FILTERS).select(
            "shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("bigint").alias("h"), "day", "bits"
        )
        dealt = asked.unionByName(known).repartition("shard").sortWithinPartitions("shard", "kind")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, filters = None, []
            for part in batches:
                of, kind = part.column("shard").to_numpy(), part.column("kind").to_numpy()
                cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), part.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if of[a] != shard:
                        shard, filters = of[a], []
                    rows = part.slice(a, b - a)
                    if kind[a] == 0:
                        raw = zip(rows.column("day").to_pylist(), rows.column("bits").to_pylist(), strict=True)
                        filters += [(day, np.frombuffer(packed, np.uint8)) for day, packed in raw]
                        continue
                    places = _places(rows.column("h").to_numpy(), bits)
                    for day, packed in filters:
                        found = np.flatnonzero((packed[places >> 3] >> (7 - (places & 7)) & 1).all(axis=1))
                        if len(found):
                            yield pa.record_batch([rows.column("uid").take(pa.array(found)), pa.array([day] * len(found), pa.date32())], ["uid", "day"])

        return dealt.mapInArrow(look, _UIDS)

    def seen(self, rows: DataFrame) -> DataFrame:
        """The uids of ``rows`` that were seen before, each once. Only days with hits are read."""
        if not self.batches:
            return rows.select("uid").limit(0)
        hits = materialise(self.hits(rows.select("uid", "ts")), "uid-hits")
        days = [r.day for r in hits.select("day").distinct().collect()]
        log = self._read("uids", _UIDS).filter(F.col("day").isin(*[d for d in days if d is not None]) | (F.col("day").isNull() & F.lit(None in days)))
        log = log.select(F.col("uid").alias("_uid"), F.col("day").alias("_day"))
        same = F.col("uid").eqNullSafe(F.col("_uid")) & F.col("day").eqNullSafe(F.col("_day"))
        return hits.join(log, same, "left_semi").select("uid").distinct()

    def first_seen(self, messages: DataFrame) -> DataFrame:
        """The first row of each uid of a batch that no batch before had."""
        first = dedupe(messages)
        seen = self.seen(first).withColumnRenamed("uid", "_seen")
        return first.join(seen, F.col("uid").eqNullSafe(F.col("_seen")), "left_anti")


def dedupe_batches(spark: SparkSession, batches: list[DataFrame], root: str, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``dedupe`` of a log that comes in batches, in order of time: each against the history of those before it."""
    history, fresh = UidHistory(spark, root, shards, bits), []
    for number, batch in enumerate(batches):
        new = materialise(history.first_seen(batch), "uid-first")
        history.add(new, number)
        fresh.append(new)
    out = fresh[0]
    for part in fresh[1:]:
        out = out.unionByName(part)
    return out
