"""The state of all queues as tables in generations, so that a replay resumes where another stopped.

State is what of the log still matters: each message that is not done (put, not both taken and answered), with its id, time,
content and what has happened to it, and four counters for each channel. A generation holds new versions of the messages and
channels that one batch of operations changed, nothing else. The newest version of a ``(channel, seq)`` counts. After
``MAX_DELTAS`` generations the versions that count, without messages that are done, become a base, and older generations are
not read any more. A manifest, written last, names the base and the generations after it; without its manifest a generation
does not exist, so a batch that failed half way is simply done again.

A batch of operations is resumed without reading a backlog whole. GETs can only take the messages at the front, as many as
there are GETs, and POSTs name theirs. Those messages come back as the rows of the log they came from, marked
``restored``, so they are in order by themselves and spread over slices like other rows. Messages further back only shift the
counters of their channel by a constant.

Uids have to be unique: a uid that returns after its message was done starts a new message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylog.operators.queue import queue_replay, trace_of
from relaylog.operators.slices import ROWS_PER_SLICE, add_slice, plan_slices

MAX_DELTAS = 8
COUNTERS = ("puts", "pops", "cleared", "answered")
# What a version of a message tells besides its channel and the columns the caller wants kept.
_FIXED = "seq bigint, uid bigint, put_id bigint, put_ts timestamp_ntz, get_id bigint, get_ts timestamp_ntz, post_id bigint, post_ts timestamp_ntz, done boolean, gen bigint"
_MANIFEST = "gen bigint, base bigint, horizon string"


def overwritten(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Generations:
    """State under ``root`` as of generation ``gen`` (-1: none yet). ``keep`` are columns of a PUT that stay with its message."""

    def __init__(self, spark: SparkSession, root: str, gen: int, like: DataFrame, keep: tuple[str, ...] = ("k",)):
        self.spark, self.root, self.gen, self.keep = spark, root, gen, keep
        channel = T.StructField("channel", like.schema["channel"].dataType)
        fixed = T._parse_datatype_string(_FIXED).fields
        self.message_schema = T.StructType([channel, *[like.schema[c] for c in keep], *fixed])
        self.channel_schema = T.StructType([channel, *[T.StructField(c, T.LongType()) for c in (*COUNTERS, "gen")]])
        self.base, self.horizon = -1, None
        if gen >= 0:
            row = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/gen={gen}").first()
            self.base, self.horizon = row.base, row.horizon

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        paths = [f"{self.root}/base-{name}/gen={self.base}"] if self.base >= 0 else []
        paths += [f"{self.root}/{name}/gen={g}" for g in range(self.base + 1, self.gen + 1)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def versions(self) -> DataFrame:
        """All versions of messages from the base on."""
        return self._table("messages", self.message_schema)

    def channels(self) -> DataFrame:
        """The newest counters of every channel."""
        return _newest(self._table("channels", self.channel_schema), ["channel"])

    def messages(self) -> DataFrame:
        """All messages that are not done."""
        return _newest(self.versions(), ["channel", "seq"]).filter(~F.col("done"))

    def resume(self, due: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows to replay for the operations ``due``, and for each of their channels what is added to the counters.

        The rows are ``due`` and those of the messages they may touch, with ``restored`` and, for restored PUTs, ``seq0``.
        """
        log = due.withColumns({"restored": F.lit(False), "seq0": F.lit(None).cast("bigint")})
        if self.gen < 0:
            nothing = [F.lit(0).cast("bigint").alias(c) for c in (*COUNTERS, "n", "more_waiting", "more_pending", "more_held")]
            return log, due.select("channel").distinct().select("channel", *nothing)
        asked = due.groupBy("channel").agg(F.sum(F.when(F.col("method") == "GET", 1).otherwise(0)).alias("gets"))
        counters = asked.join(self.channels().withColumnRenamed("channel", "_channel"), F.col("channel").eqNullSafe(F.col("_channel")), "left")
        counters = counters.drop("_channel", "gen").fillna(0, list(COUNTERS))
        front = counters.select(F.col("channel").alias("_c"), F.col("pops").alias("_lo"), (F.col("pops") + F.col("gets") + 1).alias("_hi"))
        named = due.filter(F.col("method") == "POST").select(
            F.col("channel").alias("_nc"), F.regexp_extract("fwd", r"^\s*([+-]?\d+)", 1).try_cast("bigint").alias("_nu")
        ).filter(F.col("_nu").isNotNull()).distinct()
        versions = self.versions()
        touched = versions.join(front, versions["channel"].eqNullSafe(F.col("_c"))).drop("_c")
        touched = touched.join(named, touched["channel"].eqNullSafe(F.col("_nc")) & (touched["uid"] == F.col("_nu")), "left")
        at_front = (F.col("seq") > F.col("_lo")) & (F.col("seq") <= F.col("_hi"))
        touched = touched.filter(at_front | F.col("_nu").isNotNull()).select(*self.message_schema.names)
        held = _newest(touched, ["channel", "seq"]).filter(~F.col("done"))

        def row(method: str, number: str, ts: str, fwd: Column, there: Column) -> Column:
            put = method == "PUT"
            return F.when(there, F.struct(
                F.lit(method).alias("method"), F.col(number).alias("event_id"), F.col(ts).alias("ts"),
                (F.col("uid") if put else F.lit(None).cast("bigint")).alias("uid"), fwd.alias("fwd"),
                (F.col("seq") if put else F.lit(None).cast("bigint")).alias("seq0"),
            ))

        nothing = F.lit(None).cast("string")
        rows = F.array_compact(F.array(
            row("PUT", "put_id", "put_ts", nothing, F.lit(True)),
            row("GET", "get_id", "get_ts", nothing, F.col("get_id").isNotNull()),
            row("POST", "post_id", "post_ts", F.col("uid").cast("string"), F.col("post_id").isNotNull()),
        ))
        restored = held.select("channel", *self.keep, F.explode(rows).alias("_r")).select("channel", *self.keep, "_r.*")
        restored = restored.withColumn("restored", F.lit(True))
        log = log.unionByName(restored, allowMissingColumns=True).select(*log.columns)
        there = held.groupBy(F.col("channel").alias("_channel")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("get_id").isNull(), 1).otherwise(0)).alias("n_waiting"),
            F.sum(F.when(F.col("post_id").isNull(), 1).otherwise(0)).alias("n_open"),
        )
        shift = counters.join(there, F.col("channel").eqNullSafe(F.col("_channel")), "left").drop("_channel").fillna(0, ["n", "n_waiting", "n_open"])
        shift = shift.select(
            "channel", *COUNTERS, "n",
            (F.col("puts") - F.col("pops") - F.col("n_waiting")).alias("more_waiting"),
            (F.col("pops") - F.col("cleared") - (F.col("n") - F.col("n_waiting"))).alias("more_pending"),
            (F.col("puts") - F.col("answered") - F.col("n_open")).alias("more_held"),
        )
        return log, shift

    def commit(self, replay: DataFrame, shift: DataFrame, horizon: str | None, gen: int) -> Generations:
        """Write generation ``gen`` from the replay of resumed rows and their ``shift``, and return the state as of it."""
        fresh = ~F.col("restored")

        def counted(condition: Column) -> Column:
            return F.sum(F.when(fresh & condition, 1).otherwise(0)).cast("bigint")

        method = F.col("method")
        moved = replay.groupBy(F.col("channel").alias("_channel")).agg(
            counted((method == "PUT") & (F.col("status") == 202)).alias("d_puts"), counted(F.col("popped")).alias("d_pops"),
            counted(F.col("cleared")).alias("d_cleared"), counted((method == "POST") & (F.col("status") == 200)).alias("d_answered"),
        )
        channels = shift.join(moved, F.col("channel").eqNullSafe(F.col("_channel"))).select(
            "channel", *[(F.col(c) + F.col(f"d_{c}")).alias(c) for c in COUNTERS], F.lit(gen).cast("bigint").alias("gen")
        ).filter(reduce(Column.__or__, [F.col(f"d_{c}") > 0 for c in COUNTERS]))
        overwritten(channels.select(*self.channel_schema.names), f"{self.root}/channels/gen={gen}")

        put, before = method == "PUT", F.col("restored")
        trace = trace_of(
            replay, F.max(F.when(put, F.col("seq0"))).alias("seq0"), F.max(F.col("popped") & before).alias("was_taken"),
            F.max(F.col("reply_seq").isNotNull() & before).alias("was_answered"),
            *[F.max(F.when(put, F.col(c))).alias(c) for c in self.keep if c != "k"],
        )
        numbered = trace.join(
            shift.select(F.col("channel").alias("_channel"), "puts", "n"), F.col("channel").eqNullSafe(F.col("_channel"))
        ).drop("_channel")
        changed = F.col("seq0").isNull() | (F.col("get_id").isNotNull() & ~F.col("was_taken")) | (F.col("post_id").isNotNull() & ~F.col("was_answered"))
        versions = numbered.filter(changed).withColumns({
            "seq": F.coalesce("seq0", F.col("seq") - F.col("n") + F.col("puts")),
            "done": F.col("get_id").isNotNull() & F.col("post_id").isNotNull(), "gen": F.lit(gen).cast("bigint"),
        }).select(*self.message_schema.names)
        # The rows come dealt by message; a range partitioning would compute them twice.
        versions.sortWithinPartitions("channel", "seq").write.mode("overwrite").parquet(f"{self.root}/messages/gen={gen}")
        return self._published(gen, horizon)

    def carry(self, horizon: str | None, gen: int) -> Generations:
        """A generation in which nothing changed."""
        for name, schema in (("messages", self.message_schema), ("channels", self.channel_schema)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}/gen={gen}")
        return self._published(gen, horizon)

    def _published(self, gen: int, horizon: str | None) -> Generations:
        out = Generations.__new__(Generations)
        out.__dict__ = {**self.__dict__, "gen": gen, "horizon": horizon}
        if gen - out.base > MAX_DELTAS:
            out.messages().repartitionByRange("channel", "seq").write.mode("overwrite").parquet(f"{self.root}/base-messages/gen={gen}")
            out.channels().write.mode("overwrite").parquet(f"{self.root}/base-channels/gen={gen}")
            out.base = gen
        manifest = self.spark.createDataFrame([(gen, out.base, horizon)], _MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/gen={gen}")
        return out


def advance(
    state: Generations, due: DataFrame, horizon: str | None, gen: int, rows_per_slice: int = ROWS_PER_SLICE,
) -> tuple[DataFrame, Generations]:
    """Replay the operations ``due`` on a state, and write generation ``gen``: their rows with ``status, q, pend, msgs``, and the state after."""
    log, shift = state.resume(due)
    work = f"{state.root}/work/gen={gen}"
    shift = overwritten(shift, f"{work}/shift")
    log = overwritten(log, f"{work}/log") if state.gen >= 0 else log
    replay = overwritten(queue_replay(add_slice(log, plan_slices(log, rows_per_slice=rows_per_slice))), f"{work}/replay")
    after = state.commit(replay, shift, horizon, gen)
    more = shift.select(F.col("channel").alias("_channel"), "more_waiting", "more_pending", "more_held")
    rows = replay.filter(~F.col("restored")).join(more, F.col("channel").eqNullSafe(F.col("_channel")))
    rows = rows.withColumns({
        "q": F.col("q") + F.col("more_waiting"), "pend": F.col("pend") + F.col("more_pending"), "msgs": F.col("msgs") + F.col("more_held"),
    })
    return rows.drop("_channel", "more_waiting", "more_pending", "more_held", "restored", "seq0"), after


def listing(messages: DataFrame) -> DataFrame:
    """State as rows ``queue, kind, seq, uid``: ``waiting`` is not yet taken, ``message`` not yet answered, ``locked`` taken and not answered."""
    taken, answered = F.col("get_id").isNotNull(), F.col("post_id").isNotNull()
    kinds = F.array_compact(F.array(F.when(taken & ~answered, "locked"), F.when(~taken, "waiting"), F.when(~answered, "message")))
    return messages.select(F.col("channel").alias("queue"), F.explode(kinds).alias("kind"), "seq", "uid")


def _newest(versions: DataFrame, key: list[str]) -> DataFrame:
    """The newest version for each key. A partial maximum runs before the shuffle."""
    rest = [c for c in versions.columns if c not in key]
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), "gen").alias("_v"))
    return newest.select(*key, "_v.*").select(*versions.columns)


def traced(root: str, spark: SparkSession, schema: T.StructType) -> DataFrame:
    """The newest version of every message that any generation under ``root`` has, done or not."""
    return _newest(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/messages"), ["channel", "seq"])
