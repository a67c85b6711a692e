"""Deterministic replay of request/reply queues from a message log.

Input rows: ``event_id, ts, channel, method, k, uid, fwd`` and, after ``add_slice``, ``slice``.
Order inside a channel is ``(ts, event_id)``.

A queue is a walk: PUT adds one, GET takes one if there is one. The depth is the distance of
the walk from its running minimum, the n-th successful GET takes the n-th PUT, and the first
POST naming a PUT's uid after that PUT answers it. All of this is windows and equi-keyed
grouping. Without slices one shuffle by channel serves them all; with slices ``(channel, seq)``
and ``(channel, uid)`` spread a hot channel over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylog.operators.slices import add_slice, carry_forward, is_sliced, running
from relaylog.session import materialise

NOT_SERVED = ("DELETE", "TRACE", "CONNECT", "PATCH")


def _is(method: str) -> Column:
    return F.col("method") == method


def forward_uid(fwd: Column | str = "fwd") -> Column:
    """The uid named by a forward header: its leading integer, null when there is none."""
    fwd = F.col(fwd) if isinstance(fwd, str) else fwd
    return F.regexp_extract(fwd, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def forward_status(fwd: Column | str = "fwd") -> Column:
    """400 for a missing, empty, non-numeric or out-of-range header, otherwise null."""
    fwd = F.col(fwd) if isinstance(fwd, str) else fwd
    number = F.regexp_extract(fwd, r"^\s*([+-]?\d+)", 1).try_cast("decimal(38,0)")
    fits = F.abs(number) < F.lit("18446744073709551616").cast("decimal(38,0)")
    return F.when(fwd.isNull() | ~F.coalesce(fits, F.lit(False)), F.lit(400))


def queue_depth(messages: DataFrame) -> DataFrame:
    """Depth walk of an unbounded queue.

    Adds ``pos`` (position in the channel), ``puts`` (PUTs so far), ``depth`` (waiting after
    the row), ``popped`` (this GET took a message) and ``pops`` (messages taken so far).
    """
    step = F.when(_is("PUT"), 1).when(_is("GET"), -1).otherwise(0)
    walk = running(
        messages,
        sums={"_s": step, "puts": F.when(_is("PUT"), 1).otherwise(0), "pos": F.lit(1)},
        lows={"_low": ("_s", True), "_low_before": ("_s", False)},
    )
    floor_now = F.least(F.lit(0), F.col("_low"))
    floor_before = F.least(F.lit(0), F.col("_low_before"))
    depth = F.col("_s") - floor_now
    return walk.withColumns({
        "depth": depth.cast("bigint"),
        "popped": _is("GET") & (F.col("_s") >= floor_before),
        "pops": (F.col("puts") - depth).cast("bigint"),
    }).drop("_s", "_low", "_low_before")


def _winning_posts(walk: DataFrame) -> DataFrame:
    """Rows of ``walk`` with ``reply_seq``: sequence of the PUT that a POST is first to answer.

    One window over ``(channel, uid)``; the PUT and the POSTs naming it meet there. Rows
    without a uid of interest get a key of their own, so they form no group.
    """
    named = F.when(_is("PUT"), F.col("uid")).when(_is("POST"), forward_uid())
    keyed = walk.withColumns({"_uid": named, "_own": F.when(named.isNull(), F.col("pos"))})
    group = Window.partitionBy("channel", "_uid", "_own")
    keyed = keyed.withColumns({
        "_put_pos": F.min(F.when(_is("PUT"), F.col("pos"))).over(group),
        "_put_seq": F.min(F.when(_is("PUT"), F.col("puts"))).over(group),
    })
    late = _is("POST") & (F.col("pos") > F.col("_put_pos"))
    keyed = keyed.withColumn("_first", F.min(F.when(late, F.col("pos"))).over(group))
    return keyed.withColumn(
        "reply_seq", F.when(_is("POST") & (F.col("pos") == F.col("_first")), F.col("_put_seq"))
    ).drop("_uid", "_own", "_put_pos", "_put_seq", "_first")


def _first_replies(walk: DataFrame) -> DataFrame:
    """The answering POST of each answered PUT, for logs with hot channels: ``channel, seq`` and
    the POST's ``slice, pos, event_id, ts``.

    The first PUT of a uid owns it. A uid may be named by any number of POSTs, so the PUT is
    looked up by an equi join, in which adaptive execution splits a hot uid, and the first reply is a pre-aggregated minimum.
    """
    puts = walk.filter(_is("PUT") & F.col("uid").isNotNull()).groupBy("channel", F.col("uid").alias("_uid")).agg(
        F.min("pos").alias("_put_pos"), F.min("puts").alias("seq")
    )
    posts = walk.filter(_is("POST") & forward_uid().isNotNull()).select(
        "channel", forward_uid().alias("_uid"), "slice", "pos", "event_id", "ts"
    )
    return (
        posts.join(puts, ["channel", "_uid"])
        .filter(F.col("pos") > F.col("_put_pos"))
        .groupBy("channel", "seq")
        .agg(F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in ("slice", "event_id", "ts")])
    )


def _own_seq() -> Column:
    return F.when(_is("PUT"), F.col("puts")).when(F.col("popped"), F.col("pops"))


def linked(messages: DataFrame) -> DataFrame:
    """The depth walk with ``reply_seq`` and ``seq``, the PUT number each row belongs to."""
    walk = queue_depth(messages)
    if is_sliced(messages):
        walk = materialise(walk, "walk")
        first = _first_replies(walk).select("channel", "pos", F.col("seq").alias("reply_seq"))
        walk = walk.join(first, ["channel", "pos"], "left")
    else:
        walk = _winning_posts(walk)
    return walk.withColumn("seq", F.coalesce(_own_seq(), "reply_seq"))


def message_trace(messages: DataFrame) -> DataFrame:
    """One row per PUT: who consumed it, who answered it.

    ``get_status`` is 200, or 503 when the message had been answered before it was taken.
    """
    if not is_sliced(messages):
        return trace_of(linked(messages))
    walk = materialise(queue_depth(messages), "walk")
    replies = _first_replies(walk).select(
        "channel", "seq", F.lit("POST").alias("method"), "event_id", "ts", "pos", F.lit(False).alias("popped"),
        F.col("seq").alias("reply_seq"),
    )
    rows = walk.withColumn("seq", _own_seq()).select(
        "channel", "seq", "method", "event_id", "ts", "pos", "popped", "uid", "k"
    )
    return trace_of(rows.unionByName(replies, allowMissingColumns=True))


def trace_of(rows: DataFrame, *extra: Column) -> DataFrame:
    """The trace of linked or replayed rows, with ``extra`` aggregates over the rows of each message."""
    def pick(cond: Column, name: str) -> Column:
        return F.max(F.when(cond, F.col(name)))

    put, get, post = _is("PUT"), F.col("popped"), F.col("reply_seq").isNotNull()
    trace = rows.filter(F.col("seq").isNotNull()).groupBy("channel", "seq").agg(
        pick(put, "uid").alias("uid"),
        pick(put, "k").alias("k"),
        pick(put, "event_id").alias("put_id"),
        pick(put, "ts").alias("put_ts"),
        pick(get, "event_id").alias("get_id"),
        pick(get, "ts").alias("get_ts"),
        pick(get, "pos").alias("get_pos"),
        pick(post, "event_id").alias("post_id"),
        pick(post, "ts").alias("post_ts"),
        pick(post, "pos").alias("post_pos"),
        *extra,
    )
    return trace.withColumn(
        "get_status",
        F.when(F.col("get_pos").isNotNull(), F.when(F.col("post_pos") < F.col("get_pos"), 503).otherwise(200)),
    )


def _annotated(messages: DataFrame) -> DataFrame:
    """Every row with the outcome of its link: ``late_pop`` and ``clears`` flags."""
    if is_sliced(messages):
        return _annotated_sliced(messages)
    rows = linked(messages).withColumn("_own", F.when(F.col("seq").isNull(), F.col("pos")))
    group = Window.partitionBy("channel", "seq", "_own")
    get_pos = F.min(F.when(F.col("popped"), F.col("pos"))).over(group)
    post_pos = F.min(F.when(F.col("reply_seq").isNotNull(), F.col("pos"))).over(group)
    rows = rows.withColumns({"_get": get_pos, "_post": post_pos})
    return rows.withColumns({
        "late_pop": F.col("popped") & (F.col("_post") < F.col("_get")),
        "clears": F.col("reply_seq").isNotNull() & (F.col("_get") < F.col("_post")),
    }).drop("_own", "_get", "_post")


def _annotated_sliced(messages: DataFrame) -> DataFrame:
    """The outcome of each link returns to its row as a note just before it in channel order.

    Pairing uses only the rows that take part, and the whole log is shuffled once, for the
    window in which every row picks up its note.
    """
    walk = materialise(queue_depth(messages), "walk")
    taken = walk.filter(F.col("popped")).select(
        "channel", F.col("pops").alias("seq"), F.col("pos").alias("_get"), F.col("slice").alias("_get_slice")
    )
    replied = _first_replies(walk).select(
        "channel", "seq", F.col("pos").alias("_post"), F.col("slice").alias("_post_slice")
    )
    pairs = taken.unionByName(replied, allowMissingColumns=True).groupBy("channel", "seq").agg(
        *[F.max(c).alias(c) for c in ("_get", "_get_slice", "_post", "_post_slice")]
    ).filter(F.col("_post").isNotNull())
    late = F.coalesce(F.col("_post") < F.col("_get"), F.lit(False))
    clears = F.coalesce(F.col("_get") < F.col("_post"), F.lit(False))
    none = F.lit(None).cast("bigint")

    def note(part: str, pos: str, seq: Column, late_pop: Column, cleared: Column) -> Column:
        return F.struct(F.col(part).alias("slice"), F.col(pos).alias("pos"), seq.alias("reply_seq"),
                        late_pop.alias("late_pop"), cleared.alias("clears"))

    notes = pairs.select("channel", F.explode(F.array_compact(F.array(
        note("_post_slice", "_post", F.col("seq").cast("bigint"), F.lit(False), clears),
        F.when(late, note("_get_slice", "_get", none, F.lit(True), F.lit(False))),
    ))).alias("n")).select("channel", "n.*", F.lit(0).alias("_kind"))
    rows = walk.withColumn("_kind", F.lit(1)).unionByName(notes, allowMissingColumns=True)
    order = Window.partitionBy("channel", "slice").orderBy("pos", "_kind")
    noted = F.lag("pos").over(order) == F.col("pos")
    rows = rows.withColumns({
        c: F.when(noted, F.lag(c).over(order)) for c in ("reply_seq", "late_pop", "clears")
    })
    return rows.filter(F.col("_kind") == 1).drop("_kind").withColumns({
        "seq": F.coalesce(_own_seq(), "reply_seq"),
        "late_pop": F.coalesce("late_pop", F.lit(False)),
    })


def queue_replay(messages: DataFrame) -> DataFrame:
    """Status and the three counters after every operation of an unbounded queue.

    ``q`` waiting, ``pend`` taken and not cleared, ``msgs`` accepted and not answered. A message
    taken after it was answered (503) stays pending for good.
    """
    rows = _annotated(messages)
    answered = F.col("reply_seq").isNotNull()
    rows = running(
        rows,
        sums={
            "_answered": F.when(answered, 1).otherwise(0),
            "_cleared": F.when(F.coalesce("clears", F.lit(False)), 1).otherwise(0),
        },
        order=("pos",),
    )
    status = (
        F.when(_is("PUT"), 202)
        .when(_is("GET"), F.when(~F.col("popped"), 204).when(F.col("late_pop"), 503).otherwise(200))
        .when(_is("POST"), F.coalesce(forward_status(), F.when(answered, 200).otherwise(300)))
        .when(_is("HEAD"), F.when(F.col("depth") > 0, 200).otherwise(204))
        .when(F.col("method").isin(*NOT_SERVED), 405)
        .otherwise(200)
    )
    return rows.withColumns({
        "status": status,
        "cleared": F.coalesce("clears", F.lit(False)),
        "q": F.col("depth"),
        "pend": F.col("pops") - F.col("_cleared"),
        "msgs": F.col("puts") - F.col("_answered"),
    }).drop("_answered", "_cleared", "clears", "late_pop")


def fifo_consume(messages: DataFrame) -> DataFrame:
    """Each successful GET with the PUT it took, paired by ``(channel, seq)``."""
    walk = queue_depth(messages)
    seq = F.when(_is("PUT"), F.col("puts")).when(F.col("popped"), F.col("pops"))
    pairs = walk.withColumn("seq", seq).filter(F.col("seq").isNotNull()).groupBy("channel", "seq").agg(
        F.max(F.when(_is("PUT"), F.col("uid"))).alias("uid"),
        F.max(F.when(_is("PUT"), F.col("event_id"))).alias("put_id"),
        F.max(F.when(_is("GET"), F.col("event_id"))).alias("get_id"),
    )
    return pairs.filter(F.col("get_id").isNotNull())


def reply_correlate(messages: DataFrame) -> DataFrame:
    """Every POST with its status and, when it is the first valid answer, the PUT's ``seq``."""
    posts = linked(messages).filter(_is("POST"))
    answered = F.col("reply_seq").isNotNull()
    return posts.select(
        "event_id", "channel", "fwd", F.col("reply_seq").alias("put_seq"),
        F.coalesce(forward_status(), F.when(answered, 200).otherwise(300)).alias("status"),
    )


def in_flight(messages: DataFrame) -> DataFrame:
    """Messages taken by a consumer and not answered."""
    trace = message_trace(messages)
    return trace.filter(F.col("get_id").isNotNull() & F.col("post_id").isNull()).select(
        "channel", "seq", "uid", "put_id", "get_id"
    )


def waiting(messages: DataFrame) -> DataFrame:
    """Messages accepted and not yet taken, answered or not."""
    walk = queue_depth(messages)
    seq = F.when(_is("PUT"), F.col("puts")).when(F.col("popped"), F.col("pops"))
    ends = walk.withColumn("seq", seq).filter(F.col("seq").isNotNull()).groupBy("channel", "seq").agg(
        F.max(F.when(_is("PUT"), F.col("uid"))).alias("uid"),
        F.max(F.when(_is("PUT"), F.col("event_id"))).alias("put_id"),
        F.max(F.when(_is("PUT"), F.col("ts"))).alias("put_ts"),
        F.max(F.when(_is("GET"), F.col("event_id"))).alias("_get_id"),
    )
    return ends.filter(F.col("_get_id").isNull()).drop("_get_id")


def queue_top(messages: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest waiting messages per channel.

    Ranking with a bound lets Spark keep only ``n`` rows per channel in each task before the
    shuffle, so a long backlog does not travel.
    """
    oldest = Window.partitionBy("channel").orderBy("seq")
    return (
        waiting(messages)
        .withColumn("rank", F.row_number().over(oldest))
        .filter(F.col("rank") <= n)
        .select("channel", F.col("rank").cast("bigint").alias("rank"), "uid", "put_id")
    )


def queue_head(messages: DataFrame) -> DataFrame:
    """For every HEAD, the uid at the front of the queue at that moment (null when empty)."""
    walk = queue_depth(messages)
    puts = walk.filter(_is("PUT")).select("channel", F.col("puts").alias("_seq"), F.col("uid").alias("head_uid"))
    heads = walk.filter(_is("HEAD")).withColumn("_seq", F.when(F.col("depth") > 0, F.col("pops") + 1))
    return heads.join(puts, ["channel", "_seq"], "left").select(
        "event_id", "channel", "head_uid", F.when(F.col("head_uid").isNull(), 204).otherwise(200).alias("status")
    )


def queue_stats(replay: DataFrame) -> DataFrame:
    """Counters per channel after its last operation."""
    last = replay.groupBy("channel").agg(
        F.max_by("q", "pos").alias("waiting"),
        F.max_by("pend", "pos").alias("pending"),
        F.max_by("msgs", "pos").alias("messages"),
        F.max("pos").alias("operations"),
    )
    return last


def asof_state(replay: DataFrame, probes: DataFrame, slicing=None) -> DataFrame:
    """Queue counters as of each probe ``(channel, probe_ts)``; an operation at that time counts.

    Probes join the ordered stream as rows of their own and take the last known state, so no
    inequality join is needed.
    """
    states = replay.select(
        "channel", "ts", F.lit(0).alias("probe"), "event_id", *_state_columns(replay),
        *(["slice"] if is_sliced(replay) else []),
    )
    rows = probes.select(
        "channel", F.col("probe_ts").alias("ts"), F.lit(1).alias("probe"), F.lit(None).cast("bigint").alias("event_id"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("q", "pend", "msgs")],
    )
    if is_sliced(replay):
        rows = add_slice(rows, slicing)
    filled = carry_forward(states.unionByName(rows), ["q", "pend", "msgs"], order=("ts", "probe", "event_id"))
    return filled.filter(F.col("probe") == 1).select(
        "channel", F.col("ts").alias("probe_ts"),
        F.coalesce("q", F.lit(0)).alias("waiting"),
        F.coalesce("pend", F.lit(0)).alias("pending"),
        F.coalesce("msgs", F.lit(0)).alias("messages"),
    )


def _state_columns(replay: DataFrame) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in ("q", "pend", "msgs")]
