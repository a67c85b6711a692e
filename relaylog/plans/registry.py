"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylog.functions import scalars as S
from relaylog.operators import bounded, handlers, history, ids, monitor, policy, queue, routing
from relaylog.operators import exchange as exchanges
from relaylog.operators.slices import add_slice, plan_slices
from relaylog.plans import fixtures as fx
from relaylog.session import materialise, new_folder
from relaylog.sources import capture, channels, generations, replies

SMALL_SLICE = 25
CUT = "2024-01-15 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


# --- sources, sinks ---------------------------------------------------------------------------


@query
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.to_messages(fx.table(spark, sf_dir, "events"))
    return rows.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "channel", "method",
        capture.method_ordinal("method").alias("ordinal"), "k", "uid",
    )


@query
def union_listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = capture.union_listeners({
        ":8080": fx.raw_http(fx.table(spark, sf_dir, "events")),
        ":8081": fx.page_http(fx.table(spark, sf_dir, "pages")),
    })
    parsed = capture.parse_requests(captures)
    return parsed.select("listener", "event_id", "code", "method", "uri", F.octet_length("body").alias("body_bytes"))


@query
def parse_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = capture.parse_requests(fx.raw_http(fx.table(spark, sf_dir, "events")))
    return parsed.select(
        "event_id", "code", "method", "uri", "params",
        capture.header("x-msg-forward-uid").alias("fwd"),
        F.col("body").cast("string").alias("content"),
    )


@query
def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(fx.LISTENERS, "listener string, query_text string, header_text string").select(
        "listener", S.parse_bytes("query_text", 1048576).alias("query_limit"),
        S.parse_bytes("header_text", 8192).alias("header_limit"),
    )
    raw = fx.raw_http(fx.table(spark, sf_dir, "events")).withColumn(
        "listener", F.when(F.col("channel") % 2 == 0, "main").otherwise("edge")
    )
    rows = raw.join(F.broadcast(limits), "listener")
    parsed = capture.parse_requests(rows, query_limit=F.col("query_limit"), header_limit=F.col("header_limit"))
    return parsed.select("event_id", "listener", "code", F.col("body").cast("string").alias("content"))


@query
def reply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies written to the partitioned sink and read back."""
    path = new_folder(spark, "replies")
    replay = queue.queue_replay(fx.log(spark, sf_dir)).withColumn("content", fx.content(F.col("k")))
    replies.write_replies(replies.reply_rows(replay), path)
    return spark.read.parquet(path).drop("ts", "day")


@query
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    replay = queue.queue_replay(fx.log(spark, sf_dir))
    address = S.format_ipv4(F.lit(3232235776) + F.col("channel") % 256)
    line = replies.access_line("uid", address, (1024 + F.col("k")).cast("int"), "status", replies.reply_text())
    thread = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" # Thread: "), F.lower(F.hex("k")))).otherwise("")
    lines = replay.select(F.concat(line, thread).alias("value"))
    path = new_folder(spark, "access-log")
    lines.write.text(path)
    return replies.parse_access_log(spark.read.text(path))


@query
def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay to a cut, keep the state as a generation, and replay the rest from it."""
    log = materialise(fx.with_forward(fx.to_messages(fx.table(spark, sf_dir, "events"))), "log")
    early = F.col("ts") < F.lit(CUT).cast("timestamp_ntz")
    state = generations.Generations(spark, new_folder(spark, "state"), -1, log)
    _, state = generations.advance(state, log.filter(early), CUT, 0)
    replay, _ = generations.advance(state, log.filter(~early), None, 1)
    return _replay_columns(replay)


@query
def channel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = fx.customer_channels(fx.table(spark, sf_dir, "customer"))
    return channels.channel_table(declared).select("channel", "mq_class", "sapi_class", "uri", "status")


# --- projections, filters ---------------------------------------------------------------------


@query
def msg_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uids from given ids, and uids counted in arrival order within each of four processes."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("process"))
    rows = add_slice(rows, plan_slices(rows, keys=("process",)))
    counted = ids.assign_uids(rows)
    return counted.select(
        "event_id", F.col("uid").alias("counted_uid"), ids.message_uid("ts", "event_id").alias("given_uid")
    )


@query
def msg_uid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.to_messages(fx.table(spark, sf_dir, "events"))
    return rows.select("event_id", ids.uid_second("uid").alias("second"), ids.uid_counter("uid").alias("counter"))


@query
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = capture.parse_requests(fx.raw_http(fx.table(spark, sf_dir, "events")))
    return capture.quarantined(parsed).select("event_id", "code", "method", F.length("raw").alias("raw_chars"))


@query
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.raw_http(fx.table(spark, sf_dir, "events")).withColumn(
        "raw", F.regexp_replace("raw", "\r\ncontent-type", "\r\nHOST:b.example\r\ncontent-type")
    )
    parsed = capture.accepted(capture.parse_requests(raw))
    return parsed.select(
        "event_id",
        capture.header("host").alias("host"),
        capture.header("Content-Type", "text/plain").alias("content_type"),
        capture.header("accept", "*/*").alias("accept"),
        F.size(capture.headers()).alias("n_headers"),
    )


@query
def uri_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "url").withColumn("query", capture.url_query("url"))
    return pages.select(
        "page_id", capture.url_path("url").alias("path"), "query",
        *[capture.query_param("query", name).alias(name) for name in ("utm_source", "page", "ref")],
    )


@query
def method_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.to_messages(fx.table(spark, sf_dir, "events")).withColumn(
        "mq_class", F.when(F.col("channel") % 3 == 0, "SyncSAPI").otherwise("SyncQueue")
    )
    return policy.method_policy(rows).select("event_id", "mq_class", "method", "code", "allow", "message")


@query
def method_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.to_messages(fx.table(spark, sf_dir, "events"))
    return rows.select(
        "event_id", "method", capture.method_ordinal("method").alias("ordinal"), policy.method_dispatch().alias("op")
    )


# --- joins ------------------------------------------------------------------------------------


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", capture.url_path("url").alias("path"))


@query
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = routing.route_match(_page_paths(spark, sf_dir), fx.routes(spark))
    return matched.select("page_id", "path", "route", F.when(F.col("route").isNull(), 404).otherwise(200).alias("status"))


@query
def route_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = routing.route_miss(_page_paths(spark, sf_dir), fx.routes(spark))
    line = replies.miss_line("path", "page_id", F.lit("10.0.0.1"), F.lit(8080))
    return missed.select("page_id", "path", "status", line.alias("line"))


@query
def fifo_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.fifo_consume(fx.messages(spark, sf_dir)).select("channel", "seq", "uid", "put_id", "get_id")


@query
def reply_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.reply_correlate(fx.log(spark, sf_dir)).select("event_id", "channel", "fwd", "put_seq", "status")


@query
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.in_flight(fx.log(spark, sf_dir))


@query
def waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.waiting(fx.messages(spark, sf_dir)).select("channel", "seq", "uid", "put_id")


def _trace_columns(trace: DataFrame) -> DataFrame:
    return trace.select("channel", "seq", "uid", "put_id", "get_id", "get_status", "post_id")


@query
def message_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace_columns(queue.message_trace(fx.log(spark, sf_dir)))


@query
def message_trace_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trace with every channel treated as hot."""
    return _trace_columns(queue.message_trace(fx.log(spark, sf_dir, SMALL_SLICE)))


@query
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    replay = queue.queue_replay(fx.log(spark, sf_dir))
    probes = fx.daily_probes(fx.to_messages(fx.table(spark, sf_dir, "events")))
    state = queue.asof_state(replay, probes, fx.slicing_of(spark, sf_dir))
    return state.withColumn("probe_us", F.unix_micros(F.col("probe_ts").cast("timestamp"))).drop("probe_ts")


# --- aggregations -----------------------------------------------------------------------------


@query
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_stats(queue.queue_replay(fx.log(spark, sf_dir)))


@query
def traffic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.traffic_stats(queue.queue_replay(fx.log(spark, sf_dir)))


@query
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.latency_stats(fx.telemetry(queue.message_trace(fx.log(spark, sf_dir))))


@query
def latency_stats_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report with almost every channel treated as too busy for a summary."""
    return monitor.latency_stats(fx.telemetry(queue.message_trace(fx.log(spark, sf_dir))), accuracy=10)


@query
def traffic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact columns of days that were merged from hours kept as a table."""
    rows = fx.to_messages(fx.table(spark, sf_dir, "events")).withColumn("size", F.col("k").cast("bigint"))
    hours = materialise(monitor.rollup_hours(rows, "size", ("channel", "method")), "hours")
    days = monitor.read_rollups(monitor.merge_rollups(hours, "day", ("channel", "method")))
    start = F.unix_micros(F.col("period").cast("timestamp")).alias("start_us")
    return days.select("channel", "method", start, "requests", "measured", "total", "least", "greatest")


@query
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.dedupe(fx.retransmits(spark, sf_dir)).select("uid", "event_id", "method")


@query
def dedupe_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a log that comes week by week, each week against the uids of the weeks before."""
    rows = materialise(fx.retransmits(spark, sf_dir), "log")
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    weeks = [ends.a + timedelta(days=7 * i) for i in range((ends.b - ends.a).days // 7 + 1)] if ends.a else []
    parts = [rows.filter((F.col("ts") >= F.lit(w)) & (F.col("ts") < F.lit(w + timedelta(days=7)))) for w in weeks]
    return history.dedupe_batches(spark, parts or [rows], new_folder(spark, "uids"), shards=8, bits=1 << 16).select("uid", "event_id", "method")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.message_trace(fx.log(spark, sf_dir)).select(
        "channel", F.col("put_ts").alias("start_ts"), F.col("put_id").alias("start_id"),
        F.col("post_ts").alias("end_ts"), F.col("post_id").alias("end_id"),
    )


@query
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.peak_concurrency(_intervals(spark, sf_dir), fx.slicing_of(spark, sf_dir))


# --- windows ----------------------------------------------------------------------------------


def _depth_columns(depth: DataFrame) -> DataFrame:
    return depth.select("event_id", "channel", "pos", "puts", "depth", "popped", "pops")


@query
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _depth_columns(queue.queue_depth(fx.messages(spark, sf_dir)))


@query
def queue_depth_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same walk with every channel treated as hot."""
    return _depth_columns(queue.queue_depth(fx.messages(spark, sf_dir, SMALL_SLICE)))


def _replay_columns(replay: DataFrame) -> DataFrame:
    return replay.select("event_id", "method", "status", "q", "pend", "msgs")


@query
def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replay_columns(queue.queue_replay(fx.log(spark, sf_dir)))


@query
def queue_replay_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replay with every channel treated as hot."""
    return _replay_columns(queue.queue_replay(fx.log(spark, sf_dir, SMALL_SLICE)))


@query
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_head(fx.messages(spark, sf_dir))


@query
def queue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_top(fx.messages(spark, sf_dir), 3)


# --- scalars ----------------------------------------------------------------------------------


@query
def range_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    size = F.col("p_size")
    allowed = F.when(size % 10 == 0, "").otherwise(
        F.concat(size.cast("string"), F.lit("-"), (size + 6).cast("string"), F.lit(", 2"))
    )
    excluded = F.concat(F.lit("3,"), (size % 4).cast("string"), F.lit("-"), (size % 4 + 1).cast("string"))
    cores = S.range_except(allowed, excluded, 16)
    return part.select("p_partkey", F.array_join(cores.cast("array<string>"), ",").alias("cores"))


@query
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    text, lang = F.col("text"), F.col("lang")
    source = F.col("source")
    padded = F.concat(F.lit("  "), source, F.lit("\t "))
    uri = F.concat(lang, F.lit("-q://"), source)
    options = F.create_map(F.lit("channel.limit"), lang)
    parts = S.explode_text(text, " ", 3)
    return docs.select(
        "doc_id",
        S.trim_space(padded).alias("trimmed"),
        F.array_join(S.trim_list(F.split(F.concat(lang, F.lit(" , "), source), ",")), "|").alias("trimmed_list"),
        F.btrim(source, F.lit("aeiou")).alias("trimmed_chars"),
        F.upper(lang).alias("upper_lang"),
        F.lower(F.upper(lang)).alias("lower_lang"),
        F.size(parts).alias("n_parts"),
        F.element_at(parts, -1).alias("last_part"),
        S.implode(F.array(lang, source), "+").alias("joined"),
        F.format_string("<%s:%d>", lang, F.col("n_chars")).alias("formatted"),
        S.same_text(F.upper(lang), lang).alias("same"),
        S.prefix_number(lang, ["D", "en", "F"]).alias("prefix_no"),
        S.first_of(text, ["the", "de"]).alias("first_needle"),
        S.first_char_of(text, ".,").alias("first_char"),
        S.uri_scheme(uri).alias("scheme"),
        S.uri_rest(uri, "://").alias("rest"),
        S.option(options, "channel.limit", "none").alias("limit_option"),
        S.option(options, "channel.other", "none").alias("other_option"),
    )


@query
def parse_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    n = F.col("p_partkey") % 7
    unit = F.when(n == 0, "G").when(n == 1, " M").when(n == 2, "K").when(n == 3, "B").when(n == 4, "").otherwise("x")
    text = F.when(n == 6, "none").when(n == 5, "").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), unit))
    rows = part.select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", "text", S.parse_bytes("text", 8192).alias("bytes"))


@query
def parse_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    n, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = (
        F.when(n == 0, F.concat(size, F.lit("h 2m 3s"))).when(n == 1, F.concat(size, F.lit("m")))
        .when(n == 2, F.concat(F.lit(" "), size, F.lit(" s"))).when(n == 3, "").otherwise(F.concat(F.lit("x"), size, F.lit("h")))
    )
    rows = part.select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", "text", S.parse_period("text").alias("seconds"))


@query
def expand_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    n, size = F.col("p_partkey") % 4, F.col("p_size")
    low, high = size.cast("string"), (size + 5).cast("string")
    text = (
        F.when(n == 0, F.concat(F.lit("2, "), low, F.lit(" - "), high)).when(n == 1, F.concat(low, F.lit("-")))
        .when(n == 2, "").otherwise(F.concat(high, F.lit(",1,"), high))
    )
    rows = part.select("p_partkey", text.alias("text"))
    return rows.select(
        "p_partkey", "text", F.array_join(S.expand_ranges("text").cast("array<string>"), ",").alias("numbers")
    )


@query
def format_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id")
    word = (F.col("event_id") * 2654435761) % 4294967296
    return events.select(
        "event_id", S.format_ipv4(word).alias("ipv4"),
        S.format_ipv6(word, F.col("event_id"), F.col("user_id"), F.lit(0)).alias("ipv6"),
    )


@query
def json_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fx.table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn",
        F.to_json(F.struct("role", "turn", "text")).alias("as_object"),
        F.to_json(F.array("role", "text")).alias("as_array"),
    )


@query
def telemetry_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    tele = fx.telemetry(queue.message_trace(fx.log(spark, sf_dir)))
    header = S.telemetry_header("created_at", "reading_at", "emplaced_at", "extracted_at", "finished_at")
    rows = tele.select("uid", header.alias("header"))
    return rows.select(
        "uid", "header",
        S.telemetry_value("header", "created-at").alias("created_at"),
        S.telemetry_value("header", "emplaced-at").alias("emplaced_at"),
    )


# --- limits -----------------------------------------------------------------------------------


def _limited(spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None) -> DataFrame:
    rows = fx.messages(spark, sf_dir, rows_per_slice) if rows_per_slice else fx.messages(spark, sf_dir)
    return policy.with_channel_config(rows, fx.channel_config(spark, sf_dir))


@query
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded.bounded_queue(_limited(spark, sf_dir))


@query
def bounded_queue_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same replay with every channel treated as hot."""
    return bounded.bounded_queue(_limited(spark, sf_dir, SMALL_SLICE))


def _varied(spark: SparkSession, sf_dir: str, rows_per_slice: int | None = None) -> DataFrame:
    """The log with limits of 0 (none), 1, 3 and 5, by channel."""
    rows = fx.log(spark, sf_dir, rows_per_slice) if rows_per_slice else fx.log(spark, sf_dir)
    n = F.col("channel") % 4
    return rows.withColumn("limit_size", F.when(n == 0, 0).when(n == 1, 1).when(n == 2, 3).otherwise(5))


def _bounded_columns(replay: DataFrame) -> DataFrame:
    return replay.select("event_id", "method", "status", "q", "pend", "msgs", "x_mq_queue_limit")


@query
def queue_replay_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method answered, with a size limit that varies by channel."""
    return _bounded_columns(bounded.queue_replay_bounded(_varied(spark, sf_dir)))


@query
def queue_replay_bounded_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every channel treated as hot."""
    return _bounded_columns(bounded.queue_replay_bounded(_varied(spark, sf_dir, SMALL_SLICE)))


@query
def rate_limit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbering as ``rate_limit`` with every channel treated as hot."""
    rows = policy.rate_limit(_limited(spark, sf_dir, SMALL_SLICE))
    return rows.select("event_id", "channel", "bucket", "request_no", "over_limit")


@query
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.rate_limit(_limited(spark, sf_dir))
    return rows.select("event_id", "channel", "bucket", "request_no", "over_limit")


@query
def task_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.with_channel_config(_intervals(spark, sf_dir), fx.channel_config(spark, sf_dir))
    return policy.task_limit(rows, fx.slicing_of(spark, sf_dir))


@query
def endpoint_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.endpoint_down(_limited(spark, sf_dir))
    return rows.filter(F.col("status").isNotNull()).select("event_id", "channel", "status")


# --- handlers ---------------------------------------------------------------------------------


def describe_text(batch: pd.DataFrame) -> pd.Series:
    """Sample handler: role and length of the text; lengths divisible by ten are refused."""
    chars = batch["text"].str.len()
    return (batch["role"] + ":" + chars.astype(str)).where(chars % 10 != 0, None)


def count_words(batch: pd.DataFrame) -> pd.Series:
    """Sample handler: number of blanks in the text."""
    return batch["text"].str.count(" ").astype(str)


def answer_numbers(batch: pd.DataFrame) -> pd.Series:
    """Sample handler: the double of the number in the content; it fails on multiples of 25 and has no answer to those that end in 7."""
    k = batch["content"].str.extract(r"(\d+)", expand=False).astype(int)
    if (k % 25 == 0).any():
        raise ValueError(f"no multiples of 25: {k[k % 25 == 0].iloc[0]}")
    return (k * 2).astype(str).where(k % 10 != 7, None)


def echo_content(batch: pd.DataFrame) -> pd.Series:
    """Sample handler: the content again."""
    return batch["content"]


SCRIPTS = {"PythonEngine": "answer_numbers", "PhpEngine": "echo_content"}

handlers.register_handler("answer_numbers", answer_numbers)
handlers.register_handler("echo_content", echo_content)
handlers.register_handler("describe_text", describe_text)
handlers.register_handler("count_words", count_words)


@query
def handler_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fx.table(spark, sf_dir, "conversations")
    return handlers.apply_handler(turns, "describe_text").select("conv_id", "turn", "status", "reply")


def _by_role(turns: DataFrame) -> DataFrame:
    role = F.col("role")
    return turns.withColumn(
        "sapi_class", F.when(role == "user", "PythonEngine").when(role == "assistant", "PhpEngine").otherwise("none")
    )


@query
def handler_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _by_role(fx.table(spark, sf_dir, "conversations"))
    by_class = {"PythonEngine": "describe_text", "PhpEngine": "count_words"}
    return handlers.apply_by_class(turns, by_class).select("conv_id", "turn", "sapi_class", "status", "reply")


@query
def handler_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [
        lambda df: df.withColumn("text", F.btrim("text")),
        lambda df: df.filter(F.col("role") == "user"),
        lambda df: handlers.apply_handler(df, "count_words"),
    ]
    return handlers.handler_chain(fx.table(spark, sf_dir, "conversations"), stages).select(
        "conv_id", "turn", "status", "reply"
    )


@query
def queue_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues with a limit and handler channels that run their scripts, emptied once a day."""
    rows = policy.with_channel_config(fx.log(spark, sf_dir), fx.channel_config(spark, sf_dir)).withColumn("content", fx.content(F.col("k")))
    answered = handlers.queue_by_class(rows, SCRIPTS, drain_seconds=86_400)
    return answered.select(
        "event_id", "channel", "mq_class", "method", "status", "q", "pend", "msgs", "x_mq_queue_limit", "reply", "error"
    )


@query
def exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of two listeners to the reply of each, written to the lanes and read back."""
    events = fx.table(spark, sf_dir, "events")
    captures = fx.exchange_captures(fx.with_forward(fx.to_messages(events)), fx.table(spark, sf_dir, "pages"))
    listeners = spark.createDataFrame([(":8080", 1048576, 8192)], "listener string, query_limit int, header_limit int")
    settings = exchanges.Settings(fx.exchange_channels(events), listeners, SCRIPTS, drain_seconds=86_400)
    path = new_folder(spark, "lanes")
    replied = exchanges.exchange(captures, settings)
    exchanges.write_lanes(replied, path)
    return spark.read.parquet(path).drop("ts", "day")
