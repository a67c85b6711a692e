"""Message-exchange tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylog.operators import monitor
from relaylog.operators.ids import message_uid
from relaylog.operators.slices import ROWS_PER_SLICE, Slicing, add_slice, plan_slices, running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def method_of(event_type: Column, k: Column) -> Column:
    return (
        F.when(event_type.isin("signup", "purchase"), "PUT")
        .when(event_type == "click", "GET")
        .when(event_type == "view", F.when(k % 5 == 0, "HEAD").otherwise("GET"))
        .otherwise(F.when(k == 99, "DELETE").otherwise("POST"))
    )


def to_messages(events: DataFrame) -> DataFrame:
    """Events as messages, batch or stream."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("channel"),
        method_of(F.col("event_type"), k).alias("method"),
        k.alias("k"),
        message_uid("ts", "event_id").alias("uid"),
    )


def slicing_of(spark: SparkSession, sf_dir: str, rows_per_slice: int = ROWS_PER_SLICE) -> Slicing:
    """Slices of the message log, from one pre-aggregated pass."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), "ts")
    return plan_slices(events, rows_per_slice=rows_per_slice)


def messages(spark: SparkSession, sf_dir: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The core log, with ``slice`` when some channel is hot."""
    return add_slice(to_messages(table(spark, sf_dir, "events")), slicing_of(spark, sf_dir, rows_per_slice))


def with_forward(log: DataFrame) -> DataFrame:
    """Give every POST its forward header: a recent PUT, or one of the bad cases."""
    numbered = running(log, {"_puts": F.when(F.col("method") == "PUT", 1).otherwise(0)})
    post = F.col("method") == "POST"
    seq = F.when(F.col("method") == "PUT", F.col("_puts")).when(post, F.col("_puts") - F.col("k") % 4)
    numbered = numbered.withColumns({
        "_seq": F.when(seq >= 1, seq), "_own": F.when(seq.isNull() | (seq < 1), F.col("event_id")),
    })
    group = Window.partitionBy("channel", "_seq", "_own")
    target = F.max(F.when(F.col("method") == "PUT", F.col("uid"))).over(group)
    fwd = F.when(
        post,
        F.when(F.col("k") % 10 == 9, F.lit(None).cast("string"))
        .when(F.col("k") % 10 == 8, "bad")
        .otherwise(F.coalesce(F.col("_target").cast("string"), F.lit("0"))),
    )
    return numbered.withColumn("_target", target).withColumn("fwd", fwd).drop("_puts", "_seq", "_own", "_target")


def log(spark: SparkSession, sf_dir: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    return with_forward(messages(spark, sf_dir, rows_per_slice))


def retransmits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose uid repeats: a channel reuses one uid per value of ``k``."""
    rows = to_messages(table(spark, sf_dir, "events"))
    return rows.withColumn("uid", F.shiftleft(F.col("channel"), 32).bitwiseOR(F.col("k").cast("bigint")))


def channel_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every channel that occurs in the log."""
    channel = F.col("channel")
    return (
        table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("channel")).agg(F.lit(3).cast("bigint").alias("limit_size"))
        .withColumns({
            "limit_tasks": F.when(channel % 5 == 0, 0).otherwise(1 + channel % 3).cast("bigint"),
            "limit_period": F.when(channel % 4 == 0, "24h").when(channel % 4 == 1, "48h 30m")
            .when(channel % 4 == 2, "0s").otherwise("72h 1m 5s"),
            "max_requests": 1 + channel % 3,
            "active": channel % 7 != 0,
            "mq_class": F.when(channel % 3 == 0, "SyncSAPI").otherwise("SyncQueue"),
            "sapi_class": F.when(channel % 6 == 0, "PythonEngine").when(channel % 9 == 0, "PhpEngine"),
        })
    )


def telemetry(trace: DataFrame) -> DataFrame:
    """Telemetry in which reading and finishing take a time that follows ``k``."""
    micros = {c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("put_ts", "post_ts")}
    return monitor.telemetry(trace, micros["put_ts"] + F.col("k") * 10, micros["post_ts"] + F.col("k"))


def content(k: Column) -> Column:
    """Content of a message in the derived log."""
    return F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))


def raw_http(events: DataFrame) -> DataFrame:
    """Events as captured requests, some of them malformed."""
    kind = F.col("event_type")
    verb = (
        F.when(kind == "signup", "PUT").when(kind == "purchase", "put").when(kind == "click", "GET")
        .when(kind == "view", "BREW").otherwise("POST")
    )
    blank = F.when((kind == "error") & (F.col("event_id") % 5 == 0), "").otherwise("\r\n")
    raw = F.concat(
        verb, F.lit(" /ch/"), F.col("user_id").cast("string"), F.lit("?k=1 HTTP/1.1\r\nHost: a.example\r\n"),
        F.lit("content-type: application/json\r\nX-Msg-Forward-Uid: "), F.col("event_id").cast("string"),
        F.lit("\r\n"), blank, F.col("props"),
    )
    return events.select("event_id", F.col("user_id").alias("channel"), raw.alias("raw"))


def page_http(pages: DataFrame) -> DataFrame:
    """Pages as captured GET requests with the page text as body."""
    target = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^#]*)", 1)
    raw = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\nHost: a.example\n\n"), F.col("html"))
    return pages.select(F.col("page_id").alias("event_id"), F.lit(0).cast("bigint").alias("channel"), raw.alias("raw"))


LISTENERS = [("main", "1M", "8K"), ("edge", "108B", "102")]

ROUTES = [
    ("en-all", "/en/*/"), ("en-35", "/en/35/"), ("fr-seg", "/fr/?/"),
    ("de-83", "/de/83/"), ("es-root", "/es/"), ("any", "/*/"),
]


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "channel string, pattern string")


def customer_channels(customers: DataFrame) -> DataFrame:
    """One channel declaration per customer, covering every accept and reject case."""
    n, key = F.col("c_custkey") % 9, F.col("c_custkey").cast("string")
    endpoint = (
        F.when(n == 0, F.concat(F.lit("sync-queue://sms-"), key, F.lit("/*/")))
        .when(n == 1, F.concat(F.lit("sync-queue://orders-"), key))
        .when(n == 2, F.concat(F.lit("sync-sapi://script-"), key, F.lit("/")))
        .when(n == 3, "nonsense")
        .when(n == 4, "async2://x/")
        .when(n == 5, F.concat(F.lit("sync-queue://x-"), key, F.lit("/")))
        .when(n == 6, "sync-sapi://x/")
        .when(n == 7, "sync-sapi://y/")
        .otherwise(F.concat(F.lit("sync-queue://a?"), key, F.lit("/")))
    )
    sapi = F.when(n == 2, "python://h/a.py").when(n == 5, "lua://a.lua").when(n == 7, "python:/h.py")
    return customers.select(F.col("c_name").alias("channel"), endpoint.alias("endpoint"), sapi.alias("sapi"))


def daily_probes(log_rows: DataFrame) -> DataFrame:
    """Every channel at every midnight after a day of the log."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("interval 1 day")
    ends = log_rows.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
    grid = F.sequence(F.lit(ends["first"]).cast("timestamp_ntz"), F.lit(ends["last"]).cast("timestamp_ntz"), F.expr("interval 1 day"))
    return log_rows.groupBy("channel").agg(F.lit(1).alias("_")).select("channel", F.explode(grid).alias("probe_ts"))


def exchange_captures(log_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The log and the pages as captured requests of two listeners, some of them damaged or lost."""
    n = F.col("event_id")
    verb = F.when(n % 41 == 0, "BREW").when(n % 53 == 0, "OPTIONS").otherwise(F.col("method"))
    path = F.when(n % 59 == 0, F.lit("/nowhere/")).otherwise(F.concat(F.lit("/ch/"), F.col("channel").cast("string"), F.lit("/")))
    forward = F.when(F.col("fwd").isNotNull(), F.concat(F.lit("X-Msg-Forward-Uid: "), "fwd", F.lit("\r\n"))).otherwise("")
    blank = F.when(n % 43 == 0, "").otherwise("\r\n")
    raw = F.concat(verb, F.lit(" "), path, F.lit("?k=1 HTTP/1.1\r\nHost: a.example\r\n"), forward, blank, content(F.col("k")))
    events = log_rows.select(
        "event_id", "ts", F.lit(":8080").alias("listener"), F.when(n % 47 == 0, "").otherwise(raw).alias("raw"), (n % 61 == 0).alias("read_error"),
    )
    page = F.col("page_id")
    verb = F.when(page % 3 == 0, "PUT").when(page % 3 == 1, "GET").otherwise("HEAD")
    target = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^#]*)", 1)
    raw = F.concat(verb, F.lit(" "), target, F.lit(" HTTP/1.1\nContent-Type: text/uri-list\n\n"), "url")
    return events.unionByName(pages.select(
        (page + 1_000_000_000).alias("event_id"),
        (F.lit("2024-02-01").cast("timestamp_ntz") + F.make_dt_interval(secs=page)).alias("ts"),
        F.lit(":8081").alias("listener"), raw.alias("raw"), F.lit(False).alias("read_error"),
    ))


def exchange_channels(events: DataFrame) -> DataFrame:
    """A channel for every user and for each of ROUTES; some are handler channels, some are not declared rightly."""
    n = F.col("user_id")
    rest = F.concat(F.lit("://ch/"), n.cast("string"), F.lit("/"))
    endpoint = F.when(n % 11 == 0, "nonsense").when(n % 3 == 0, F.concat(F.lit("sync-sapi"), rest)).otherwise(F.concat(F.lit("sync-queue"), rest))
    own = events.select("user_id").distinct().select(
        F.concat(F.lit("ch-"), n.cast("string")).alias("channel"), endpoint.alias("endpoint"),
        F.when(n % 3 == 0, F.when(n % 2 == 0, "python://h/a.py").otherwise("php://h/a.php")).alias("sapi"),
        F.when(n % 4 == 0, 0).when(n % 4 == 1, 1).when(n % 4 == 2, 3).otherwise(5).cast("bigint").alias("limit_size"),
        (n % 7 != 0).alias("active"),
    )
    fixed = [(channel, f"sync-queue:/{pattern}", None, 0, True) for channel, pattern in ROUTES]
    return own.unionByName(events.sparkSession.createDataFrame(fixed, own.schema))
