"""Reply rows, the access log, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylog.functions.scalars import telemetry_header
from relaylog.operators.policy import allowed_methods
from relaylog.schema import CLASS_LABELS, DEFAULT_CONTENT_TYPE, MISSING_FORWARD_TEXT, REFUSED_TEXT, REPLY_TEXT

# The help text answered to OPTIONS.
HELP_TEXT = (
    "PUT adds a message at the end of the line and waits for its reply.\n"
    "GET takes the message that has waited longest.\n"
    "POST answers the message that X-MSG-FORWARD-UID names.\n"
    "HEAD looks without taking: X-MQ-QUEUE-COUNT messages wait, X-MQ-PENDING-COUNT are being worked on.\n"
    "OPTIONS lists what a channel serves, like this."
)
# Layout of access log lines and of the route-miss warning.
LOG_FORMAT = "[ Http::Response:%d ] %s:%d - %d (%s)"
LOG_PATTERN = r"^\[ Http::Response:(\d+) \] (.*):(\d+) - (\d+) \((.*?)\)(?: # Thread: ([0-9a-fA-F]+))?$"
MISS_FORMAT = "<Router.Runtime.Warning> Route `%s` not found. [MSG: %d, %s:%d]"


def reply_text(status: Column | str = "status", method: Column | str = "method", fwd: Column | str = "fwd") -> Column:
    status, method, fwd = (F.col(c) if isinstance(c, str) else c for c in (status, method, fwd))
    refused = F.concat(F.lit("Method "), method, F.lit(" Not Allowed"))
    missing = (status == 400) & (F.coalesce(fwd, F.lit("")) == "")
    out = F.when(status == 405, refused).when(missing, MISSING_FORWARD_TEXT)
    for code, text in REPLY_TEXT.items():
        out = out.when(status == code, text)
    return out


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_other_side(replay: DataFrame) -> DataFrame:
    """Add ``put``, the message a row took (GET), saw at the front (HEAD), answered (POST) or is (PUT), and ``post``, its answer.

    ``content`` of a row is what its message carries and ``content_type``, where the log has it, its type. Both sides meet in
    one window over ``(channel, number of the PUT)``: a log without hot channels, which the replay left dealt by channel, is
    only sorted, not joined to itself; otherwise the number spreads a hot channel.
    """
    method, status = F.col("method"), F.col("status")
    if "content_type" not in replay.columns:
        replay = replay.withColumn("content_type", F.lit(None).cast("string"))
    own_type = F.coalesce("content_type", F.lit(DEFAULT_CONTENT_TYPE))
    held, took, peeked, answered = (
        (method == m) & (status == code) for m, code in (("PUT", 202), ("GET", 200), ("HEAD", 200), ("POST", 200))
    )
    queued = F.col("pos").isNotNull() & F.col("q").isNotNull()
    look = F.when(held, F.col("puts")).when(took, F.col("pops")).when(peeked, F.col("pops") + 1).when(answered, F.col("seq"))
    rows = replay.withColumn("_look", F.when(queued, look.cast("bigint")))
    rows = rows.withColumn("_own", F.when(F.col("_look").isNull(), F.col("pos")))
    group = Window.partitionBy("channel", "_look", "_own")
    linked = F.col("_look").isNotNull()
    put = F.struct(F.col("uid"), F.col("content"), own_type.alias("content_type"), F.col("ts"))
    post = F.struct(
        F.col("uid"), F.col("content"), own_type.alias("content_type"), F.col("ts"), F.col("q").cast("bigint").alias("q"),
        (F.col("pend") + F.when(F.col("cleared"), 1).otherwise(0)).cast("bigint").alias("pend"), (F.col("msgs") + 1).cast("bigint").alias("msgs"),
    )
    return rows.withColumns({
        "put": F.max(F.when(linked & held, put)).over(group),
        "taken_at": F.max(F.when(linked & took, F.col("ts"))).over(group),
        "post": F.max(F.when(linked & answered, post)).over(group),
    }).drop("_look", "_own")


def _sender(limit: Column) -> Column:
    """The reply to whoever sent the request, at once."""
    method, status = F.col("method"), F.col("status")
    took, peeked, helped = (method == "GET") & (status == 200), (method == "HEAD") & (status == 200), method == "OPTIONS"
    return F.struct(
        F.lit("sender").alias("to"),
        status.cast("int").alias("code"),
        reply_text().alias("message"),
        F.when(helped & (status == 200), HELP_TEXT).when(took, F.col("put.content")).otherwise("").alias("body"),
        F.when(helped & (status == 200), "text/plain").when(took, F.col("put.content_type")).otherwise(DEFAULT_CONTENT_TYPE).alias("content_type"),
        F.when(status == 405, allowed_methods(F.lit("SyncQueue"), method)).alias("allow"),
        F.col("uid").alias("x_msg_uid"),
        F.when(took, F.col("put.uid")).alias("x_msg_forward_uid"),
        F.when(peeked, F.col("put.uid")).alias("x_msg_head_uid"),
        F.col("q").cast("bigint").alias("x_mq_queue_count"),
        F.col("pend").cast("bigint").alias("x_mq_pending_count"),
        F.col("msgs").cast("bigint").alias("x_mq_messages_count"),
        limit.cast("bigint").alias("x_mq_queue_limit"),
        _telemetry(F.col("ts"), None, None, F.col("ts")).alias("telemetry"),
    )


def _caller() -> Column:
    """The reply to the caller of a PUT, when its answer comes. The counters are those before the message is dropped."""
    nothing = F.lit(None).cast("bigint")
    return F.struct(
        F.lit("caller").alias("to"),
        F.lit(200).alias("code"),
        F.lit(REPLY_TEXT[200]).alias("message"),
        F.col("post.content").alias("body"),
        F.col("post.content_type").alias("content_type"),
        F.lit(None).cast("string").alias("allow"),
        F.col("put.uid").alias("x_msg_uid"),
        F.col("post.uid").alias("x_msg_forward_uid"),
        nothing.alias("x_msg_head_uid"),
        F.col("post.q").alias("x_mq_queue_count"),
        F.col("post.pend").alias("x_mq_pending_count"),
        F.col("post.msgs").alias("x_mq_messages_count"),
        nothing.alias("x_mq_queue_limit"),
        _telemetry(F.col("put.ts"), F.col("taken_at"), F.col("post.ts"), F.col("post.ts")).alias("telemetry"),
    )


def _telemetry(created: Column, taken: Column | None, answered: Column | None, finished: Column) -> Column:
    """Times of a message. What a log does not tell, when it was read, is left out; a message taken after its answer was not stamped."""
    unset = F.lit(None).cast("bigint")
    emplaced = unset if taken is None else _micros(F.when(taken <= answered, taken))
    return telemetry_header(_micros(created), unset, emplaced, unset if answered is None else _micros(answered), _micros(finished))


def reply_rows(replay: DataFrame) -> DataFrame:
    """All replies of a replayed log, with the uids and contents of the other side.

    Every operation but PUT is answered at once. The caller of a PUT is answered when its first POST arrives, with that
    POST's content, and told at once only that it is refused (507, with the limit). ``x_msg_forward_uid`` names the taken
    message (GET) or the answering POST (caller), ``x_msg_head_uid`` the message at the front (HEAD).
    """
    method, status = F.col("method"), F.col("status")
    limit = F.col("x_mq_queue_limit") if "x_mq_queue_limit" in replay.columns else F.lit(None)
    answered = (method == "POST") & (status == 200)
    at_once = ~((method == "PUT") & (status == 202))
    sides = F.array_compact(F.array(F.when(at_once, _sender(limit)), F.when(answered, _caller())))
    rows = with_other_side(replay).withColumn("_r", F.explode(sides))
    return rows.select("event_id", "channel", "ts", "_r.*", F.lit(CLASS_LABELS["SyncQueue"]).alias("x_mq_class"))


def reply_of_each(answered: DataFrame) -> DataFrame:
    """One reply for each row of ``exchange``: what its sender hears in the end.

    A PUT that was answered has the answer, one that still waits has 202. ``refusal`` of a row is the code of a request that
    could not be read, ``mq_class`` the class of its channel, null where none is there.
    """
    method, status, refusal = F.col("method"), F.col("status"), F.col("refusal")
    rows = with_other_side(answered)
    got = (method == "PUT") & (status == 202) & F.col("post").isNotNull()
    plain = _sender(F.col("x_mq_queue_limit"))
    rows = rows.withColumn("_r", F.when(got, _caller()).otherwise(plain))
    lane = F.when(refusal.isNotNull(), "unparsed").when(F.col("mq_class").isNull(), "unrouted").otherwise(F.col("lane"))
    by_handler = F.col("lane") == "handler"
    code = F.coalesce(refusal, F.col("_r.code"))
    message = F.col("_r.message")
    for number, text in REFUSED_TEXT.items():
        message = F.when(refusal == number, text).otherwise(message)
    message = F.when(by_handler & (status == 503), F.col("reply")).otherwise(message)
    body = F.when(by_handler, F.when(status == 200, F.col("reply")).otherwise(F.coalesce("error", F.lit("")))).otherwise(F.col("_r.body"))
    in_channel = refusal.isNull() & F.col("mq_class").isNotNull()
    label = F.lit(None).cast("string")
    for name, text in CLASS_LABELS.items():
        label = F.when(F.col("mq_class") == name, text).otherwise(label)
    return rows.select(
        "event_id", "listener", "ts", F.when(refusal.isNull(), F.col("route")).alias("channel"), lane.alias("lane"), code.cast("int").alias("code"),
        message.alias("message"), F.when(in_channel, body).otherwise("").alias("body"),
        F.when(in_channel, F.col("_r.content_type")).otherwise(DEFAULT_CONTENT_TYPE).alias("content_type"),
        F.when(in_channel & (code == 405), allowed_methods("mq_class", "method")).alias("allow"),
        F.col("uid").alias("x_msg_uid"), "_r.x_msg_forward_uid", "_r.x_msg_head_uid", F.when(in_channel, label).alias("x_mq_class"),
        "_r.x_mq_queue_count", "_r.x_mq_pending_count", "_r.x_mq_messages_count", "_r.x_mq_queue_limit", "_r.telemetry",
    )


def access_line(uid: Column | str, address: Column | str, port: Column | str, code: Column | str,
                message: Column | str) -> Column:
    return F.format_string(LOG_FORMAT, uid, address, port, code, message)


def miss_line(uri: Column | str, uid: Column | str, address: Column | str, port: Column | str) -> Column:
    return F.format_string(MISS_FORMAT, uri, uid, address, port)


def parse_access_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns ``uid, address, port, code, message, thread`` of access log lines.

    Lines end with the message or with the thread that wrote them (null where there is none). Lines of any other
    form are returned by ``unparsed_log``.
    """
    def part(group: int) -> Column:
        return F.regexp_extract(column, LOG_PATTERN, group)

    return lines.filter(F.col(column).rlike(LOG_PATTERN)).select(
        part(1).cast("bigint").alias("uid"), part(2).alias("address"), part(3).cast("int").alias("port"),
        part(4).cast("int").alias("code"), part(5).alias("message"),
        F.when(part(6) != "", part(6)).alias("thread"),
    )


def unparsed_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no access log lines."""
    return lines.filter(~F.coalesce(F.col(column).rlike(LOG_PATTERN), F.lit(False)))


def write_replies(replies: DataFrame, path: str, by: str = "day") -> None:
    """Parquet sink. By day the number of folders follows time, not the number of channels."""
    if by == "day":
        replies = replies.withColumn("day", F.to_date("ts"))
    replies.write.partitionBy(by).mode("append").parquet(path)
