"""Row schemas and the fixed values of the message-exchange protocol."""

from pyspark.sql import types as T

# Request methods in ordinal order 1..9 (0 = unsupported).
METHODS = ("GET", "POST", "PUT", "HEAD", "OPTIONS", "DELETE", "TRACE", "CONNECT", "PATCH")

# Queue classes, their public names, and the methods each one serves.
QUEUE_CLASSES = {"sync-queue": "SyncQueue", "sync-sapi": "SyncSAPI"}
CLASS_LABELS = {"SyncQueue": "Sync.MQ.Queue", "SyncSAPI": "Sync.MQ.SAPI"}
HANDLER_CLASSES = {"php": "PhpEngine", "python": "PythonEngine"}
ALLOWED = {
    "SyncQueue": ("PUT", "GET", "POST", "HEAD", "OPTIONS"),
    "SyncSAPI": ("PUT",),
}

# Limits used when a listener names none.
DEFAULT_QUERY_LIMIT = 1048576
DEFAULT_HEADER_LIMIT = 8192
POLL_INTERVAL = "3 seconds"

# Reply texts by status.
REPLY_TEXT = {
    200: "OK",
    202: "Accepted",
    204: "Queue is empty",
    300: "Multiple Replays. Reply Ignored.",
    400: "Bad Request. Invalid `X-MSG-FORWARD-UID` header",
    404: "Endpoint not found",
    503: "Server.Std.Exception",
    507: "Insufficient Storage",
    521: "SyncQueue is down pending",
}
# Reason phrases for requests that cannot be read.
REFUSED_TEXT = {
    400: "Bad Request",
    405: "Method Not Allowed",
    408: "Request Timeout",
    431: "Request Header Fields Too Large",
}
MISSING_FORWARD_TEXT = "Bad Request. Header `X-MSG-FORWARD-UID` not found"
DEFAULT_CONTENT_TYPE = "application/json"

HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

MESSAGE = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("channel", T.LongType()),
    T.StructField("method", T.StringType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("uid", T.LongType()),
    T.StructField("fwd", T.StringType()),
])

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
