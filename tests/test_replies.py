from pyspark.sql import functions as F

from relaylog.operators.queue import queue_replay
from relaylog.plans import fixtures as fx
from relaylog.sources import replies
from test_queue import frame

import model


def reply_rows(spark):
    ops = [("PUT", None), ("HEAD", None), ("GET", None), ("POST", "1000"), ("OPTIONS", None), ("GET", None),
           ("POST", ""), ("PATCH", None)]
    rows = [(i, model.START.replace(second=i), 0, m, 1000 + i, fwd) for i, (m, fwd) in enumerate(ops)]
    return {(r.event_id, r.to): r for r in replies.reply_rows(queue_replay(frame(spark, rows)).withColumn("content", fx.content(F.col("k")))).collect()}


def test_every_side_gets_its_answer(spark):
    got = reply_rows(spark)
    assert {k: (r.code, r.message) for k, r in got.items() if r.to == "sender"} == {
        (1, "sender"): (200, "OK"), (2, "sender"): (200, "OK"), (3, "sender"): (200, "OK"), (4, "sender"): (200, "OK"),
        (5, "sender"): (204, "Queue is empty"),
        (6, "sender"): (400, "Bad Request. Header `X-MSG-FORWARD-UID` not found"),
        (7, "sender"): (405, "Method PATCH Not Allowed"),
    }
    assert got[1, "sender"].x_msg_head_uid == 1000
    assert got[2, "sender"].x_msg_forward_uid == 1000
    caller = got[3, "caller"]
    assert (caller.x_msg_uid, caller.x_msg_forward_uid) == (1000, 1003)
    assert (caller.x_mq_pending_count, caller.x_mq_messages_count) == (1, 1)
    assert (got[3, "sender"].x_mq_pending_count, got[3, "sender"].x_mq_messages_count) == (0, 0)
    assert got[4, "sender"].content_type == "text/plain" and got[4, "sender"].body == replies.HELP_TEXT


def test_sink_is_partitioned_by_day(spark, tmp_path):
    rows = [(0, model.START, 0, "GET", 1, None), (1, model.START.replace(day=2), 0, "GET", 2, None)]
    replies.write_replies(replies.reply_rows(queue_replay(frame(spark, rows)).withColumn("content", fx.content(F.col("k")))), str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").glob("day=*")) == ["day=2024-01-01", "day=2024-01-02"]
