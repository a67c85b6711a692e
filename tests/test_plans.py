import re

import __spark_entry__ as entry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replay_without_hot_channels_shuffles_once(spark, tiny):
    plan = plan_of(entry.queries()["queue_replay"](spark, tiny))
    assert plan.count("Exchange hashpartitioning(channel") == 1 == plan.count("Exchange ")


def test_sliced_windows_spread_a_channel(spark, tiny):
    """The last windows of the sliced replay run per (channel, slice), not per channel."""
    plan = plan_of(entry.queries()["queue_replay_sliced"](spark, tiny))
    assert re.search(r"Exchange hashpartitioning\(channel#\d+L, slice#\d+L", plan)
