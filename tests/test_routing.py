import random
import re

import pytest
from pyspark.sql import functions as F

import model
from relaylog.operators import routing
from relaylog.plans import fixtures as fx
from relaylog.sources import channels, capture


def test_patterns_equal_step_model(spark):
    rnd = random.Random(7)
    parts = ["a", "b", "a.b", "a+b", "(x)", "?", "?", "ab"]
    pairs = []
    for _ in range(3000):
        pattern = "/" + "/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) + "/" + rnd.choice(["", "*/", "*"])
        path = "/" + "/".join(rnd.choice(["a", "b", "a.b", "ab", "(x)", "axb", ""]) for _ in range(rnd.randint(1, 5)))
        pairs.append((pattern, path))
    df = spark.createDataFrame(pairs, "pattern string, path string")
    got = df.select(
        "pattern", "path",
        (routing.first_segment("pattern") == routing.first_segment("path")).alias("same"),
        F.rlike("path", routing.pattern_regex("pattern")).alias("hit"),
    ).collect()
    wrong = [r for r in got if (r.same and r.hit) != model.matches(r.pattern, r.path)]
    assert not wrong


def test_winners(spark, tiny):
    pages = fx.table(spark, tiny, "pages").select("page_id", capture.url_path("url").alias("path"))
    got = {r.route: r["count"] for r in routing.route_match(pages, fx.routes(spark)).groupBy("route").count().collect()}
    assert got == {None: 5, "en-all": 29, "en-35": 2, "fr-seg": 7, "es-root": 5, "de-83": 2}


def test_plan_has_no_nested_loop_and_no_shuffle_of_messages(spark, tiny):
    pages = fx.table(spark, tiny, "pages").select("page_id", capture.url_path("url").alias("path"))
    matched = routing.route_match(pages, fx.routes(spark))
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("limit", ["MAX_BROADCAST_BYTES", "MAX_LOOKUPS"])
def test_large_route_table_is_looked_up_by_path(spark, tiny, monkeypatch, limit):
    pages = fx.table(spark, tiny, "pages").select("page_id", capture.url_path("url").alias("path"))
    expected = sorted(map(str, routing.route_match(pages, fx.routes(spark)).collect()))
    monkeypatch.setattr(routing, limit, 2)
    monkeypatch.setattr(routing, "_looked_up_in_turn", None)
    matched = routing.route_match(pages, fx.routes(spark))
    assert sorted(map(str, matched.collect())) == expected


@pytest.mark.parametrize("by_path", [False, True])
def test_winners_equal_step_model(spark, monkeypatch, by_path):
    """All routes against all paths: the longest literal prefix wins, then the greatest channel."""
    rnd = random.Random(11)
    parts = ["a", "b", "a.b", "(x)", "?", "a?", "ab", "abc"]
    patterns = sorted({"/" + "/".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "/", "/*/", "*", "/*"]) for _ in range(80)})
    routes = [(f"c{i % 7}-{i}", p) for i, p in enumerate(patterns)] + [("any", "*"), ("none", ""), ("root", "/")]
    paths = sorted({"/" + "/".join(rnd.choice(["a", "b", "a.b", "ab", "abcd", "(x)", "a", ""]) for _ in range(rnd.randint(0, 5))) for _ in range(300)})
    monkeypatch.setattr(routing, "MAX_LOOKUPS", 0 if by_path else 10**6)
    df = spark.createDataFrame([(p,) for p in [*paths, None, *paths[:5]]], "path string")
    got = routing.route_match(df, spark.createDataFrame(routes, "channel string, pattern string")).collect()
    assert len(got) == len(paths) + 6 and [r.route for r in got if r.path is None] == [None]
    usable = [(c, p) for c, p in routes if not re.search(r"\?[^/]", p.split("*")[0])]
    seg = lambda t: re.match("/?([^/]*)", t)[1]
    for r in got:
        if r.path is None:
            continue
        hits = [(len(re.match("[^?*]*", p)[0]), c) for c, p in usable if seg(p) == seg(r.path) and model.matches(p, r.path)]
        assert r.route == (max(hits)[1] if hits else None), r.path


def test_a_million_routes_under_one_segment(spark):
    routes = spark.range(1_000_000).select(F.concat(F.lit("c"), "id").alias("channel"), F.concat(F.lit("/api/"), "id", F.lit("/")).alias("pattern"))
    routes = routes.unionByName(spark.createDataFrame([("deep", "/api/77/x/?/"), ("rest", "/api/*")], "channel string, pattern string"))
    paths = ["/api/77/", "/api/77/x/any", "/api/77/y", "/api/1234567/", "/api/999999/z", "/api/99999", "/apix/1/"]
    asked = spark.range(70_000).select("id", F.element_at(F.array(*map(F.lit, paths)), (F.col("id") % 7 + 1).cast("int")).alias("path"))
    matched = routing.route_match(asked, routes)
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan
    got = {r.path: (r.route, r.n) for r in matched.groupBy("path", "route").agg(F.count("*").alias("n")).collect()}
    assert got == {p: (r, 10_000) for p, r in zip(paths, ["deep", "deep", "c77", "rest", "c999999", "c999999", None])}


def test_declared_channels(spark):
    declared = [
        ("sms-gate", "sync-queue://sms-gate/*/", None), ("no-slash", "sync-queue://orders", None),
        ("script", "sync-sapi://script/", "python://h/a.py"), ("bad-uri", "nonsense", None),
        ("bad-mq", "async2://x/", None), ("bad-sapi", "sync-queue://x/", "lua://a.lua"),
        ("no-sapi", "sync-sapi://x/", None), ("one-slash", "sync-sapi://y/", "python:/h.py"),
        ("half-segment", "sync-queue://a?b/", ""), ("missing", None, None),
    ]
    table = channels.channel_table(spark.createDataFrame(declared, "channel string, endpoint string, sapi string"))
    got = {r.channel: (r.status, r.uri) for r in table.collect()}
    assert got == {
        "sms-gate": ("ok", "/sms-gate/*/"), "no-slash": ("ok", "/orders/"), "script": ("ok", "/script/"),
        "bad-uri": ("invalid_endpoint", None), "bad-mq": ("mq_not_found", None), "bad-sapi": ("invalid_sapi", None),
        "no-sapi": ("init_failed", None), "one-slash": ("init_failed", None),
        "half-segment": ("invalid_pattern", None), "missing": ("invalid_endpoint", None),
    }
    assert sorted(r.channel for r in channels.routes_of(table).collect()) == ["no-slash", "script", "sms-gate"]
