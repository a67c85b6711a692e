"""Every query of the exchange against its SQL, the shape of the plans, and the entry without its optional part."""

import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from relaylog.plans.oracle import ORACLE
from relaylog.plans.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def con(tiny):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{tiny}/{name}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, tiny, name):
    df = QUERIES[name](spark, tiny)
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert normal(df.collect(), df.columns) == normal(result.fetchall(), columns)


@pytest.mark.parametrize("name", ["queue_replay", "queue_replay_sliced", "message_trace", "asof_state", "rate_limit",
                                  "queue_top", "peak_concurrency", "dedupe", "bounded_queue_chunked"])
def test_no_global_window_and_no_cross_join(spark, tiny, name):
    plan = entry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert not re.search(r"Exchange SinglePartition", plan)


def test_replay_shuffles_by_channel_once_per_key(spark, tiny):
    """Depth needs one shuffle and one sort."""
    plan = entry.queries()["queue_depth"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_scan_reads_only_what_is_needed(spark, tiny):
    plan = entry.queries()["route_match"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "method", "status", "q", "pend", "msgs"]
    assert df.count() == 1000


LISTED = "import __spark_entry__ as e; print(' '.join(sorted(e.queries())))"


def listed(folder, code=LISTED):
    """Queries of an entry imported by another process from ``folder``."""
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


def test_entry_without_the_optional_part(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/relaylog", tmp_path / "relaylog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    assert listed(tmp_path) == set(QUERIES)
    if os.path.isdir(f"{root}/relaylog/llm"):
        shutil.copytree(f"{root}/relaylog/llm", tmp_path / "relaylog/llm")
        assert listed(tmp_path) > set(QUERIES) and "pipeline" not in listed(tmp_path)


def test_entry_without_a_library():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert listed(root, "import sys; sys.modules['xxhash'] = None; " + LISTED) == set(QUERIES)
