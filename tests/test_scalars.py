import pytest
from pyspark.sql import functions as F

from relaylog.functions import scalars as S
from relaylog.operators import ids


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,expected", [
    ("1M", 1048576), ("4K", 4096), ("2G", 2147483648), ("7B", 7), ("12", 12), ("", -1), ("x", -1), (" 3 K", 3072), ("a5M", 5242880),
])
def test_bytes(spark, text, expected):
    assert value(spark, S.parse_bytes(F.lit(text), -1)) == expected


@pytest.mark.parametrize("text,expected", [
    ("1h 2m 3s", 3723), ("1m", 60), ("0s", 0), ("", 0), ("x1h", 0), ("3s 1h", 3), (" 2 h", 7200),
])
def test_period(spark, text, expected):
    assert value(spark, S.parse_period(F.lit(text))) == expected


@pytest.mark.parametrize("text,expected", [
    ("2,3-8", [2, 3, 4, 5, 6, 7, 8]), ("1,3,7", [1, 3, 7]), ("5-", [5]), ("", []), (" 4 - 6 , 4", [4, 5, 6]),
])
def test_ranges(spark, text, expected):
    assert value(spark, S.expand_ranges(F.lit(text))) == expected


def test_range_except(spark):
    assert value(spark, S.range_except(F.lit("2-12"), F.lit("3,4"), 8)) == [0, 1, 2, 5, 6, 7]
    assert value(spark, S.range_except(F.lit(""), F.lit("0"), 3)) == [1, 2]


def test_addresses(spark):
    assert value(spark, S.format_ipv4(F.lit(3232235777))) == "192.168.1.1"
    words = [0x20010DB8, 0, 0xFF00, 0x428329]
    assert value(spark, S.format_ipv6(*[F.lit(w) for w in words])) == "2001:0DB8:0000:0000:0000:FF00:0042:8329"


def test_text(spark):
    assert value(spark, S.explode_text(F.lit("a.b.c"), ".", 2)) == ["a", "b.c"]
    assert value(spark, S.explode_text(F.lit(""), ".")) == []
    assert value(spark, S.prefix_number(F.lit("Post x"), ["get ", "POST "])) == 2
    assert value(spark, S.first_of(F.lit("abXY"), ["xy", "q"])) == 3
    assert value(spark, S.first_char_of(F.lit("ab-]"), "]-")) == 3
    assert value(spark, S.uri_scheme(F.lit("sync-queue://a/b"))) == "sync-queue"
    assert value(spark, S.trim_space(F.lit(" \ta b\n"))) == "a b"


def test_telemetry(spark):
    micros = [F.lit(1), F.lit(2), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.lit(9)]
    header = S.telemetry_header(*micros)
    assert value(spark, header) == "created-at=1;reading-at=2;finished-at=9"
    assert value(spark, S.telemetry_value(header, "finished-at")) == 9
    assert value(spark, S.telemetry_value(header, "emplaced-at")) is None


def test_uid_layout(spark):
    uid = ids.message_uid(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(5))
    assert value(spark, ids.uid_second(uid)) == 1704067200
    assert value(spark, ids.uid_counter(uid)) == 5


def test_numbers_beyond_64_bits(spark):
    assert value(spark, S.parse_bytes(F.lit("99999999999G"), -1)) == -1
    assert value(spark, S.parse_period(F.lit("9223372036854775807h"))) == 0
    assert value(spark, S.range_except(F.lit("5-9000000000000000000"), F.lit("0-9000000000000000"), 4)) == []
    assert value(spark, S.range_except(F.lit("6-9000000000000000000"), F.lit("1"), 4)) == [0, 2, 3]
