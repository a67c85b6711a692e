from pyspark.sql import functions as F

from relaylog.sources import capture, replies


def parse(spark, texts, **limits):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    return capture.parse_requests(df, **limits).orderBy("id")


def test_codes(spark):
    texts = [
        "", "BREW / HTTP/1.1\r\n\r\n", "GET /a", "get /a?x=1&y=2 HTTP/1.1\r\nHost: h\r\n\r\nbody", "PUT \r\n\r\n",
        "GET /a HTTP/1.1\r\nHost: h", "POST /b\nA:1\n\nrest\r\n\r\nmore", "GETX /a HTTP/1.1\r\n\r\n", "GET\t/a HTTP/1.1\r\n\r\n",
    ]
    rows = parse(spark, texts).collect()
    assert [r.code for r in rows] == [400, 405, 431, 0, 400, 431, 0, 405, 405]
    assert (rows[3].method, rows[3].uri, rows[3].params, bytes(rows[3].body)) == ("GET", "/a", "x=1&y=2", b"body")
    assert (rows[6].uri, bytes(rows[6].body)) == ("/b", b"rest\r\n\r\nmore")


def test_read_error(spark):
    df = spark.createDataFrame([("GET /a HTTP/1.1\r\n\r\n", True)], "raw string, failed boolean")
    assert capture.parse_requests(df, read_error=F.col("failed")).first().code == 408


def test_limits_count_bytes(spark):
    head = "PUT /ü HTTP/1.1\r\nA: é\r\n\r\n"
    size = len(head.encode())
    rows = parse(spark, [head + "ééé"], header_limit=size, query_limit=size + 3).collect()
    assert rows[0].code == 0 and bytes(rows[0].body) == "ééé".encode()[:3]
    assert parse(spark, [head + "x"], header_limit=size - 1).first().code == 431
    assert parse(spark, [head + "x"], query_limit=size - 1).first().code == 431


def test_headers(spark):
    text = "GET /a HTTP/1.1\r\nHost:  first \r\nhost: second\r\nbroken line\r\nEmpty:\r\nX-A:b:c\r\n\r\nHost: body"
    row = parse(spark, [text]).select(
        capture.headers().alias("all"),
        capture.header("HOST").alias("host"),
        capture.header("empty", "d").alias("empty"),
        capture.header("none", "d").alias("none"),
        capture.header("none").alias("null"),
        capture.header("x-a").alias("xa"),
    ).first()
    assert [tuple(h) for h in row["all"]] == [("Host", "first"), ("host", "second"), ("Empty", ""), ("X-A", "b:c")]
    assert (row.host, row.empty, row.none, row.null, row.xa) == ("first", "", "d", None, "b:c")


def test_lanes(spark):
    parsed = parse(spark, ["GET /a HTTP/1.1\r\n\r\n", "", "NO / \r\n\r\n"])
    assert [r.id for r in capture.accepted(parsed).collect()] == [0]
    assert sorted(r.id for r in capture.quarantined(parsed).collect()) == [1, 2]


def test_access_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(7, "1.2.3.4", 80, 300, "Multiple (x)")], "uid long, a string, p int, c int, m string")
    line = replies.access_line("uid", "a", "p", "c", "m")
    df.select(F.explode(F.array(line, F.concat(line, F.lit(" # Thread: 7f3a")))).alias("value")).write.text(str(tmp_path / "log"))
    lines = spark.read.text(str(tmp_path / "log")).union(spark.createDataFrame([("other",), (None,)], "value string"))
    parsed = {tuple(r) for r in replies.parse_access_log(lines).collect()}
    assert parsed == {(7, "1.2.3.4", 80, 300, "Multiple (x)", None), (7, "1.2.3.4", 80, 300, "Multiple (x)", "7f3a")}
    assert {r.value for r in replies.unparsed_log(lines).collect()} == {"other", None}


def test_bodies_are_cut_only_where_a_limit_says_so(spark):
    big = "PUT /a/ HTTP/1.1\r\nHost: x\r\n\r\n" + "b" * 2_000_000
    rows = spark.createDataFrame([(big,)], "raw string")
    whole = capture.parse_requests(rows).select(F.octet_length("body").alias("n"), "truncated").first()
    cut = capture.parse_requests(rows, query_limit=1000).select(F.octet_length("body").alias("n"), "truncated").first()
    assert tuple(whole) == (2_000_000, False) and cut.n < 1000 and cut.truncated
