"""Raw HTTP captures to message rows, with native expressions only.

Status codes: 0 accepted, 400 no text or no uri, 405 unknown method, 408 read error, 431 no end
of head inside the limits. Lines may end in CR LF or LF, header values are trimmed, and the
query string is split from the uri.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylog.schema import DEFAULT_HEADER_LIMIT, METHODS

_BLANKS = " \t"


def method_ordinal(method: Column | str) -> Column:
    """1..9 in the order of the method list, 0 when not supported."""
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.upper(method)).cast("int")


def parse_requests(
    captures: DataFrame,
    raw: str = "raw",
    query_limit: Column | int | None = None,
    header_limit: Column | int = DEFAULT_HEADER_LIMIT,
    read_error: Column | None = None,
) -> DataFrame:
    """Add ``code, method, uri, params, head, body, truncated`` for the capture text in ``raw``.

    Limits count bytes: the head has to end within both limits. A request is cut only where a ``query_limit`` is
    given (``DEFAULT_QUERY_LIMIT`` is what listeners use that name none), and ``truncated`` marks it. Look headers up in ``head`` with ``header`` or list them with ``headers``.
    """
    text = F.col(raw)
    unlimited = query_limit is None
    query_limit = F.lit(2**31 - 1) if unlimited else (F.lit(query_limit) if isinstance(query_limit, int) else query_limit).cast("int")
    header_limit = (F.lit(header_limit) if isinstance(header_limit, int) else header_limit).cast("int")

    method = F.upper(F.regexp_extract(text, "^(?i)(" + "|".join(METHODS) + ") ", 1))
    rows = captures.withColumns({
        "_method": method,
        "_target": F.regexp_extract(text, r"^\S+ ([^ \t\r\n]*)", 1),
        # A head that ends further back is refused anyway; a character has a byte at least.
        "_end": F.regexp_instr(F.substring(text, F.lit(1), F.least(query_limit, header_limit)), F.lit("\r\n\r\n|\n\n")),
    })
    separator = F.when(F.substring(text, F.col("_end"), F.lit(1)) == "\r", 4).otherwise(2)
    rows = rows.withColumn("_head", F.substring(text, F.lit(1), F.col("_end") + separator - 1))
    rows = rows.withColumn("_head_bytes", F.octet_length("_head"))

    ended = (F.col("_end") > 0) & (F.col("_head_bytes") <= F.least(query_limit, header_limit))
    code = (
        F.when(text.isNull() | (text == ""), 400)
        .when(F.col("_method") == "", 405)
        .when((F.col("_end") == 0) & (F.instr(text, "\n") == 0), 431)
        .when(F.col("_target") == "", 400)
        .when(~ended, 431)
        .otherwise(0)
    )
    if read_error is not None:
        code = F.when(read_error, 408).otherwise(code)
    rows = rows.withColumn("code", code)
    ok = F.col("code") == 0
    target = F.col("_target")
    body = F.substring(text.cast("binary"), F.col("_head_bytes") + 1, query_limit - F.col("_head_bytes"))
    return rows.withColumns({
        "method": F.when(F.col("_method") != "", F.col("_method")),
        "uri": F.when(ok, F.substring_index(target, "?", 1)),
        "params": F.when(ok & (F.instr(target, "?") > 0), F.substring(target, F.instr(target, "?") + 1, F.length(target))),
        "head": F.when(ok, F.col("_head")),
        "body": F.when(ok, body),
        "truncated": F.lit(False) if unlimited else ok & (F.octet_length(text) > query_limit),
    }).drop("_method", "_target", "_end", "_head", "_head_bytes")


def headers(head: Column | str = "head") -> Column:
    """All headers in order as an array of ``(name, value)``."""
    head = F.col(head) if isinstance(head, str) else head
    named = F.filter(F.split(head, "\r?\n"), lambda line: line.rlike(r"^[^: ]+:"))
    return F.transform(named, lambda line: F.struct(
        F.substring_index(line, ":", 1).alias("name"),
        F.btrim(F.substring(line, F.instr(line, ":") + 1, F.length(line)), F.lit(_BLANKS)).alias("value"),
    ))


def header(name: str, default: str | None = None, head: Column | str = "head") -> Column:
    """Case-insensitive header lookup, the first of several equal names wins.

    One pass over the head text; listing all headers first would be repeated per lookup.
    """
    head = F.col(head) if isinstance(head, str) else head
    pattern = rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*?)[ \t]*\r?$"
    value = F.regexp_extract(head, pattern, 1)
    return F.when(value != "", value).when(head.rlike(pattern), "").otherwise(F.lit(default))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed_once(parsed).filter(F.col("code") == 0)


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed_once(parsed).filter(F.col("code") != 0)


def parsed_once(parsed: DataFrame) -> DataFrame:
    """Keep filters on ``code``, and expressions over parsed columns, above the parsing.

    Spark would push a filter down and parse again for every use of the code; it does not push a
    filter through a generator, here one that yields the code itself.
    """
    return parsed.withColumn("code", F.explode(F.array("code")))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)


def url_query(url: Column | str) -> Column:
    """Text between ``?`` and ``#``, null when there is none."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(query != "", query)


def query_param(query: Column | str, name: str) -> Column:
    """One parameter of a query string; the first of several equal names wins."""
    query = F.col(query) if isinstance(query, str) else query
    pairs = F.filter(F.split(query, "&"), lambda p: F.startswith(p, F.lit(name + "=")))
    pair = F.get(pairs, 0)
    return F.substring(pair, F.lit(len(name) + 2), F.length(pair))


def union_listeners(captures: dict[str, DataFrame]) -> DataFrame:
    """Captures of several listeners as one input with a ``listener`` column."""
    parts = [df.withColumn("listener", F.lit(name)) for name, df in captures.items()]
    return reduce(DataFrame.unionByName, parts)
