"""Scalar helpers of the exchange as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit shifts of a byte size, seconds per unit of a period.
BYTE_SHIFT = {"G": 30, "M": 20, "K": 10, "B": 0}
PERIOD_UNITS = {"h": 3600, "m": 60, "s": 1}
# Timestamps of the telemetry header, in the order they are written.
TELEMETRY = ("created-at", "reading-at", "emplaced-at", "extracted-at", "finished-at")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_list(values: Column | str) -> Column:
    return F.transform(_col(values), lambda v: F.btrim(v, F.lit(" \t\r\n\f\x0b")))


def trim_space(value: Column | str) -> Column:
    return F.btrim(_col(value), F.lit(" \t\r\n\f\x0b"))


def explode_text(value: Column | str, delimiter: str, limit: int = -1) -> Column:
    """Split by a literal delimiter into at most ``limit`` parts; empty text gives no parts."""
    value = _col(value)
    parts = F.split(value, re.escape(delimiter), limit)
    return F.when(value == "", F.array().cast("array<string>")).otherwise(parts)


def implode(values: Column | str, glue: str) -> Column:
    return F.array_join(_col(values), glue)


def same_text(a: Column | str, b: Column | str) -> Column:
    """Case-insensitive equality."""
    return F.lower(_col(a)) == F.lower(_col(b))


def prefix_number(value: Column | str, prefixes: Sequence[str]) -> Column:
    """1-based number of the first prefix the text starts with, ignoring case; 0 for none."""
    text = F.lower(_col(value))
    out = F.lit(0)
    for number in range(len(prefixes), 0, -1):
        out = F.when(F.startswith(text, F.lit(prefixes[number - 1].lower())), number).otherwise(out)
    return out


def first_of(value: Column | str, needles: Sequence[str]) -> Column:
    """1-based position of the first occurrence of any needle, ignoring case; 0 for none."""
    pattern = "(?i)" + "|".join(_quote(n) for n in needles)
    return F.regexp_instr(_col(value), F.lit(pattern))


def first_char_of(value: Column | str, chars: str) -> Column:
    """1-based position of the first character out of ``chars``; 0 for none."""
    return F.regexp_instr(_col(value), F.lit("[" + "".join(_quote(c) for c in chars) + "]"))


def _quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}-])", r"\\\1", text)


def parse_bytes(value: Column | str, default: Column | int) -> Column:
    """``4K`` → 4096; the first number in the text counts, without one, or beyond 64 bits, the default applies."""
    value = _col(value)
    pattern = r"(\d+)\s*(G|M|K|B)?"
    number = F.regexp_extract(value, pattern, 1).try_cast("bigint")
    unit = F.regexp_extract(value, pattern, 2)
    factor = F.lit(1).cast("bigint")
    for name, shift in BYTE_SHIFT.items():
        factor = F.when(unit == name, F.lit(1 << shift).cast("bigint")).otherwise(factor)
    default = F.lit(default) if isinstance(default, int) else default
    return F.coalesce(F.try_multiply(number, factor), default.cast("bigint"))


def parse_period(value: Column | str) -> Column:
    """``1h 2m 3s`` → 3723 seconds; units in this order from the start of the text, else (or beyond 64 bits) 0."""
    value = _col(value)
    pattern = "^" + "".join(rf"(?:\s*(\d+)\s*{unit})?" for unit in PERIOD_UNITS)
    total = F.lit(0).cast("bigint")
    for group, seconds in enumerate(PERIOD_UNITS.values(), start=1):
        part = F.regexp_extract(value, pattern, group).try_cast("bigint")
        total = F.try_add(total, F.try_multiply(F.coalesce(part, F.lit(0).cast("bigint")), F.lit(seconds).cast("bigint")))
    return F.coalesce(total, F.lit(0).cast("bigint"))


def range_bounds(value: Column | str) -> Column:
    """``2,3-8`` → intervals ``(low, high)`` in the order of the text; an open range ``5-`` means 5, an empty one is left out."""

    def bounds(part: Column) -> Column:
        ends = F.split(part, "-")
        low = F.trim(F.get(ends, 0)).try_cast("bigint")
        high = F.coalesce(F.trim(F.get(ends, 1)).try_cast("bigint"), low)
        return F.struct(low.alias("low"), high.alias("high"))

    return F.filter(F.transform(F.split(_col(value), ","), bounds), lambda r: r["low"] <= r["high"])


def expand_ranges(value: Column | str) -> Column:
    """``2,3-8`` → sorted distinct numbers. The result is as long as the ranges are wide; to test numbers
    against wide ranges use ``range_bounds``."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(range_bounds(value), lambda r: F.sequence(r["low"], r["high"])))))


def range_except(allowed: Column | str, excluded: Column | str, modulo: Column | int) -> Column:
    """Allowed numbers modulo ``n`` without the excluded ones; no allowed numbers means all of 0..n-1."""
    n = (F.lit(modulo) if isinstance(modulo, int) else modulo).cast("bigint")
    listed, barred = range_bounds(allowed), range_bounds(excluded)

    def chosen(v: Column) -> Column:
        # Some number of the range leaves v when divided by n; the width of the range does not matter.
        hit = F.exists(listed, lambda r: F.pmod(r["high"] - v, n) <= r["high"] - r["low"])
        return ((F.size(listed) == 0) | hit) & ~F.exists(barred, lambda r: (r["low"] <= v) & (v <= r["high"]))

    return F.filter(F.sequence(F.lit(0).cast("bigint"), n - 1), chosen)


def format_ipv4(address: Column | str) -> Column:
    address = _col(address).cast("bigint")
    octets = [F.shiftright(address, shift).bitwiseAND(F.lit(255).cast("bigint")) for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def format_ipv6(*words: Column | str) -> Column:
    """Four 32-bit words as eight groups of four hex digits."""
    groups = []
    for word in words:
        digits = F.lpad(F.hex(_col(word).cast("bigint")), 8, "0")
        groups += [F.substring(digits, 1, 4), F.substring(digits, 5, 4)]
    return F.concat_ws(":", *groups)


def uri_scheme(uri: Column | str, separator: str = ":/") -> Column:
    return F.regexp_extract(_col(uri), rf"([\w-]+){separator}(.+)", 1)


def uri_rest(uri: Column | str, separator: str = ":/") -> Column:
    return F.regexp_extract(_col(uri), rf"([\w-]+){separator}(.+)", 2)


def telemetry_header(*micros: Column | str) -> Column:
    """``created-at=..;reading-at=..`` with unset (null) timestamps left out."""
    parts = [
        F.concat(F.lit(name + "="), _col(value).cast("string")) for name, value in zip(TELEMETRY, micros, strict=True)
    ]
    return F.concat_ws(";", *parts)


def telemetry_value(header: Column | str, name: str) -> Column:
    return F.try_element_at(F.str_to_map(_col(header), F.lit(";"), F.lit("=")), F.lit(name)).try_cast("bigint")


def option(options: Column | str, name: str, default: str | None = None) -> Column:
    """Value of a (dotted) option name in a map column, with a default."""
    return F.coalesce(F.try_element_at(_col(options), F.lit(name)), F.lit(default))
