"""URL filters by one bit-parallel automaton for all wildcard rules.

Rules are globs over a canonical URL (``.host/path``). All of them are packed into the bits of a few 64-bit words:
one bit per position of every rule, one mask of bits per byte, and two masks of bits that may keep their state
(``*`` stays within the host, ``**`` within the path). One shift and a few logical operations per byte then move
every rule at once, and numpy does so for all URLs of a batch.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no rule of a host. Repeated
rows get equal results, extra columns are ignored. For the filter's own rules an empty path is ``/``. Of several rules that fit, the longest wins, among equally
long ones a blocking rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylog.llm.common import map_slices

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` as the start of the path: fits the host, its subdomains, and paths that start so."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


@dataclass(frozen=True)
class Glob:
    """A wildcard rule of the caller: ``*`` any characters but ``/``, ``**`` any characters, ``?`` one but ``/``."""

    glob: str
    verdict: str


# The host rules that are asked for.
HOST_RULES = (
    Rule("net", "/", BLOCK), Rule("example.net", "/en/", ALLOW), Rule("example.com", "/de/", BLOCK), Rule("org", "/fr/", ALLOW),
)
# The filter's own rules, for URLs that no host rule fits.
OWN_RULES = tuple(
    Glob(g, BLOCK)
    for word in ("casino", "poker", "pills", "porn", "xxx", "viagra", "warez", "torrent")
    for g in (f"*.{word}.*/**", f"*.{word}-*/**", f"*-{word}.*/**", f"*-{word}-*/**")
)


class Automaton:
    """Shift-And over all globs: one run of bits per glob, a start bit in front of each."""

    def __init__(self, globs: Sequence[str]):
        steps = [self._steps(g) for g in globs]
        bits = sum(len(s) + 1 for s in steps)
        self.words = max(1, -(-bits // 64))
        match = np.zeros((256, self.words), np.uint64)
        stay = np.zeros((256, self.words), np.uint64)
        start = np.zeros(self.words, np.uint64)
        self.ends = []
        at = 0

        def put(mask, bit):
            mask[..., bit // 64] |= np.uint64(1 << (bit % 64))

        slash = ord("/")
        others = [c for c in range(256) if c != slash]
        for run in steps:
            put(start, at)
            for kind, byte in run:
                if kind == "byte":
                    at += 1
                    put(match[byte], at)
                elif kind == "one":
                    at += 1
                    for c in others:
                        put(match[c], at)
                else:  # the state before stays on these bytes
                    for c in others if kind == "host" else range(256):
                        put(stay[c], at)
            self.ends.append(at)
            at += 1
        self.match, self.stay, self.start = match, stay, start

    @staticmethod
    def _steps(glob: str) -> list[tuple[str, int]]:
        out, raw, i = [], glob.encode(), 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                out.append(("any", 0))
                i += 2
                continue
            out.append({42: ("host", 0), 63: ("one", 0)}.get(raw[i], ("byte", raw[i])))
            i += 1
        return out

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text and glob whether the whole text fits."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        one = np.uint64(1)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # texts longer than t come first
            byte = flat[starts[:live] + t]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.match[byte]) | (now & self.stay[byte])
        out = np.zeros((len(texts), len(self.ends)), bool)
        for k, bit in enumerate(self.ends):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return out


def canonical(host: str, path: str) -> bytes:
    return f".{host}{path}".encode("utf-8", "surrogatepass")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = HOST_RULES, own: Sequence[Glob] = OWN_RULES, default: str = ALLOW,
) -> DataFrame:
    """``page_id, host, path, rule, own_rule, verdict`` for every row."""
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    rest = F.when(F.col("url").isNotNull() & F.col("url").contains("://"), rest).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    rows = pages.select("page_id", rest.alias("_rest")).select("page_id", host.alias("host"), path.alias("path"))
    rules, own = tuple(rules), tuple(own)
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), rules[k].verdict != BLOCK))

    def work():
        automaton = Automaton([r.glob for r in rules] + [g.glob for g in own])

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            hosts, paths = part.column("host").to_pylist(), part.column("path").to_pylist()
            fits = automaton.run([canonical(h, p) for h, p in zip(hosts, paths, strict=True)])
            bare = [i for i in range(len(hosts)) if hosts[i] and not paths[i]]
            if bare:
                fits[bare, len(rules) :] = automaton.run([canonical(hosts[i], "/") for i in bare])[:, len(rules) :]
            rule: list = [None] * len(hosts)
            verdict: list = [default] * len(hosts)
            mine: list = [None] * len(hosts)
            for i in np.flatnonzero(fits.any(axis=1)):
                row = fits[i]
                k = next((k for k in ranked if row[k]), None)
                # Of the filter's own rules the first that fits decides.
                j = next((j for j in range(len(own)) if row[len(rules) + j]), None)
                if k is not None:
                    rule[i], verdict[i] = rules[k].name, rules[k].verdict
                elif j is not None:
                    mine[i], verdict[i] = own[j].glob, own[j].verdict
            return pa.record_batch([
                part.column("page_id"), part.column("host"), part.column("path"), pa.array(rule, pa.string()),
                pa.array(mine, pa.string()), pa.array(verdict, pa.string()),
            ], ["page_id", "host", "path", "rule", "own_rule", "verdict"])

        return step

    schema = "page_id bigint, host string, path string, rule string, own_rule string, verdict string"
    return map_slices(rows, "path", work, schema)
