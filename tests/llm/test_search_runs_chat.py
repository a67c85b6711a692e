"""Ranked search, periodic runs and chat formatting against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relaylog.llm import chat_format, periodic_runs, ranked_search
from relaylog.llm.queries import QUERIES, PLANTED_TURNS, planted_periods, table, vocabulary

# --- periodic runs ---


def plain_runs(words):
    """All runs by comparing the words with themselves, shifted by every period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(12, 2 * q):
                found.setdefault((start, length), q)
            i += i == start
    return sorted((s, length, q) for (s, length), q in found.items())


def found_runs(texts):
    code = np.array([w for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for text, *run in zip(*(c.tolist() for c in periodic_runs.runs(code, np.array([len(t) for t in texts]))), strict=True):
        out[text].append(tuple(run))
    return out


words = st.one_of(
    st.lists(st.integers(0, 2), max_size=80),
    st.builds(lambda head, body, times, tail: head + body * times + tail, *[st.lists(st.integers(0, 3), min_size=1, max_size=9)] * 2,
              st.integers(2, 9), st.lists(st.integers(0, 3), max_size=9)),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_runs_equal_plain_ones(texts):
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_long_periodic_and_repetitive_texts():
    unit = [1, 2, 3]
    assert found_runs([unit * 20_000]) == [[(0, 60_000, 3)]]
    rng = random.Random(3)
    passage = list(range(20))
    apart = [w for _ in range(500) for w in [rng.randint(100, 10**6), *passage]]
    assert found_runs([apart]) == [[]]
    rows = [w for _ in range(40) for w in unit * 6 + [rng.randint(10, 10**6)]]
    assert found_runs([rows]) == [plain_runs(rows)]


def plain_digest(doc_id, text):
    split = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(split)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            split = [split[i] if i < a else split[a + (i - a) % p] for i in range(n)]
    found = plain_runs(split)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    kept = [w for i, w in enumerate(split) if not any(s + q <= i < s + length for s, length, q in found)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(kept)),
    )


def test_run_query_equals_plain_version(spark, tiny):
    rows = QUERIES["op12_periodic_runs"](spark, tiny).collect()
    texts = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    assert len(rows) == len(texts)
    short = [r for r in rows if len((texts[r.doc_id] or "").split()) <= 800]
    assert len(short) > 100 and any(r.n_runs for r in short)
    for r in short:
        got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        assert got == plain_digest(r.doc_id, texts[r.doc_id]), r.doc_id


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "a b c " * 5 + "y"), (None, None), (3, " \n"), (3, "a b " * 12)], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.start, r.length, r.period) for r in periodic_runs.periodic_runs(docs).collect())
    assert found == [(1, 1, 15, 3), (3, 0, 12, 1)]
    texts = {(r.doc_id, r.text) for r in periodic_runs.collapse_runs(docs).collect()}
    assert texts == {(1, "x a b c y"), (None, ""), (3, ""), (3, "a b")}


# --- ranked search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plain_ranks(docs, items, k):
    split = [(i, terms_of(t)) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(w for _, t in split for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in split:
            tf, score = Counter(t), 0
            for w in set(terms_of(text)) & set(tf):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * (1_000_000_000 * tf[w] // (1000 * tf[w] + 20 * (50 + 50 * len(t) * n_docs // length)))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:k], 1)]
    return out


def ranks(spark, docs, items, k, **options):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return [tuple(r) for r in ranked_search.rank_documents(docs, items, k, **options).collect()]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rare = [f"w{i}" for i in range(300)]
    return [(i, " ".join(rng.choices(["the", "of", "Ä", *rng.sample(rare, 8)], k=rng.randint(1, 60)))) for i in range(900)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}])
def test_ranks_equal_plain_ones(spark, corpus, options):
    items = [(i, text) for i, (_, text) in enumerate(corpus[::60])]
    assert sorted(ranks(spark, corpus, items, 7, **options)) == sorted(plain_ranks(corpus, items, 7))


def test_small_shards_find_the_same(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(2)
    items = ranked_search.collected(ranked_search.item_terms(spark.createDataFrame(corpus[:9], "item_id bigint, text string")))
    indexed = ranked_search.index(docs, items.vocabulary)
    known = ranked_search.statistics(indexed, len(items.vocabulary))
    found = [
        {tuple(r) for r in ranked_search.ranked(ranked_search.search_index(indexed, items, known, 5, shard_postings=n), 5).collect()}
        for n in (40, 1000, 10**6)
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) == 45


def test_reading_ends_early_and_stays_exact():
    """Most of a long list of small impacts is left unread once the best are known."""
    rng = np.random.default_rng(1)
    rows, many = 20_000, ranked_search.Statistics(20_000, 200_000, np.array([10, 19_000]))
    term = np.concatenate([np.zeros(10, np.int64), np.ones(19_000, np.int64)])
    row = np.concatenate([np.arange(10), rng.permutation(rows)[:19_000]])
    shard = ranked_search.Shard(np.full(rows, 10), row, term, np.ones(len(row), np.int64), many, many.weights())
    shard.row.flags.writeable = shard.impact.flags.writeable = False
    got, score = shard.best(np.array([0, 1]), 3, 0)
    total = np.bincount(shard.row, shard.impact.astype(float), rows)
    order = np.lexsort((np.arange(rows), -total))[:3]
    assert set(order) <= set(got.tolist()) and (total[got] == score).all() and set(got.tolist()) <= set(range(10))


def test_ties_nulls_and_repeated_rows(spark):
    docs = [(5, "b a"), (2, "a b"), (None, "a b"), (2, "a b"), (9, None), (8, ""), (7, "c c c")] + [(100 + i, "zz") for i in range(9)]
    items = [(1, "A, b!"), (2, None), (3, "absent"), (4, ""), (None, "c"), (6, "a"), (6, "c")]
    got = ranks(spark, docs, items, 3)
    assert sorted(got, key=str) == sorted(plain_ranks(docs, [(1, "a b"), (None, "c"), (6, "a c")], 3), key=str)
    assert [r[2] for r in sorted(got, key=lambda r: r[1]) if r[0] == 1] == [2, 2, 5]
    assert ranks(spark, [], items, 3) == ranks(spark, docs, [], 3) == []


# --- chat formatting ---

pieces = st.lists(st.sampled_from([*chat_format.CONTROLS, "[", "<", "\\", "/s>", "INST]", "a", "é😀", " ", "\n"]), max_size=9).map("".join)


@pytest.fixture(scope="module")
def codec():
    return chat_format.Codec(vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), pieces), pieces), max_size=6))
def test_turns_come_back(codec, turns):
    ids, loss, n_tokens = chat_format.assemble(turns, codec)
    assert len(ids) == len(loss) == n_tokens.sum()
    back = list(chat_format.parse(ids, loss, codec))
    assert [(role, text) for role, text, _, _ in back] == turns
    assert [scored for _, _, scored, _ in back] == [text if role == "assistant" else "" for role, text in turns]
    for (role, text), shown in zip(turns, (b[3] for b in back), strict=True):
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROLS)
        assert chat_format.escape(text) in shown and (role != "assistant" or shown.count("</s>") == 1)


def test_no_token_crosses_a_border(codec):
    ids, loss, _ = chat_format.assemble([("assistant", "</s>[INST] ok [/INST]"), ("user", "x")], codec)
    reserved = np.flatnonzero(ids >= codec.base)
    assert (ids[reserved] - codec.base).tolist() == [chat_format.END, chat_format.INST, chat_format.END_INST]
    assert loss.tolist() == [True] * int(reserved[0]) + [False] * (len(ids) - int(reserved[0]))
    with pytest.raises(ValueError):
        list(chat_format.parse(ids[:-1], loss[:-1], codec))


def test_planted_conversation(spark, tiny):
    row = QUERIES["op13_chat_format"](spark, tiny).filter("conv_id = -7").first()
    text = PLANTED_TURNS[0][3]
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in PLANTED_TURNS).encode()).hexdigest()


def test_odd_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, None, "user", None), (1, 1, "assistant", "b"), (1, 0, None, "x"), (None, 0, "user", "n" * 50_000), (2, 0, "assistant", "")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, ids string").repartition(3)
    made = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.read_back(chat_format.format_turns(turns, vocabulary()), vocabulary())).collect()}
    assert made[1].turns_sha256 == hashlib.sha256(b"user\n\n\nx\nassistant\nb\nassistant\nb\n").hexdigest()
    assert (made[1].n_turns, made[1].loss_chars, made[1].formatted_chars) == (4, 2, 13 + 1 + 19 + 10)
    assert made[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert made[2].loss_chars == 0 and made[2].formatted_chars == 4 and made[None].formatted_chars == 50_013
    assert chat_format.conversation_digests(chat_format.read_back(chat_format.format_turns(turns.limit(0), vocabulary()), vocabulary())).count() == 0


# --- all three on odd documents ---

WIDE = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, terms string, start int, length int, n int"


def test_odd_documents(spark):
    texts = [(1, "the thing " * 9), (1, "the thing " * 9), (2, None), (3, ""), (None, " \n\t "), (7, "the word of " * 60_000), (8, "x" * 50_000)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, 0.5, "clash", 5, 3, 2) for i, t in texts], WIDE).repartition(3)
    made = periodic_runs.run_digests(docs, planted_periods).collect()
    assert sorted((r.doc_id or 0, r.n_runs) for r in made) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 0), (7, 1), (8, 0)]
    assert len({r for r in made if r.doc_id == 1}) == 1
    assert periodic_runs.run_digests(docs.limit(0)).count() == 0
    items = spark.createDataFrame([(1, "word", 7)], "item_id bigint, text string, rank int")
    assert [r.doc_id for r in ranked_search.rank_documents(docs, items, 5).collect()] == [7]


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_chat_format"])
def test_sql(spark, tiny, name):
    import duckdb

    from relaylog.llm.queries import ORACLE

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = QUERIES[name](spark, tiny)
    result = con.execute(ORACLE[name])
    place = [df.columns.index(c[0]) for c in result.description]
    assert sorted(str([r[i] for i in place]) for r in df.collect()) == sorted(str(list(r)) for r in result.fetchall())
