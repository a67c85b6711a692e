"""Operators against plain versions."""

import base64
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relaylog.llm import byte_bpe, components, dart_minhash, decontaminate, host_rules, html_extract, kd_shards, url_automaton
from relaylog.llm.queries import QUERIES, table, vocabulary

# --- byte-level BPE ---


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(vocabulary())


@pytest.fixture(scope="module")
def reference():
    lines = vocabulary().lines.splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aab the\n 'sé😀́"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_ids_equal_tiktoken(encoder, reference, texts):
    ids = encoder(texts)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == [reference.encode_ordinary(t) for t in texts]
    assert [encoder.merger.decode(i) for i in ids] == [t.encode() for t in texts]


def test_long_pieces(encoder, reference):
    texts = ["a" * 5000, "abcd" * 2000, "\n" * 3000, "é" * 1500]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_full_cache_changes_nothing(reference):
    small = byte_bpe.Encoder(vocabulary(), cache=3)
    texts = ["zyxw vutsr qponm", "lkjih gfedc", "zyxw"]
    assert [np.frombuffer(small([t])[0], "<u4").tolist() for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_encode_then_decode(spark, tiny):
    docs = table(spark, tiny, "documents")
    back = byte_bpe.decode(byte_bpe.encode(docs, vocabulary()), vocabulary())
    assert back.join(docs, "doc_id").filter(F.col("decoded").cast("string") != F.col("text")).count() == 0


# --- decontamination ---


def edits(item, text):
    """Smallest distance of the item to a part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return min(row)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=60))
def test_bit_parallel_distance(item, text):
    masks = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    assert decontaminate.best_match(item, text, masks)[0] == edits(item, text)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_every_match_within_budget_is_found(data):
    item = decontaminate.normal(data.draw(st.text("abcd ", min_size=40, max_size=90)))
    if len(item) < 32:
        return
    copy = list(item)
    for _ in range(data.draw(st.integers(0, decontaminate.budget_of(item)))):
        at = data.draw(st.integers(0, len(copy) - 1))
        kind = data.draw(st.sampled_from("rid"))
        copy[at : at + (kind != "i")] = [] if kind == "d" else [data.draw(st.sampled_from("wxyz"))]
    text = decontaminate.normal("qqq rr " + "".join(copy) + " ss tt")
    hits = decontaminate.Matcher([(5, item)]).hits(text)
    best = edits(item, text)
    assert bool(hits) == (best <= decontaminate.budget_of(item))
    assert not hits or hits[0][1] == best


def test_blocks_change_nothing(spark, tiny):
    docs, items = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    one = decontaminate.find_leaks(docs, items)
    many = decontaminate.find_leaks(docs, items, block_bytes=1000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    plain = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if decontaminate.normal(i.text) in decontaminate.normal(d.text)}
    assert plain == {(r.doc_id, r.item_id) for r in one.filter("distance = 0").collect()} and plain


# --- URL filters ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab*?/.", max_size=6), min_size=1, max_size=30), st.lists(st.text("ab/.", max_size=9), min_size=1, max_size=4))
def test_automaton_equals_expressions(globs, texts):
    def plain(glob, text):
        parts = re.split(r"(\*\*|\*|\?)", glob)
        return re.fullmatch("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts), text, re.S) is not None

    got = url_automaton.Automaton(globs).run([t.encode() for t in texts])
    assert got.tolist() == [[plain(g, t) for g in globs] for t in texts]


def test_rules(spark):
    urls = {
        "http://net/": ("net/", "block"), "https://A.Net/x?y": ("net/", "block"), "http://net": (None, "allow"), "http://xnet/": (None, "allow"),
        "http://m.example.net/en/1": ("example.net/en/", "allow"), "http://example.net/EN/1": ("net/", "block"),
        "http://example.com/de/": ("example.com/de/", "block"), "http://a.org/fr/#x": ("org/fr/", "allow"), "http://a.org/x.net/": (None, "allow"),
        "http://x.casino.com/a": (None, "block"), "http://x.com/casino": (None, "allow"), "nothing": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_automaton.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())


def test_own_rules_need_no_path(spark):
    urls = {"http://x.casino.com": "block", "http://x.casino.com?q=1": "block", "http://casino-x.com#a": "block", "http://x.com?casino.": "allow", "http://net": "allow"}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.path, r.rule, r.verdict) for r in url_automaton.judge_urls(pages).collect()}
    assert [got[i] for i in range(len(urls))] == [("", None, v) for v in urls.values()]


# --- quality rules ---


def test_counts_by_hand(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(-1, "a b c a b c x\n\n\x0bq\n\x0bq", "s"), (-2, "u u u u", None), (-3, "a b c", "s")], docs.schema)
    docs = docs.unionByName(extra)
    got = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    for row in docs.collect():
        words = [w for w in re.split("[\x20\x09-\x0d]+", row.text) if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in row.text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in row.text), len(lines) - len(set(lines)), len(covered))
        mine = got[row.doc_id]
        assert (mine.n_words, mine.word_chars, mine.n_symbols, mine.n_dup_lines, mine.n_repeat_words) == want


def test_bad_hosts_lose_their_documents_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, good if i % 20 else bad, f"h{i % 5}") for i in range(2000)]
    rows += [(10_000 + i, bad if i < 180 else good, "worst") for i in range(200)] + [(20_000, bad, "new"), (20_001, good, "new")]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert not any(kept[10_000 + i] for i in range(200)) and kept[1] and kept[20_001]


# --- near copies ---


def brute_classes(texts):
    sets = {i: Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, t in texts.items() if (w := (t or "").lower().split())}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            shared = sum((sets[i] & sets[j]).values())
            if shared >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_classes_equal_brute_force(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    base = " ".join(f"v{i * 7 % 311}" for i in range(300))
    planted = [(9000 + k, " ".join(w if (i + k) % 97 else f"e{k}x{i}" for i, w in enumerate(base.split()))) for k in range(40)]
    planted += [(9100, "one two"), (9101, "One  two"), (9102, None), (9103, "")]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    want = brute_classes({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert got == want
    kept = [r.doc_id for r in dart_minhash.keep_representatives(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def spread_group(seed, versions, copies, words=300):
    """Edited versions of one text, each with own near copies, as texts by number."""
    rng = np.random.default_rng(seed)

    def edited(text, low, high):
        out = list(text)
        for at in rng.choice(words, rng.integers(low, high + 1), replace=False):
            out[at] = f"e{rng.integers(1 << 40)}"
        return out

    base = [f"b{i}" for i in range(words)]
    texts = []
    for _ in range(versions):
        version = edited(base, 4, 8)
        texts += [version, *(edited(version, 1, 3) for _ in range(copies))]
    return {i: " ".join(texts[k]) for i, k in enumerate(rng.permutation(len(texts)))}


def true_links(texts):
    """All pairs of texts of at least 0.8, from the shingles as tuples."""
    sets = [Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    column = {s: i for i, s in enumerate({(x, k) for c in sets for x, n in c.items() for k in range(n)})}
    row = [i for i, c in enumerate(sets) for n in c.values() for _ in range(n)]
    place = [column[x, k] for c in sets for x, n in c.items() for k in range(n)]
    size, shared = np.bincount(row), np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    row, place = np.array(row)[order], np.array(place)[order]
    for first in range(0, len(column), 4096):
        a, b = np.searchsorted(place, [first, first + 4096])
        there = np.zeros((len(sets), 4096), np.float32)
        there[row[a:b], place[a:b] - first] = 1
        shared += there @ there.T
    near = 9 * shared >= 4 * (size[:, None] + size[None, :])
    return np.argwhere(np.triu(near, 1)).tolist()


def test_no_link_is_lost_in_a_spread_group(spark):
    """A group like that of the check's hard table: 2,100 versions of one text, most in components of their own."""
    texts = spread_group(3, 700, 2)
    links = true_links(list(texts.values()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 1500 and found >= 0.99 * len(links) and 300 < len(set(got.values())) < 1000
    assert found == len(links)


def test_units_give_a_forest_of_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.uniform(0, 0.25), rng.integers(0, 1 << 32, 60), base)).astype("<u4") for _ in range(40)]
    root = np.sort(rng.integers(0, 12, 40))
    own = np.repeat([0, 1], 20)
    for left, right in ((own == 0, own == 1), (own >= 0, own >= 0)):
        i, j = dart_minhash.unit_links(sets, root, left, right)
        assert len(i) < 12 and (left[i] & right[j] | left[j] & right[i]).all()
        got = components_of(zip(root[i].tolist(), root[j].tolist()))
        near = [(a, b) for a in np.flatnonzero(left) for b in np.flatnonzero(right) if root[a] != root[b]
                and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        assert near and got == components_of((int(root[a]), int(root[b])) for a, b in near)
    nobody = np.zeros(40, bool)
    assert not len(dart_minhash.unit_links(sets, root, nobody, ~nobody)[0]) and not len(dart_minhash.unit_links([], root[:0], nobody[:0], nobody[:0])[0])


def components_of(links):
    parts = []
    for a, b in links:
        met = [p for p in parts if a in p or b in p]
        parts = [p for p in parts if p not in met] + [set().union({a, b}, *met)]
    return sorted(sorted(p) for p in parts)


def test_blocks_of_any_size_give_the_same_classes(spark, monkeypatch):
    texts = spread_group(5, 60, 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = {(r.doc_id, r.class_id) for r in dart_minhash.near_duplicates(docs).collect()}
    for name, value in (("BLOCK", 7), ("PAIRS_PER_HUB", 3), ("BROADCAST_NODES", 2), ("HOT_KEYS", 3), ("COLUMNS", 50)):
        monkeypatch.setattr(dart_minhash, name, value)
    assert {(r.doc_id, r.class_id) for r in dart_minhash.near_duplicates(docs).collect()} == want


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    element = np.arange(60, dtype=np.uint64) * np.uint64(7919)
    a, b = rng.integers(0, 9, 60) * 1.0, rng.integers(0, 9, 60) * 1.0
    owner = np.repeat([0, 1], 60)
    ranks = dart_minhash.dart_signatures(owner, np.concatenate([element, element]), np.concatenate([a, b]), 2, k=1500)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((ranks[0] == ranks[1]).mean() - true) < 0.06 and np.isfinite(ranks).all()


def test_components_of_odd_links(spark):
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    links = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None)], "a bigint, b bigint")
    assert {r.node: r.root for r in components.components(links).collect()} == {1: 1, 2: 1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


# --- shards ---


def test_shards_are_even_and_keep_copies_together(spark, small):
    rows = kd_shards.shard(table(spark, small, "documents"), 16).collect()
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.size, r.text_crc32].add(r.shard)
    largest = max(r.size for r in rows)
    assert sorted(size) == list(range(16)) and max(size.values()) - min(size.values()) <= largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_a_heavy_group_stays_whole(spark):
    rows = [(i, "copy of one text") for i in range(300)] + [(1000 + i, f"own text number {i}") for i in range(3000)]
    got = kd_shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert len({r.shard for r in got if r.doc_id < 1000}) == 1
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values())


# --- main text ---

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, as all do, on this page.</div>
<div id=wrap><article><h2>Title &amp; more</h2><p>First, a sentence that is long enough, with commas.<p>Second &lt;b&gt; one,
 with<br>a break&nbsp;and <a href="/x">a link</a>.</p><ul><li>item one<li>item two</ul><!-- <p>hidden</p> --><form><input><p>Sign up</p></form>
<div class="comments"><p>I like this article, really, a lot.</p></div></article><aside><p>Aside text, long enough, to count as prose.</p></aside></div>
<div class="ad">Buy, buy, buy now, this is an advert of some length.</div><footer>(c)</footer></body></html>"""


def test_article():
    assert html_extract.extract(PAGE) == "Title & more\nFirst, a sentence that is long enough, with commas.\nSecond <b> one, with a break and a link.\nitem one\nitem two"


def test_page_without_article_element():
    text = "This paragraph has commas, clauses, and enough words to count as prose. " * 3
    page = f"<body><div class=menu><a href=a>one</a></div><div><h1>Head</h1><p>{text}</p><p>{text}</p></div><div><ul><li><a href=b>link text one</a></li></ul></div>"
    assert html_extract.extract(page) == "\n".join(["Head", text.strip(), text.strip()])


@pytest.mark.parametrize("wrapper", [
    "div class='layout has-sidebar'", "div class='overflow-hidden'", "div id='page' class='no-sidebar with-comments'", "section class='post related-2'",
    "div class='sidebar-left'",
])
def test_a_named_wrapper_keeps_the_article(wrapper):
    text = "This paragraph has commas, clauses, and enough words to count as prose. " * 3
    side = "<div class='sidebar'><p>Aside text, long enough, to count as prose.</p></div><div class='comments'><p>I like this, really, a lot of it.</p></div>"
    want = "\n".join(["Head", text.strip(), text.strip()])
    for inner in (f"<article><h1>Head</h1><p>{text}</p><p>{text}</p></article>", f"<div><h2>Head</h2><p>{text}</p><p>{text}</p></div>"):
        assert html_extract.extract(f"<body><{wrapper}>{inner}{side}</{wrapper.split()[0]}></body>") == want


def test_comments_of_an_article_stay_cut_even_if_longer():
    remark = "<li><article class='comment-body'><p>I like this article, really, a lot, and more.</p></article></li>"
    page = f"<body><article><h1>Head</h1><p>A short story, but one of its own.</p></article><div id='comments'><ol>{remark * 9}</ol></div></body>"
    assert html_extract.extract(page) == "Head\nA short story, but one of its own."


def test_formulas_and_fallbacks_stay():
    page = "<article><p>The sum, <math><mi>a</mi><mo>+</mo><mi>b</mi></math>, and <object data=x>its picture</object>, of two numbers.</p></article>"
    assert html_extract.extract(page) == "The sum, a+b, and its picture, of two numbers."


def test_given_pages(spark, small):
    plain = lambda h: [" ".join(__import__("html").unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.search("<article>(.*?)</article>", h, re.S)[1])]
    pages = {r.page_id: r.html for r in table(spark, small, "pages").collect()}
    for r in QUERIES["op1_html_extraction"](spark, small).collect():
        assert r.text == "\n".join(b for b in plain(pages[r.page_id]) if b) and r.n_chars == len(r.text)


PROSE = ("This paragraph has commas, clauses, and enough words to count as prose. " * 3).strip()


@pytest.mark.parametrize("around", ["%s", "<main>%s</main>", "<div><div>%s</div></div>"])
def test_sibling_articles(around):
    page = f"<article><h1>A</h1><p>A {PROSE}</p></article><article><p>B {PROSE}</p></article><article class=teaser><a href=x>{PROSE}</a></article>"
    assert html_extract.extract(f"<body>{around % page}</body>") == f"A\nA {PROSE}\nB {PROSE}"


def test_names_do_not_cut_prose_of_an_article():
    page = (
        f"<article><h1>T</h1><p class=header>Lead {PROSE}</p><div class=ad>{PROSE}</div><p>An <label>own</label> word. {PROSE}</p>"
        f"<section class=discussion><h2>Discussion</h2><p>D {PROSE}</p><div class=comments><p>C {PROSE}</p></div></section>"
        f"<div class=rail><a href=x>{PROSE}</a></div><label for=q>gone</label></article>"
    )
    assert html_extract.extract(page) == f"T\nLead {PROSE}\nAn own word. {PROSE}\nDiscussion\nD {PROSE}"


def test_ties_of_containers():
    page = f"<body><div><p>A {PROSE}</p></div><div><p>A {PROSE}</p></div></body>"
    assert html_extract.extract(page) == f"A {PROSE}\nA {PROSE}"


ODD = {
    "nested": lambda n: "<div>" * n + PROSE, "stray ends": lambda n: "<b>" * n + "</i>" * n, "unclosed": lambda n: "<a " * n,
    "cells": lambda n: "<p><table><td>" + "<div>" * n, "items": lambda n: "<ul><li><ul>" + "<div><li></li>" * n,
    "scripts": lambda n: "<script>" + "</script " * n, "quotes": lambda n: "<a t=\"" * n,
}


@pytest.mark.parametrize("name", ODD)
def test_time_grows_with_the_page(name):
    from time import process_time

    def seconds(n):
        begin = process_time()
        html_extract.extract(ODD[name](n))
        return process_time() - begin

    assert seconds(32_000) < 16 * max(seconds(4_000), 0.01)


def test_url_without_a_path(spark):
    from relaylog.llm.queries import ORACLE

    urls = ["http://x.casino.com", "http://x.casino.com?q=1", "http://x.casino.com/", "http://casino.com", "x.casino.com", "://", None, "http://a.net#x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    made = {r.page_id: tuple(r) for r in url_automaton.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()}
    con = __import__("duckdb").connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", list(enumerate(urls)))
    assert {r[0]: r for r in con.execute(ORACLE["op4_url_filters"]).fetchall()} == made
    assert made[0][4] == "block"


@pytest.mark.parametrize("name", ["op4_url_filters", "op5_quality_rules"])
def test_sql(spark, tiny, name):
    import duckdb

    from relaylog.llm.queries import ORACLE

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = QUERIES[name](spark, tiny)
    result = con.execute(ORACLE[name])
    place = [df.columns.index(c[0]) for c in result.description]
    assert sorted(str([r[i] for i in place]) for r in df.collect()) == sorted(str(list(r)) for r in result.fetchall())
