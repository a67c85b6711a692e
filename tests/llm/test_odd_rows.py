"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relaylog.llm import (
    byte_bpe, dart_minhash, decontaminate, host_rules, html_extract, kd_shards, language_id, quality_gam, toxicity_crf, url_automaton,
)
from relaylog.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard string, h bigint, node int, ids string"
LONG = "the word of " * 60_000
ROWS = [
    (1, "the thing was here and there", "en", "a"), (1, "the thing was here and there", "en", "a"), (2, None, None, None),
    (3, "", "en", "a"), (None, " \n\t ", None, "b"), (None, "the thing was here and there", "en", None), (7, LONG, "en", "a"),
    (8, "x" * 50_000, "en", "b"), (9, "12 34 !!", "en", "b"), (10, "\x00 null byte", "en", "b"),
]
EMPTY = toxicity_crf.ToxicityModel(np.zeros(toxicity_crf.BUCKETS, np.float32), -5.0, np.ones((2, 2)), np.array([-3.0, 1, 1]))
LANGUAGES = language_id.LanguageModel(("de", "en"), np.ones((64, 2), np.float32), 1.0, 0.1)
QUALITY = quality_gam.fit(np.random.default_rng(1).random((40, len(quality_gam.FEATURES))), np.arange(40) % 2.0)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, src, len(t or ""), 0.5, "clash", 5, 3, "clash") for i, t, lang, src in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the word of the word of the word of the word"), (2, None), (3, ""), (4, "absent item text")], "item_id bigint, text string")


OPERATORS = {
    "toxicity": lambda d, b: toxicity_crf.score_toxicity(d, EMPTY),
    "language": lambda d, b: language_id.identify(d, LANGUAGES),
    "near": lambda d, b: dart_minhash.near_duplicates(d),
    "rules": lambda d, b: host_rules.judge(d),
    "bpe": lambda d, b: byte_bpe.encode(d, vocabulary(), decoded=True),
    "shards": lambda d, b: kd_shards.shard(d, 4),
    "quality": lambda d, b: quality_gam.score_quality(d, QUALITY),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, nothing, items, name):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in OPERATORS[name](docs, items).select("doc_id").collect())
    assert got == sorted((i is None, i or 0) for i, *_ in ROWS)
    assert OPERATORS[name](nothing, items).count() == 0


def test_repeated_rows_get_equal_results(docs, items):
    for name in ("toxicity", "language", "near", "rules", "quality", "bpe"):
        rows = OPERATORS[name](docs, items).filter("doc_id = 1").collect()
        assert len(rows) == 2 and rows[0] == rows[1], name


def test_defined_values(docs, items):
    near = {r.doc_id: r for r in dart_minhash.near_duplicates(docs).filter("doc_id is not null").collect()}
    assert near[1].class_id == 1 and near[1].class_size == 3
    assert near[2].class_size == near[3].class_size == 1
    lang = {r.doc_id: r for r in language_id.identify(docs, LANGUAGES).collect()}
    assert [lang[i].lang_pred for i in (2, 3, 9)] == ["und"] * 3 and lang[2].score == 0 and not lang[2].accepted
    rules = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    assert rules[2].n_words == 0 and rules[2].base_failed and not rules[2].kept
    assert rules[7].n_repeat_words == rules[7].n_words == 180_000
    tokens = {r.doc_id: r for r in byte_bpe.encode(docs, vocabulary(), decoded=True).collect()}
    assert tokens[2].ids == tokens[3].ids == b"" and bytes(tokens[7].decoded) == LONG.encode()
    leaks = decontaminate.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in leaks] == [(7, 1, 0)]
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    shards = kd_shards.shard(docs, 4).collect()
    assert {r.size for r in shards if r.doc_id in (2, 3)} == {1}
    assert len({r.shard for r in shards if r.size == 29}) == 1


def test_rows_without_words_all_stay(spark):
    texts = [None, "", "\x1c\x1d \x1e\x1f", "\x1c\x1d \x1e\x1f", "\x85\u2003\u3000", "\u200b", "a word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in dart_minhash.keep_representatives(docs).collect()) == list(range(len(texts)))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_rows(spark, docs, nothing, tiny, stage):
    kept = stage(spark, docs, tiny)
    assert kept.columns == docs.columns
    assert all(r.shard == "clash" and r.score == 0.5 for r in kept.select("shard", "score").collect())
    assert stage(spark, nothing, tiny).count() == 0


def test_last_stage(spark, docs, nothing, tiny):
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, tiny).count() == len(ROWS) and last(spark, nothing, tiny).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "no scheme", "<p>"), (4, "http://A.net?x", "text " * 50_000), (4, "http://A.net?x", "text " * 50_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    made = html_extract.extract_pages(pages).collect()
    assert len(made) == 5 and [r.text for r in made if r.page_id in (1, 2, None)] == [""] * 3
    judged = {r.page_id: r for r in url_automaton.judge_urls(pages).collect()}
    assert (judged[1].host, judged[1].path, judged[1].verdict) == ("", "", "allow")
    assert (judged[4].host, judged[4].path, judged[4].rule) == ("a.net", "", None)
    none = pages.limit(0)
    assert html_extract.extract_pages(none).count() == url_automaton.judge_urls(none).count() == 0


def test_models_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity_crf.score_toxicity(docs, toxicity_crf.train(docs, labels)).agg(F.max("score")).first()[0] < 1e-6
    assert quality_gam.score_quality(docs, quality_gam.train(docs, labels)).filter("score != 0.5").count() == 0
    model = language_id.train(nothing)
    assert language_id.identify(docs, model).filter("lang_pred != 'und'").count() == 0
    assert language_id.keep_identified(docs, model).count() == len(ROWS)
