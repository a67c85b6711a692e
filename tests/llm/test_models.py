"""Models against enumeration and on held-out rows."""

from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relaylog.llm import language_id, quality_gam, toxicity_crf
from relaylog.llm.common import bounded_sample, held_out, text_blocks
from relaylog.llm.queries import QUERIES, table


def enumerated(scores, a):
    """Marginals of one chain by adding up all labellings."""
    total, on = 0.0, np.zeros(len(scores))
    for labels in product((0, 1), repeat=len(scores)):
        weight, before = 1.0, 0
        for s, y in zip(scores, labels, strict=True):
            weight *= a[before][y] * (np.exp(s) if y else 1.0)
            before = y
        total += weight
        on += weight * np.array(labels)
    return on / total


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.lists(st.floats(-4, 4), max_size=9), min_size=1, max_size=4),
    st.lists(st.floats(0.05, 3), min_size=4, max_size=4), st.integers(1, 5),
)
def test_marginals_equal_enumeration(chains, a, block):
    a = np.array(a).reshape(2, 2)
    got = toxicity_crf.forward_backward(np.array([s for c in chains for s in c]), np.array([len(c) for c in chains]), a, block)
    want = np.concatenate([enumerated(c, a) for c in chains]) if any(chains) else np.zeros(0)
    assert np.allclose(got.marginal, want, atol=1e-9)


def test_pairs_of_neighbours_add_up():
    scores, lengths, a = np.array([0.3, -1.0, 2.0, 0.1, 0.7]), np.array([3, 0, 2]), np.array([[0.7, 0.3], [0.4, 0.6]])
    chain = toxicity_crf.forward_backward(scores, lengths, a, 2, pairs=True)
    assert np.isclose(chain.pairs.sum(), 5) and np.isclose(chain.pairs[:, 1].sum(), chain.marginal.sum())


def test_word_features_do_not_depend_on_company():
    words = [f"w{i}ab" for i in range(50)] + ["", "x"]
    bucket, owner = toxicity_crf.word_features(words)
    for i, w in enumerate(words):
        assert sorted(bucket[owner == i]) == sorted(toxicity_crf.word_features([w])[0])


def test_spans():
    text = "a bad, bad day a bad"
    assert [(s["start"], s["stop"]) for s in toxicity_crf.spans_of(text, np.array([0, 0.9, 0.8, 0, 0, 0.7]))] == [(2, 10), (17, 20)]


@pytest.mark.parametrize("name,label", [("op2_toxicity", "toxic"), ("op10_quality_classifier", "quality")])
def test_held_out_accuracy_of_classifiers(spark, small, name, label):
    scored = QUERIES[name](spark, small).join(table(spark, small, "labels"), "doc_id")
    right = scored.filter("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= 0.9
    assert scored.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0


def test_held_out_accuracy_of_languages(spark, small):
    docs = table(spark, small, "documents")
    got = QUERIES["op6_language_id"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.95
    assert got.filter("accepted").count() >= 0.98 * got.count()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95
    # A score is the sum of the table entries, row by row.
    z = model.intercept + sum(t[np.sum(e <= x[7, j])] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    z += sum(t[np.sum(model.coarse[i] <= x[7, i]), np.sum(model.coarse[j] <= x[7, j])] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    assert np.isclose(model.score(x[7:8])[0], 1 / (1 + np.exp(-z)))


def test_language_averages_do_not_depend_on_order():
    model = language_id.LanguageModel(("a", "b"), np.random.default_rng(1).random((128, 2)), 1.0, 0.0)
    predict = language_id._predictor(model)
    one, two = predict(["ab cd efg", "zz"]), predict(["zz", "efg ab cd"])
    assert np.allclose(one[1], two[1][::-1])


def test_sample_is_bounded_and_spares_held_out_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("y"))
    got = bounded_sample(rows, "y", "doc_id", 100)
    assert 200 <= got.count() <= 600
    assert spark.range(1000).filter(held_out("id")).count() == sum(__import__("zlib").crc32(str(i).encode()) % 4 == 2 for i in range(1000))


def test_the_greatest_of_several_labels_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(i, 0, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality_gam, "fit", lambda x, y, **options: seen.update(y=y) or quality_gam.QualityModel.__new__(quality_gam.QualityModel))
    try:
        quality_gam.train(docs, labels)
    except AttributeError:
        pass  # the intercept of a model that was not fitted
    rows = [i for i in range(40) if not (__import__("zlib").crc32(str(i).encode()) % 4 == 2)]
    assert sorted(seen["y"].tolist()) == sorted(float(i % 2) for i in rows)


def test_long_texts_are_read_in_blocks(spark):
    texts = ["", "a " * 50, "x" * 45, None, "one two three four"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in text_blocks(rows, "text", 20).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert all(max(map(len, b)) <= 20 for i, b in got.items() if texts[i])
    assert {i: ("".join(b) if b != [None] else None) for i, b in got.items()} == dict(enumerate(texts))


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"q{i % 400}z w{i % 400}k " * 6, f"l{i % 400}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs, epochs=6)
    shown = {r.lang for r in docs.filter(~held_out("doc_id")).select("lang").distinct().collect()}
    assert set(model.languages) == shown and len(shown) > 300 and len(model.table) == 1 << 15
    known = docs.filter(F.col("lang").isin(*shown))
    assert language_id.identify(known, model).join(docs, "doc_id").filter("lang_pred = lang").count() > 0.9 * known.count()
