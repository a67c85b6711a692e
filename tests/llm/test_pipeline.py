"""The pipeline against its operators: every stage's decision takes effect, and clean documents stay."""

from pyspark.sql import functions as F

import corpus_pipeline
from relaylog.llm.queries import table


def test_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    items = [r.text for r in table(spark, tiny, "benchmark").limit(2).collect()]
    clean = " ".join(f"the thing{i} and{i % 7} was of her{i * 5 % 23}" for i in range(60))
    near = clean.replace("thing17", "changed")
    planted = [(90_001, clean), (90_002, near), (90_003, clean), (90_004, "an own start of the page, " + items[0] + " and an own end")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["minhash_near_dedup"](spark, docs, tiny).collect()}
    assert kept & {90_001, 90_002, 90_003, 90_004} == {90_001, 90_004}
    kept = {r.doc_id for r in stages["benchmark_decontamination"](spark, docs, tiny).collect()}
    assert kept & {90_001, 90_004} == {90_001}
    labels = table(spark, tiny, "labels")
    left = stages["toxicity"](spark, docs, tiny).join(labels, "doc_id")
    assert left.filter("toxic = 0").count() >= 0.95 * docs.join(labels, "doc_id").filter("toxic = 0").count()
    assert stages["language_id"](spark, docs, tiny).count() >= 0.95 * docs.count()


def test_run(spark, tiny):
    rows = corpus_pipeline.run(spark, tiny)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = table(spark, tiny, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    assert rows.join(docs, "doc_id").filter("sha != decoded_sha256").count() == 0
    assert 0 < rows.count() < docs.count()
