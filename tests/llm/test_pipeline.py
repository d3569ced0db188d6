"""The pipeline keeps what its stages' operators say, with the columns of documents, on the smallest tables."""

import corpus_pipeline
from ledgerloom.llm import decontam, langid, simhash
from ledgerloom.llm._common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf).persist()
        assert docs.columns == table(spark, sf, "documents").columns and docs.dtypes == before.dtypes
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        seen[name] = (before, docs, ids)
    before, after, ids = seen["language_id"]
    model = langid.fit(langid.learnable(before))
    assert ids == {r.doc_id for r in before.collect() if model.predict(r.text)[2]}
    assert {r.doc_id for r in before.where("lang is not null and length(text) > 40").collect()} <= ids
    before, after, ids = seen["near_dedup"]
    assert ids == {r.component_id for r in simhash.near_copies(before).collect()}
    before, after, ids = seen["decontaminate"]
    assert ids == {r.doc_id for r in decontam.decontaminate(before, table(spark, sf, "benchmark")).where("n_hit = 0").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    spark.catalog.clearCache()


def test_near_dedup_builds_no_hash_tables_in_the_driver(spark, monkeypatch):
    key = "spark.sql.autoBroadcastJoinThreshold"
    docs, before, plans = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string"), spark.conf.get(key), []

    def first_copies(docs):
        joined = docs.join(spark.range(3).withColumnRenamed("id", "doc_id"), "doc_id")
        plans.append(joined._jdf.queryExecution().executedPlan().toString())
        return docs.select("doc_id", corpus_pipeline.F.xxhash64("text"))

    monkeypatch.setattr(corpus_pipeline.simhash, "first_copies", first_copies)
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 2
    assert plans and "Broadcast" not in plans[0]
    assert spark.conf.get(key) == before
