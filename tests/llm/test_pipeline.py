"""The pipeline's stages against their operators on a small table."""

import corpus_pipeline
from starloom.llm import minhash_dedup, quality_classifier, quality_rules
from starloom.llm.store import reach_workers

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    reach_workers(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    model = quality_classifier.fit_classifier(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_classifier.score_quality(docs, model).where("predicted = 1").collect()}
    kept = {r.doc_id for r in quality_rules.judge_quality(docs).where("kept").collect()}
    both = docs.where(docs.doc_id.isin(list(good & kept)))
    last = {r.doc_id for r in minhash_dedup.near_components(both, 5, 80).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == last
    assert corpus_pipeline.run.__doc__ and corpus_pipeline.ORACLE_SQL is None


def test_empty_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
