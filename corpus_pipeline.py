"""Training-corpus pipeline: quality classifier, quality rules, MinHash
near-dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet and reads again as
the next stage's input.  All but the last return the columns of ``docs``.

Edge cases: null and empty texts are documents like others (the rules reject
them, having no words); repeated rows of a group of copies are one document;
an empty table gives an empty result at every stage; further columns pass
through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import minhash_dedup, packing, quality_classifier, quality_rules
from starloom.llm.queries import END_ID
from starloom.llm.store import reach_workers, stored

#: five words a shingle and a similarity of 0.8
SHINGLE, SIMILARITY = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, accepts."""
    reach_workers(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit_classifier(docs, labels)
    scored = quality_classifier.score_quality(_without(docs, "score", "predicted"), model)
    return _back(scored.where(F.col("predicted") == 1), docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    reach_workers(spark)
    names = [f.split()[0] for f in quality_rules.SIGNALS.split(", ")]
    judged = quality_rules.judge_quality(_without(docs, *names, "base_failed", "kept"))
    return _back(judged.where("kept"), docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; repeated rows count once."""
    reach_workers(spark)
    return minhash_dedup.drop_near_copies(docs, SHINGLE, SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 4096 tokens."""
    reach_workers(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


def _without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns that a stage would replace set aside."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_in_{c}" if c in names else c) for c in docs.columns])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`_in_{c}`" if f"_in_{c}" in rows.columns else f"`{c}`").alias(c) for c in docs.columns])


STAGES = [("classifier", classify), ("rules", rules), ("dedup", dedup), ("packing", pack)]

#: training, suffix arrays and tokenization are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
