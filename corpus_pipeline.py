"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, kernel, langid, pieces, quality, signature_tree


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold or have a word typical of toxic ones go."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity=quality.Toxicity())


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or surely of another than they say, go."""
    return langid.accept(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return signature_tree.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless)."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Hash buckets, kernel machines and piece lattices are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what lies between them is written to the shared folder, and deleted once the next stage is there (but for the last, which the result reads).

    Defined results: rows of null doc_id pass the stages that need none and give a row of null doc_id; null, empty and wordless texts are rejected by the
    first stage; repeated rows of a doc_id leave one; of similar documents the smallest doc_id stays; very long texts are taken whole; other columns, whatever their
    names, pass all stages but the last, which has its own; an empty table gives no rows."""
    kernel.shared_checkpoints(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
            if before:
                kernel.remove(spark, before)
            before = f"{base}/{k}-{name}"
    return docs
