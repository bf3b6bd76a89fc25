"""A training-corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works on all that its
predecessor kept. All but the last return the columns of ``documents``.

Defined cases: null and empty texts pass the classifier, have one empty line, share the fingerprint zero, so that one document of them
stays, have no windows and encode to no tokens; repeated rows are judged alike, and near-dedup keeps one of them; a null id is an id
of its own; tables without trusted labels or benchmark items let everything pass; an empty table gives an empty result; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, decontaminate, kn_quality, line_dedup, simhash
from caseloom.llm.common import discard, made, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the classifier rejects go."""
    return kn_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; every document stays."""
    return line_dedup.rewrite(docs, min_docs=10, min_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the count and digest of its tokens, and the digest of what they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: Fingerprints, the language model and BPE have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage is written, the tables that it made on its way, and its input, are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    before = len(made(spark))
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(spark, made(spark)[before:-1])  # the last is the stage's own
    return STAGES[-1][1](spark, docs, sf_dir)
