"""A training corpus from raw documents, in stages that each write their result and read it again.

Each stage is a function of (spark, docs, sf_dir) over everything its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import base, bpe, decontaminate, minhash_dedup, quality_rules, secret_scans


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and frequent lines go from the others."""
    return quality_rules.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, on five-word shingles at similarity 0.8."""
    base.small_batches(spark)
    return minhash_dedup.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    base.small_batches(spark)
    return decontaminate.without_leaks(docs, base.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secret_scans.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each remaining document, as the query of byte-level BPE gives them."""
    base.small_batches(spark)
    return bpe.digests(docs, bpe.production())


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("byte-level BPE", tokens),
]

#: Byte-level BPE has no form in SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
