"""Corpus preparation: five stages, each written as Parquet and read again.

The stages learn from ``labels``, ``benchmark`` and the stage's own documents;
no stage has an SQL form (trained classifiers, near-duplicate groups and an
iterative fit), so ORACLE_SQL is None and tests compare with brute force.

What holds for every stage: null texts count as empty; rows that repeat a doc_id
are read as one document by the stages that group documents and each by itself by
the others; rows without doc_id are kept or judged by their text alone; an empty
table gives an empty one; columns of any other name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framequery.llm import decontaminate, mixing, quality, secret_scan, simhash
from framequery.llm.common import settle, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 4) rejects go; empty texts are
    scored as they are, and without labels all stay."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (operator 7) stays, the
    one with the smallest doc_id; rows without doc_id pass.  Links are fingerprints
    that differ in 2 bits at most and, as these lose a third of them, sets of five-word
    shingles of a Jaccard similarity of 0.8, found by shared prefixes."""
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a re-parameterised form of it
    (operator 5) go; without benchmark items all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets (operator 9) are replaced in the text; n_chars follows where
    it changed, null texts stay null, and every row is kept."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its domain, tokens and rate (operator 10); every row is
    kept, columns of the three added names are replaced."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
