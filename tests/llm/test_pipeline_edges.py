"""Every stage of the pipeline on empty tables and odd rows."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framequery.llm.common import table
from tests.llm.fixtures import odd

SF = "/root/testdata/sf0.001"
ADDED = {"mixing": ["mix_domain", "mix_tokens", "mix_rate"]}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name):
    docs = table(spark, SF, "documents")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), SF)
    assert out.columns == docs.columns + ADDED.get(name, [])
    assert out.count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, name):
    """Nulls, empty and very long texts, repeated rows and ids, a null id, and columns
    of names that the stages use themselves."""
    docs = odd(spark).withColumn("row", F.lit(1)).withColumn("rate", F.lit("x"))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns + ADDED.get(name, [])
    kept = out.collect()
    assert len(kept) <= docs.count()
    if name in ("secrets", "mixing"):
        assert sorted(map(str, (r["doc_id"] for r in kept))) == sorted(map(str, (r["doc_id"] for r in docs.collect())))


def test_the_whole_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    shutil.rmtree(tmp_path / "labels.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
