"""Small tables that every operator has to survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, findings string, score double, h long, word string"


def documents(spark: SparkSession, texts: list[str | None], ids: list[int | None] | None = None) -> DataFrame:
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, None, None, len(t or ""), "mine", 7.0, 1, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark: SparkSession) -> DataFrame:
    """Nulls, empty and long texts, repeated rows, a null id, odd characters."""
    texts = [None, "", "   \n\t ", "one", "The same words again.", "The same words again.", "\U0001f600 été \u0000 x", "word " * 30_000, "a" * 200_000, "The same words again."]
    return documents(spark, texts, [0, 1, 2, 3, 4, 4, 5, 6, 7, None])


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
