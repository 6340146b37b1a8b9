"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from framequery.llm import (
    conversations,
    decontaminate,
    language_id,
    licences,
    line_dedup,
    mixing,
    nearest,
    passages,
    periodic,
    quality,
    secret_scan,
    simhash,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": language_id.query,
        "op2_licence_scan": licences.query,
        "op3_toxicity": toxicity.query,
        "op4_quality_classifier": quality.query,
        "op5_benchmark_decontamination": decontaminate.query,
        "op6_nearest_neighbours": nearest.query,
        "op7_simhash_near_dedup": simhash.query,
        "op8_substring_dedup": passages.query,
        "op9_secret_scan": secret_scan.query,
        "op10_source_mixing": mixing.query,
        "op11_line_dedup": line_dedup.query,
        "op12_periodic_runs": periodic.query,
        "op13_conversation_repair": conversations.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_line_dedup": line_dedup.ORACLE,
        "op12_periodic_runs": periodic.ORACLE,
        "op13_conversation_repair": conversations.ORACLE,
    }
