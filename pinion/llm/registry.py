"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinion.llm import (
    op01_url_filter,
    op02_ngram_jaccard,
    op03_embedding_dedup,
    op04_ann_forest,
    op05_language_id,
    op06_line_dedup,
    op07_sharding,
    op08_packing,
    op09_bpe,
    op10_html,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op01_url_filter.op1_url_filter,
    "op2_ngram_jaccard": op02_ngram_jaccard.op2_ngram_jaccard,
    "op3_embedding_dedup": op03_embedding_dedup.op3_embedding_dedup,
    "op4_ann_forest": op04_ann_forest.op4_ann_forest,
    "op5_language_id": op05_language_id.op5_language_id,
    "op6_line_dedup": op06_line_dedup.op6_line_dedup,
    "op7_sharding": op07_sharding.op7_sharding,
    "op8_best_fit_packing": op08_packing.op8_best_fit_packing,
    "op9_bpe": op09_bpe.op9_bpe,
    "op10_html_extraction": op10_html.op10_html_extraction,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": op01_url_filter.ORACLE_SQL,
    "op2_ngram_jaccard": op02_ngram_jaccard.ORACLE_SQL,
    "op3_embedding_dedup": op03_embedding_dedup.ORACLE_SQL,
}
