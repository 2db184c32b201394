"""Queries over the whole tables that apply the operators with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from kinweave.llm import sql
from kinweave.llm.decontamination import find_contamination
from kinweave.llm.exact_dedup import tree_exact_dedup
from kinweave.llm.html_text import extract_html
from kinweave.llm.language import fit_language, identify_languages
from kinweave.llm.line_dedup import dedup_lines_across_sites
from kinweave.llm.mixing import mix_sources
from kinweave.llm.near_dedup import near_duplicates
from kinweave.llm.quality import classify_quality
from kinweave.llm.secrets import scan_secrets
from kinweave.llm.token_store import tokenize_to_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines_across_sites(_table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_language(docs))


def op10_token_store(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return tokenize_to_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


_ALL = [
    op1_line_dedup, op2_html_text, op3_mixing, op4_secrets, op5_quality, op6_decontamination, op7_exact_dedup, op8_near_dedup, op9_language,
    op10_token_store, pipeline,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLE.items() if v}
