"""One registered query per corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftlens.llm.common import table
from driftlens.llm.language import identify
from driftlens.llm.merkle import manifest, without_line_breaks
from driftlens.llm.mixing import WEIGHTS, language_and_quality, rated
from driftlens.llm.pii import spans_of
from driftlens.llm.simhash import near_duplicates
from driftlens.llm.suffixes import removed
from driftlens.llm.syncmers import fingerprint_edits
from driftlens.llm.tiling import matches
from driftlens.llm.token_counts import token_counts
from driftlens.llm.toxicity import toxicity
from driftlens.llm.url_rules import judge
from driftlens.llm.whitening import whiten
from driftlens.llm.word_table import digests
from driftlens.plans.registry import query


@query("op1_pii")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op3_source_mixing")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = language_and_quality(docs, table(spark, sf_dir, "labels"))
    return rated(docs, labelled, WEIGHTS).select("doc_id", "n_tokens", "domain", "rate")


@query("op4_benchmark_decontamination")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_simhash_near_dedup")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_suffix_array_dedup")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_url_filters")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op9_document_fingerprints")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_embedding_whitening")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_merkle_manifest")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), without_line_breaks())


@query("op13_bpe_word_table")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
