"""A training corpus from documents: stages that each read what the one before has written, in the order of STAGES.

SQL can express none of the stages' methods (trained models, fingerprints, tiling, projected gradients), so ORACLE_SQL is None; tests hold
every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import mixing, pii, simhash, tiling, toxicity
from driftlens.llm.common import table
from driftlens.plans.registry import query
from driftlens.session import scratch_path


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = mixing.language_and_quality(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labelled, mixing.WEIGHTS)


STAGES = [
    ("toxicity", _toxicity),
    ("simhash_near_dedup", _near_dedup),
    ("benchmark_decontamination", _decontamination),
    ("pii", _pii),
    ("source_mixing", _mixing),
]

ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: its columns, and each remaining document's rate and number of copies."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
