"""In-distribution against out-of-distribution configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators.filters import skip_self
from driftlens.session import broadcast_if_small


def experiment_matrix(ins: DataFrame, outs: DataFrame) -> DataFrame:
    """(phase, dataset_in, dataset_out): each in-configuration's validation and test run, then all others' test.

    Both frames are lists of configuration names.
    """
    names_in = ins.select(F.col("name").alias("dataset_in")).distinct()
    names_out = outs.select(F.col("name").alias("dataset_out")).distinct()
    own = names_in.select("dataset_in", F.col("dataset_in").alias("dataset_out"))
    others = skip_self(names_in.join(broadcast_if_small(names_out), F.col("dataset_in") != F.col("dataset_out")))
    return (
        own.withColumn("phase", F.lit("validation"))
        .unionByName(own.withColumn("phase", F.lit("test")))
        .unionByName(others.withColumn("phase", F.lit("test")))
        .select("phase", "dataset_in", "dataset_out")
    )


def tag_scores(scores: DataFrame, matrix: DataFrame) -> DataFrame:
    """Scores of every run of the matrix: rows of (phase, dataset_out) once per in-configuration."""
    return scores.join(broadcast_if_small(matrix), ["phase", "dataset_out"])
