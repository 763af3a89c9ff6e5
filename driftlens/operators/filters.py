"""Predicates over corpora, score tables and run plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.contracts import SPLITS


def answerable(df: DataFrame, keep: bool = True, answers: str = "answers") -> DataFrame:
    """Rows with an answer, or the others."""
    has_answer = F.size(f"{answers}.answer_start") > 0
    return df.where(has_answer if keep else ~has_answer)


def score_keys(df: DataFrame, substring: str = "token", column: str = "detector") -> DataFrame:
    return df.where(F.col(column).contains(substring))


def skip_self(pairs: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Drop in == out; with a table of loaded corpora also the pairs whose corpus failed to load."""
    others = pairs.where(F.col("dataset_in") != F.col("dataset_out"))
    if available is None:
        return others
    loaded = available.select(F.col("name").alias("dataset_out")).distinct()
    return others.join(loaded, "dataset_out", "left_semi")


def nonempty_splits(df: DataFrame, expected: Sequence[str] = SPLITS) -> DataFrame:
    """(split, n, ok) for every expected split, also those without a row."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in expected], "split string")
    sizes = df.groupBy("split").agg(F.count("*").alias("n"))
    return (
        wanted.join(sizes, "split", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("ok", F.col("n") > 0)
    )
