"""Corpus and score aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.arrow import mean_and_deviation
from driftlens.functions.text import words
from driftlens.session import materialize

def _part(place: int) -> Callable[[Column], Column]:
    return lambda scores: F.arrow_udf(lambda lists: mean_and_deviation(lists)[place], "double")(scores)


# The same numbers as `vectors.mean` and `vectors.std_population`, whole batches at once.
TOKEN_AGGREGATES: Mapping[str, Callable[[Column], Column]] = {"mean": _part(0), "std": _part(1)}


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def idf(df: DataFrame, text: str = "text", also: DataFrame | None = None) -> DataFrame:
    """(token, df, idf, weight): ln((N+1)/(df+1)) over the vocabulary, and its share of the sum.

    The vocabulary is the tokens seen, and those of the texts in ``also``, which count for nothing else. Texts are read once.
    """
    texts = df.select(F.col(text).alias("_text"), F.lit(1).alias("_counts"))
    if also is not None:
        texts = texts.unionAll(also.select(F.col(text).alias("_text"), F.lit(0).alias("_counts")))
    counts = (
        texts.select("_counts", F.explode(F.array_distinct(words(F.col("_text")))).alias("token"))
        .groupBy("token")
        .agg(F.sum("_counts").alias("df"))
    )
    n = df.count()
    weighted = materialize(counts.withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1))))
    return weighted.withColumn("weight", F.col("idf") / weighted.agg(F.sum("idf")).scalar())


def token_stats(
    df: DataFrame, column: str = "token_scores", aggregates: Mapping[str, Callable[[Column], Column]] = TOKEN_AGGREGATES
) -> DataFrame:
    """Per sequence aggregates of the token scores, named {column}_{aggregate}; no row moves."""
    return df.select(
        *[c for c in df.columns if c != column],
        *[build(F.col(column)).alias(f"{column}_{name}") for name, build in aggregates.items()],
    )


def accuracy(df: DataFrame, predicted: str = "pred_label", true: str = "true_label", by: tuple[str, ...] = ()) -> DataFrame:
    hit = (F.col(predicted) == F.col(true)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, predicted: str = "pred_label", true: str = "true_label") -> DataFrame:
    return df.groupBy(true, predicted).agg(F.count("*").alias("n"))


def _field(name: str, row: Column) -> Column:
    return row[name]


def per_generation(df: DataFrame, metrics: tuple[str, ...], sample: str = "sample_id", seq: str = "seq_id") -> DataFrame:
    """Lists per sample, in the order of the returned sequences (a model run returns a fixed few)."""
    ordered = F.array_sort(F.collect_list(F.struct(seq, *metrics)))
    lists = df.groupBy(sample).agg(ordered.alias("_runs"))
    return lists.select(sample, *[F.transform("_runs", partial(_field, m)).alias(m) for m in metrics])


def align(scores: DataFrame, outputs: DataFrame) -> DataFrame:
    """Attach hypotheses, references and likelihoods to the scores of the same sequence."""
    return scores.join(outputs, ["sample_id", "seq_id"])


def wide_scores(scores: DataFrame, detectors: list[str]) -> DataFrame:
    """One column per detector, as the record files have it."""
    columns: list[Column] = [F.max(F.when(F.col("detector") == d, F.col("score"))).alias(d) for d in detectors]
    return scores.groupBy("sample_id", "seq_id").agg(*columns)
