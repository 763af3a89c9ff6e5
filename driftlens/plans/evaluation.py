"""The evaluation flows: model outputs in, score records out.

Outputs of all runs come as one frame tagged with ``phase`` ("validation", "test") and
``dataset_out``; sample ids are unique over the frame. Detectors are fitted on the validation rows of
the in-distribution set and score the whole frame in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.vectors import argmax, let, log_softmax
from driftlens.operators.aggregates import token_stats
from driftlens.operators.detectors import FunctionalIsolationForest, Scorer
from driftlens.operators.detectors.base import score_all
from driftlens.operators.filters import score_keys
from driftlens.sources.records import with_metadata

TAGS = ("phase", "dataset_out")


def reference_rows(outputs: DataFrame, dataset_in: str) -> DataFrame:
    return outputs.where((F.col("phase") == "validation") & (F.col("dataset_out") == dataset_in))


def predictions(outputs: DataFrame, true_label: str = "label") -> DataFrame:
    """pred_label, true_label, correct and likelihood (the highest log-softmax) per row."""
    return outputs.select(
        *[c for c in outputs.columns if c not in ("logits", "features", true_label)],
        argmax(F.col("logits")).alias("pred_label"),
        F.col(true_label).alias("true_label"),
        (argmax(F.col("logits")) == F.col(true_label)).alias("correct"),
        let(log_softmax(F.col("logits")), F.array_max).alias("likelihood"),
    )


def _scored(outputs: DataFrame, scorers: Sequence[Scorer], dataset_in: str) -> DataFrame:
    """Outputs with a ``scores`` map by detector.

    Scorers that look at one row at a time add to the map in place; only the scores of the others are
    gathered per sequence and joined.
    """
    reference = reference_rows(outputs, dataset_in)
    fitted = [s.fit(reference) for s in scorers]
    maps = [m for m in (s.score_map(outputs) for s in fitted) if m is not None]
    apart = [s for s in fitted if s.score_map(outputs) is None]
    none = F.create_map().cast("map<string,double>")
    rows = outputs.withColumn("scores", F.map_concat(*maps) if maps else none)
    if not apart:
        return rows
    entries = F.collect_list(F.struct("detector", "score"))
    others = score_all(apart, outputs).groupBy("sample_id", "seq_id").agg(F.map_from_entries(entries).alias("_others"))
    joined = rows.join(others, ["sample_id", "seq_id"], "left")
    return joined.withColumn("scores", F.map_concat("scores", F.coalesce("_others", none))).drop("_others")


def evaluate_classification(
    outputs: DataFrame, scorers: Sequence[Scorer], dataset_in: str, model: str = "model", true_label: str = "label", **meta
) -> DataFrame:
    """Records: one row per sample with prediction, likelihood, the scores by detector and run metadata."""
    single = outputs if "seq_id" in outputs.columns else outputs.withColumn("seq_id", F.lit(0))
    rows = predictions(_scored(single, scorers, dataset_in), true_label)
    return with_metadata(rows, model=model, dataset_in=dataset_in, **meta)


def evaluate_generation(
    outputs: DataFrame,
    scorers: Sequence[Scorer],
    metrics: Sequence[Callable[..., DataFrame]],
    dataset_in: str,
    model: str = "model",
    **meta,
) -> DataFrame:
    """Records: one row per sample and sequence with texts, likelihood, task metrics and the scores by detector."""
    rows = _scored(outputs, scorers, dataset_in).select(
        "sample_id", "seq_id", *TAGS, "hyp", "ref", "likelihood", "scores"
    )
    for metric in metrics:
        rows = metric(rows, keys=rows.columns)
    return with_metadata(rows, model=model, dataset_in=dataset_in, **meta)


def aggregate_token_records(validation: DataFrame, test: DataFrame, substring: str = "mode=token", **forest) -> DataFrame:
    """The same for a long table of token scores: each detector whose key holds ``substring`` has its own forest.

    All forests are grown in one pass and used in one, however many detectors there are.
    """
    known = score_keys(validation, substring)
    tested = score_keys(test, substring).join(F.broadcast(known.select("detector").distinct()), "detector", "left_semi")
    return aggregate_records(known, tested, by="detector", **forest)


def aggregate_records(validation: DataFrame, test: DataFrame, column: str = "token_scores", **forest) -> DataFrame:
    """Per sequence of the test records: mean and deviation of the token scores and the forest's score.

    The forest is grown on the first sequence of each validation sample.
    """
    grown = FunctionalIsolationForest(column=column, **forest).fit(validation)
    name = grown.score_names[0]
    scored = test.withColumn(name, grown.score_map(test)[name])
    return token_stats(scored, column)
