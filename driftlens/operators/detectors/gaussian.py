"""Class-conditional Gaussians with a shared covariance, and the Mahalanobis score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.arrow import lists_of, matrix
from driftlens.operators.detectors.base import Scorer, key_columns

GRAM_TASKS = 2_000


@dataclass
class GaussianFit:
    """Statistics of a size set by the feature dimension and the number of classes."""

    labels: list
    counts: np.ndarray
    means: np.ndarray
    covariance: np.ndarray

    def precision(self) -> np.ndarray:
        return np.linalg.pinv(self.covariance, hermitian=True)


def _labelled(df: DataFrame, features: str, label: str | None) -> DataFrame:
    label_column = F.col(label).cast("string") if label else F.lit("all")
    return df.select(label_column.alias("label"), F.col(features).alias("v"), F.lit(1.0).alias("w"))


def _means(rows: DataFrame) -> list[tuple]:
    """(label, weight, mean) of every class, NULL last."""
    mean = Summarizer.mean(array_to_vector("v"), F.col("w")).alias("m")
    groups = rows.groupBy("label").agg(F.sum("w").alias("n"), mean).collect()
    return [(r["label"], r["n"], r["m"].toArray()) for r in sorted(groups, key=lambda r: (r["label"] is None, r["label"]))]


def _sum_rows(rows: DataFrame) -> np.ndarray:
    """The matrix of which `rows` (i, row) hold any number of summands."""
    sums = rows.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    return np.array([r["row"] for r in sums.orderBy("i").collect()])


def _scatter(rows: DataFrame, labels: list, means: np.ndarray) -> np.ndarray:
    """Weighted sum of products of the rows (label, v, w) around their class means.

    One Gram matrix per task is shuffled; there are at most GRAM_TASKS tasks or two per core, so they do not grow with the input.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((labels, means))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres = shared.value
        place = {name: i for i, name in enumerate(names)}
        gram = np.zeros((centres.shape[1], centres.shape[1]))
        for batch in batches:
            if batch.num_rows:
                mine = np.array([place[name] for name in batch["label"].to_pylist()])
                centred = matrix(batch["v"]) - centres[mine]
                gram += (centred * batch["w"].to_numpy(zero_copy_only=False)[:, None]).T @ centred
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(gram)), "row": lists_of(gram)})

    tasks = max(GRAM_TASKS, 2 * spark.sparkContext.defaultParallelism)
    return _sum_rows(rows.coalesce(tasks).mapInArrow(scatter, "i long, row array<double>"))


def fit_gaussian(df: DataFrame, features: str = "features", label: str | None = "label") -> GaussianFit:
    """Per-class means, then the pooled scatter around them."""
    rows = _labelled(df, features, label)
    groups = _means(rows)
    labels, counts, means = [g[0] for g in groups], np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
    return GaussianFit(labels, counts, means, _scatter(rows, labels, means) / counts.sum())


def accumulate_gaussian(df: DataFrame, path: str, batch: int, features: str = "features", label: str | None = "label") -> None:
    """Store what a batch of rows adds to a fit: counts and means per class, and the scatter around them.

    Its size is set by the dimension and the number of classes. The same batch number again replaces what it stored, so a repeated
    call counts once. A batch without rows stores nothing.
    """
    spark = df.sparkSession
    rows = _labelled(df, features, label)
    groups = _means(rows)
    if not groups:
        return
    scatter = _scatter(rows, [g[0] for g in groups], np.array([g[2] for g in groups]))
    classes = [(name, float(n), mean.tolist()) for name, n, mean in groups]
    products = [(i, row.tolist()) for i, row in enumerate(scatter)]
    spark.createDataFrame(classes, "label string, n double, mean array<double>").write.mode("overwrite").parquet(f"{path}/classes/batch={batch}")
    spark.createDataFrame(products, "i long, row array<double>").write.mode("overwrite").parquet(f"{path}/scatter/batch={batch}")


def merge_gaussian(spark: SparkSession, path: str) -> GaussianFit:
    """The fit of all rows of all stored batches: scatters add up, with each batch's means around the common ones (weighted by its rows)."""
    stored = spark.read.parquet(f"{path}/classes").select("label", F.col("mean").alias("v"), F.col("n").alias("w"))
    groups = _means(stored)
    labels, counts, means = [g[0] for g in groups], np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
    within = _sum_rows(spark.read.parquet(f"{path}/scatter").select("i", "row"))
    return GaussianFit(labels, counts, means, (within + _scatter(stored, labels, means)) / counts.sum())


class Mahalanobis(Scorer):
    """Smallest squared Mahalanobis distance to a class mean; one class when there are no labels."""

    score_names = ("mahalanobis",)

    def __init__(self, features: str = "features", label: str | None = "label"):
        self.features, self.label = features, label
        self.fitted: GaussianFit | None = None

    def fit(self, reference: DataFrame) -> Mahalanobis:
        return self._use(reference.sparkSession, fit_gaussian(reference, self.features, self.label))

    def accumulate(self, reference: DataFrame, path: str, batch: int) -> None:
        accumulate_gaussian(reference, path, batch, self.features, self.label)

    def fit_accumulated(self, spark: SparkSession, path: str) -> Mahalanobis:
        return self._use(spark, merge_gaussian(spark, path))

    def state(self, spark: SparkSession) -> dict[str, DataFrame]:
        fit = self.fitted
        classes = [(name, float(n), mean.tolist()) for name, n, mean in zip(fit.labels, fit.counts, fit.means)]
        return {
            "classes": spark.createDataFrame(classes, "label string, n double, mean array<double>"),
            "covariance": spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(fit.covariance)], "i long, row array<double>"),
        }

    def restore(self, spark: SparkSession, tables: dict[str, DataFrame]) -> Mahalanobis:
        classes = sorted(tables["classes"].collect(), key=lambda r: (r["label"] is None, r["label"]))
        covariance = np.array([r["row"] for r in tables["covariance"].orderBy("i").collect()])
        labels, counts = [r["label"] for r in classes], np.array([r["n"] for r in classes])
        return self._use(spark, GaussianFit(labels, counts, np.array([r["mean"] for r in classes]), covariance))

    def _use(self, spark: SparkSession, fitted: GaussianFit) -> Mahalanobis:
        self.fitted = fitted
        # With precision = W W', distances are plain Euclidean ones after multiplying by W.
        values, vectors = np.linalg.eigh(self.fitted.precision())
        whiten = vectors * np.sqrt(np.clip(values, 0, None))
        self.shared = spark.sparkContext.broadcast((whiten, self.fitted.means @ whiten))
        return self

    def score_map(self, outputs: DataFrame) -> Column:
        return F.create_map(F.lit("mahalanobis"), self._distance())

    def transform(self, outputs: DataFrame) -> DataFrame:
        return outputs.select(
            *key_columns(outputs), F.lit("mahalanobis").alias("detector"), self._distance().alias("score")
        )

    def _distance(self) -> Column:
        shared = self.shared

        def nearest(features: pa.Array) -> pa.Array:
            whiten, centres = shared.value
            points = matrix(features) @ whiten if len(features) else np.empty((0, centres.shape[1]))
            best = np.full(len(points), np.inf)
            for centre in centres:
                best = np.minimum(best, ((points - centre) ** 2).sum(axis=1))
            return pa.array(best)

        return F.arrow_udf(nearest, "double")(F.col(self.features))
