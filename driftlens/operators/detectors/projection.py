"""Scores against other rows: cosine to a reference, Rényi projections on a reference or on the sample's beams."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.arrow import lengths, lists_of, numbers, segment_mean
from driftlens.functions.vectors import let
from driftlens.operators import nearby, pairing
from driftlens.operators.detectors.base import Scorer, key_columns, label
from driftlens.operators.detectors.softmax import token_column
from driftlens.session import checkpoint_dir

KEYS = ["sample_id", "seq_id"]


def cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All cosines; a zero vector has cosine 0 with everything."""

    return _unit(left) @ _unit(right).T


def renyi(log_p: np.ndarray, log_q: np.ndarray, alpha: float) -> np.ndarray:
    """Rényi divergences of order alpha between all rows of p and of q; order 1 is Kullback-Leibler."""
    p = np.exp(log_p)
    if alpha == 1:
        return (p * log_p).sum(axis=1)[:, None] - p @ log_q.T
    return np.log(np.exp(alpha * log_p) @ np.exp((1 - alpha) * log_q).T) / (alpha - 1)


def log_mean_distribution(column: Column, temperature: float) -> Column:
    """log of the mean token distribution of each row."""

    def average(tokens: pa.Array) -> pa.Array:
        inner = tokens.flatten()
        sizes = lengths(inner)
        width = int(sizes.max()) if len(sizes) else 0
        logits = numbers(inner.flatten()).reshape(-1, width) / temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        means = segment_mean(p.T, lengths(tokens)).T
        with np.errstate(divide="ignore"):
            return lists_of(np.log(np.maximum(means, np.finfo(float).tiny)))

    return F.arrow_udf(average, "array<double>")(column)


def nearest(
    queries: DataFrame,
    reference: DataFrame,
    k: int = 1,
    metric: str = "cosine",
    features: str = "features",
    alpha: float = 0.5,
    **limits,
) -> DataFrame:
    """(sample_id, seq_id, partners, scores): the k closest reference rows, best first.

    "cosine" ranks by highest cosine over ``features``, "renyi" by lowest divergence over log probabilities.
    """
    largest = metric == "cosine"
    left = queries.select(*key_columns(queries), F.col(features).alias("vector"))
    right = reference.select(F.col("sample_id").cast("long").alias("partner"), F.col(features).alias("vector"))
    schema = "sample_id long, seq_id int, partners array<long>, scores array<double>"
    count, width = right.agg(F.count("*"), F.max(F.size("vector"))).first()
    small = 8 * count * (width or 0) <= limits.get("small_bytes", pairing.SMALL_REFERENCE_BYTES)
    if not small and nearby.readable(checkpoint_dir(reference.sparkSession)):
        measure = _measure(metric, alpha)
        layout = nearby.lay_out(right, "partner", "vector", measure, limits.get("reference_rows", nearby.BLOCK_ROWS))
        found = nearby.nearest_of_blocks(left, layout, measure, k, KEYS, "vector", schema)
        return found.withColumn("scores", F.transform("scores", lambda s: -s)) if largest else found

    def emit(keys, mine, others, theirs):
        table = cosine(mine, theirs) if largest else renyi(mine, theirs, alpha)
        partners, scores = pairing.best_partners(table, others, k, largest)
        return {**keys, "partners": lists_of(partners), "scores": lists_of(scores)}

    found, several = pairing.against_reference(left, right, emit, schema, KEYS, "partner", **limits)
    return pairing.merge_partners(found, KEYS, k, largest) if several else found


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _measure(metric: str, alpha: float) -> nearby.Measure:
    """Cosine falls with the angle. Divergences of any order are at least min(1, alpha / (1 - alpha)) times that of order one half, which
    is -2 log cos of the angle between the roots of the distributions."""
    if metric == "cosine":
        return nearby.Measure(lambda a, b: -cosine(a, b), _unit, lambda angle: -np.cos(np.minimum(angle, np.pi)))
    share = 1.0 if alpha >= 0.5 else alpha / (1 - alpha)

    def least(angle: np.ndarray) -> np.ndarray:
        return -2 * share * np.log(np.maximum(np.cos(np.minimum(angle, np.pi / 2)), np.finfo(float).tiny))

    return nearby.Measure(lambda a, b: renyi(a, b, alpha), lambda rows: _unit(np.exp(rows / 2)), least)


class CosineProjection(Scorer):
    """Highest cosine to a reference row."""

    score_names = ("cosine",)

    def __init__(self, features: str = "features", **limits):
        self.features, self.limits = features, limits

    def fit(self, reference: DataFrame) -> CosineProjection:
        self.reference = reference.select(*key_columns(reference), self.features)
        return self

    def state(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"reference": self.reference}

    def restore(self, spark: SparkSession, tables: dict[str, DataFrame]) -> CosineProjection:
        self.reference = tables["reference"]
        return self

    def transform(self, outputs: DataFrame) -> DataFrame:
        best = nearest(outputs, self.reference, 1, "cosine", self.features, **self.limits)
        return best.select(
            *KEYS, F.lit("cosine").alias("detector"), F.element_at("scores", 1).alias("score")
        )


def _mean_of_nearest(n: int) -> Column:
    """NULL where there is no other to compare with."""
    return let(
        F.slice("scores", 1, n),
        lambda s: F.when(F.size(s) > 0, F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)),
    )


class InformationProjection(Scorer):
    """Mean of the n smallest Rényi divergences from the mean token distribution to the reference's."""

    def __init__(self, alpha: float = 0.5, temperature: float = 1.0, n_neighbors: int = 8, mode: str = "output", **limits):
        self.alpha, self.temperature, self.n_neighbors = alpha, temperature, n_neighbors
        self.mode, self.limits = mode, limits
        self.score_names = (
            label("info_projection", temperature=temperature, alpha=alpha, n_neighbors=n_neighbors),
        )

    def _distributions(self, df: DataFrame) -> DataFrame:
        return df.select(*key_columns(df), log_mean_distribution(token_column(df, self.mode), self.temperature).alias("features"))

    def fit(self, reference: DataFrame) -> InformationProjection:
        self.reference = self._distributions(reference)
        return self

    def state(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"reference": self.reference}

    def restore(self, spark: SparkSession, tables: dict[str, DataFrame]) -> InformationProjection:
        self.reference = tables["reference"]
        return self

    def transform(self, outputs: DataFrame) -> DataFrame:
        best = nearest(
            self._distributions(outputs), self.reference, self.n_neighbors, "renyi", alpha=self.alpha, **self.limits
        )
        return best.select(
            *KEYS, F.lit(self.score_names[0]).alias("detector"), _mean_of_nearest(self.n_neighbors).alias("score")
        )


class BeamRenyiProjection(Scorer):
    """The same among the sequences returned for one sample; the whole grid is one pass over the blocks."""

    def __init__(
        self,
        temperatures: Sequence[float] = (1.0,),
        alphas: Sequence[float] = (0.5,),
        n_neighbors: Sequence[int] = (2,),
        mode: str = "output",
        block_rows: int = pairing.BLOCK_ROWS,
    ):
        self.temperatures, self.alphas = tuple(temperatures), tuple(alphas)
        self.n_neighbors, self.mode, self.block_rows = tuple(n_neighbors), mode, block_rows
        self.grid = list(product(self.temperatures, self.alphas))
        self.score_names = tuple(
            label("beam_projection", temperature=t, alpha=a, n_neighbors=n) for t, a in self.grid for n in self.n_neighbors
        )

    def transform(self, outputs: DataFrame) -> DataFrame:
        temperatures, grid, k = self.temperatures, self.grid, max(self.n_neighbors)
        tokens = token_column(outputs, self.mode)
        # One vector per sequence holds its log distributions at all temperatures.
        stacked = F.concat(*[log_mean_distribution(tokens, t) for t in temperatures])
        rows = outputs.select(*key_columns(outputs), stacked.alias("vector"))

        def emit(keys, mine, others, theirs):
            width = mine.shape[1] // len(temperatures)
            out = {"seq_id": [], "grid": [], "partners": [], "scores": []}
            own = keys["seq_id"][:, None] == others[None, :]
            for g, (t, a) in enumerate(grid):
                part = slice(temperatures.index(t) * width, (temperatures.index(t) + 1) * width)
                table = renyi(mine[:, part], theirs[:, part], a)
                table[own] = np.inf
                partners, scores = pairing.best_partners(table, others, k, largest=False)
                for row in range(len(mine)):
                    kept = np.isfinite(scores[row])
                    out["seq_id"].append(keys["seq_id"][row])
                    out["grid"].append(g)
                    out["partners"].append(partners[row][kept].astype(np.int64))
                    out["scores"].append(scores[row][kept])
            return {
                "seq_id": np.array(out["seq_id"], dtype=np.int32),
                "grid": np.array(out["grid"], dtype=np.int32),
                "partners": pa.array(out["partners"], pa.list_(pa.int64())),
                "scores": pa.array(out["scores"], pa.list_(pa.float64())),
            }

        schema = "seq_id int, grid int, partners array<long>, scores array<double>, sample_id long"
        found, several = pairing.within_group(
            rows, rows.withColumnRenamed("seq_id", "other"), "sample_id", emit, schema, ["seq_id"], "other",
            block_rows=self.block_rows,
        )
        if several:
            found = pairing.merge_partners(found, [*KEYS, "grid"], k, largest=False)
        names = F.array(*[F.array(*[F.lit(label("beam_projection", temperature=t, alpha=a, n_neighbors=n)) for n in self.n_neighbors]) for t, a in grid])
        means = F.array(*[_mean_of_nearest(n) for n in self.n_neighbors])
        return (
            found.withColumn("_named", F.arrays_zip(F.element_at(names, F.col("grid") + 1).alias("n"), means.alias("m")))
            .select(*KEYS, F.explode("_named").alias("_s"))
            .select(*KEYS, F.col("_s.n").alias("detector"), F.col("_s.m").alias("score"))
        )
