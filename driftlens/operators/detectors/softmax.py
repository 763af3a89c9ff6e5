"""Scores of token distributions: one Arrow pass evaluates a whole parameter grid.

Column contract: ``token_logits`` array<array<double>> (one list per token), or ``logits`` for
classifiers, which count as one token. Mode "output" averages over the tokens, "input" does so over
``input_token_logits``, "token" keeps one number per token.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.arrow import lengths, lists_of, numbers, segment_mean, segment_starts
from driftlens.functions.vectors import softmax
from driftlens.operators.detectors.base import Scorer, key_columns, label

# The parameter grids of the published runs.
TOKEN_TEMPERATURES = (0.5, 1.0, 1.5, 2.0)
TOKEN_ALPHAS = (0.1, 0.5, 0.9, 1.1, 1.5, 2.0, 3.0)
OUTPUT_TEMPERATURES = (0.05, 0.1, 0.5, 0.9, 1.0, 1.1, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
OUTPUT_ALPHAS = (0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 1.1, 1.5, 2.0, 5.0)


class Tokens:
    """A batch of logit lists laid end to end, with per-token reductions."""

    def __init__(self, logits: np.ndarray, sizes: np.ndarray):
        self.logits, self.sizes, self.starts = logits, sizes, segment_starts(sizes)

    def spread(self, per_token: np.ndarray) -> np.ndarray:
        return np.repeat(per_token, self.sizes)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)

    def top(self, values: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(values, self.starts)

    def logsumexp(self, values: np.ndarray) -> np.ndarray:
        top = self.top(values)
        return top + np.log(self.total(np.exp(values - self.spread(top))))

    def log_p(self, temperature: float) -> np.ndarray:
        scaled = self.logits / temperature
        return scaled - self.spread(self.logsumexp(scaled))


def token_column(df: DataFrame, mode: str) -> Column:
    if mode == "input":
        return F.col("input_token_logits")
    return F.col("token_logits") if "token_logits" in df.columns else F.array(F.col("logits"))


class TokenScorer(Scorer):
    """Base of the grid scorers: subclasses give names and a kernel, tokens -> (grid, token) matrix."""

    def __init__(self, mode: str = "output"):
        if mode not in ("input", "output", "token"):
            raise ValueError(f"unknown mode {mode}")
        self.mode = mode

    def kernel(self):
        raise NotImplementedError

    def _token_matrix(self):
        """(column, rows) -> grid x token scores and tokens per row; empty tokens give NaN."""
        kernel, width = self.kernel(), len(self.score_names)

        def run(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            inner = column.flatten()
            sizes = lengths(inner)
            scores = np.full((width, len(sizes)), np.nan)
            if (sizes > 0).any():
                scores[:, sizes > 0] = kernel(Tokens(numbers(inner.flatten()), sizes[sizes > 0]))
            return scores, lengths(column)

        return run

    def _averages(self, outputs: DataFrame) -> Column:
        run = self._token_matrix()

        def averages(column: pa.Array) -> pa.Array:
            scores, per_row = run(column)
            return lists_of(segment_mean(scores, per_row).T.copy())

        return F.arrow_udf(averages, "array<double>")(token_column(outputs, self.mode))

    def score_map(self, outputs: DataFrame) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(n) for n in self.score_names]), self._averages(outputs))

    def transform(self, outputs: DataFrame) -> DataFrame:
        return self._long(outputs, self._averages(outputs), "score")

    def transform_tokens(self, outputs: DataFrame) -> DataFrame:
        """(sample_id, seq_id, detector, token_scores array): the "token" mode."""
        run = self._token_matrix()

        def curves(column: pa.Array) -> pa.Array:
            scores, per_row = run(column)
            width, tokens = scores.shape
            ends = np.cumsum(per_row)
            parts = [scores[:, end - size : end].ravel() for end, size in zip(ends, per_row)]
            flat = np.concatenate(parts) if parts else np.empty(0)
            inner = np.concatenate([[0], np.cumsum(np.repeat(per_row, width))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(inner), pa.array(flat, pa.float64()))
            outer = (np.arange(len(per_row) + 1) * width).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(outer), lists)

        score = F.arrow_udf(curves, "array<array<double>>")
        return self._long(outputs, score(token_column(outputs, self.mode)), "token_scores")

    def _long(self, outputs: DataFrame, scored: Column, out: str) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.score_names])
        return (
            outputs.select(*key_columns(outputs), scored.alias("_scores"))
            .select("sample_id", "seq_id", F.posexplode("_scores").alias("_pos", out))
            .select("sample_id", "seq_id", F.element_at(names, F.col("_pos") + 1).alias("detector"), out)
        )


class MSP(TokenScorer):
    """1 - highest softmax probability."""

    def __init__(self, mode: str = "output", temperature: float = 1.0):
        super().__init__(mode)
        self.temperature = temperature
        self.score_names = (label("msp", temperature=temperature, mode=mode),)

    def kernel(self):
        temperature = self.temperature

        def score(tokens: Tokens) -> np.ndarray:
            return (1.0 - np.exp(tokens.top(tokens.log_p(temperature))))[None]

        return score


class Energy(TokenScorer):
    """-T * logsumexp(logits / T)."""

    def __init__(self, mode: str = "output", temperature: float = 1.0):
        super().__init__(mode)
        self.temperature = temperature
        self.score_names = (label("energy", temperature=temperature, mode=mode),)

    def kernel(self):
        temperature = self.temperature

        def score(tokens: Tokens) -> np.ndarray:
            return (-temperature * tokens.logsumexp(tokens.logits / temperature))[None]

        return score


class FisherRao(TokenScorer):
    """2/pi * arccos(sum sqrt(p / V)): distance to the uniform distribution on the sphere."""

    def __init__(self, temperatures: Sequence[float] = (1.0,), mode: str = "output"):
        super().__init__(mode)
        self.temperatures = tuple(temperatures)
        self.score_names = tuple(label("fisher_rao", temperature=t, mode=mode) for t in self.temperatures)

    def kernel(self):
        temperatures = self.temperatures

        def score(tokens: Tokens) -> np.ndarray:
            rows = []
            for t in temperatures:
                overlap = tokens.total(np.exp(tokens.log_p(t) / 2)) / np.sqrt(tokens.sizes)
                rows.append(2 / np.pi * np.arccos(np.minimum(overlap, 1.0)))
            return np.stack(rows)

        return score


class RenyiNeg(TokenScorer):
    """Rényi divergence of order a between the token distribution and the uniform one."""

    def __init__(
        self,
        temperatures: Sequence[float] = OUTPUT_TEMPERATURES,
        alphas: Sequence[float] = OUTPUT_ALPHAS,
        mode: str = "output",
    ):
        super().__init__(mode)
        self.temperatures, self.alphas = tuple(temperatures), tuple(alphas)
        self.score_names = tuple(
            label("renyi", temperature=t, alpha=a, mode=mode) for t, a in product(self.temperatures, self.alphas)
        )

    def kernel(self):
        temperatures, alphas = self.temperatures, self.alphas

        def score(tokens: Tokens) -> np.ndarray:
            rows = []
            size = np.log(tokens.sizes)
            for t in temperatures:
                log_p = tokens.log_p(t)
                for a in alphas:
                    if a == 1:
                        rows.append(size + tokens.total(np.exp(log_p) * log_p))
                    else:
                        rows.append(size + tokens.logsumexp(a * log_p) / (a - 1))
            return np.stack(rows)

        return score


_MEANS = "i int, n long, mean array<double>"  # i-th temperature


class RenyiDataFitted(TokenScorer):
    """Rényi divergence to the mean token distribution of the in-distribution outputs."""

    def __init__(self, temperatures: Sequence[float] = (1.0,), alphas: Sequence[float] = (0.5,), mode: str = "output"):
        super().__init__(mode)
        self.temperatures, self.alphas = tuple(temperatures), tuple(alphas)
        self.score_names = tuple(
            label("renyi_fitted", temperature=t, alpha=a, mode=mode)
            for t, a in product(self.temperatures, self.alphas)
        )
        self.log_q = None

    def fit(self, reference: DataFrame) -> RenyiDataFitted:
        return self._use(reference.sparkSession, *self._mean(reference)[1:])

    def _mean(self, reference: DataFrame) -> tuple:
        """Number of tokens, and their mean distribution at each temperature."""
        tokens = reference.select(F.explode(token_column(reference, self.mode)).alias("l"))
        averages = [Summarizer.mean(array_to_vector(softmax(F.col("l"), t))) for t in self.temperatures]
        row = tokens.agg(F.count("*"), *averages).first()
        return row[0], *(x.toArray() for x in row[1:])

    def accumulate(self, reference: DataFrame, path: str, batch: int) -> None:
        n, *means = self._mean(reference)
        if n:
            rows = [(i, n, mean.tolist()) for i, mean in enumerate(means)]
            reference.sparkSession.createDataFrame(rows, _MEANS).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    def fit_accumulated(self, spark: SparkSession, path: str) -> RenyiDataFitted:
        weighted = Summarizer.mean(array_to_vector("mean"), F.col("n").cast("double")).alias("mean")
        rows = spark.read.parquet(path).groupBy("i").agg(weighted).orderBy("i").collect()
        return self._use(spark, *(r["mean"].toArray() for r in rows))

    def state(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(i, 1, np.exp(self.log_q.value[t]).tolist()) for i, t in enumerate(self.temperatures)]
        return {"means": spark.createDataFrame(rows, _MEANS)}

    def restore(self, spark: SparkSession, tables: dict[str, DataFrame]) -> RenyiDataFitted:
        return self._use(spark, *(np.array(r["mean"]) for r in tables["means"].orderBy("i").collect()))

    def _use(self, spark: SparkSession, *means: np.ndarray) -> RenyiDataFitted:
        with np.errstate(divide="ignore"):
            self.log_q = spark.sparkContext.broadcast({t: np.log(m) for t, m in zip(self.temperatures, means)})
        return self

    def kernel(self):
        temperatures, alphas, log_q = self.temperatures, self.alphas, self.log_q

        def score(tokens: Tokens) -> np.ndarray:
            rows = []
            for t in temperatures:
                log_p = tokens.log_p(t)
                q = np.tile(log_q.value[t], len(tokens.sizes))
                for a in alphas:
                    if a == 1:
                        rows.append(tokens.total(np.exp(log_p) * (log_p - q)))
                    else:
                        rows.append(tokens.logsumexp(a * log_p + (1 - a) * q) / (a - 1))
            return np.stack(rows)

        return score
