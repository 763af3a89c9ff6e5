"""Functional isolation forest over token-score curves.

A curve is a function on [0, 1], whatever its number of tokens. The dictionary holds waves
cos(2 pi f t + phase); a curve's inner product with any of them, and that of its slope, follow from a
few Fourier coefficients, so each curve is read once and trees work on short vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions.arrow import lengths, lists_of, matrix, numbers, runs, segment_mean
from driftlens.functions.hashing import hash_key
from driftlens.operators.detectors.base import Scorer, key_columns
from driftlens.session import materialize

_NODES = "weights array<double>, value double, low int, high int, key string, tree int, node int"
FREQUENCIES = 8
EULER_GAMMA = 0.5772156649015329


def curve_coefficients(curves: pa.Array) -> pa.Array:
    """Per curve: (cos, sin) coefficients of the curve and of its slope for each frequency."""
    sizes = lengths(curves)
    values = numbers(curves.flatten())
    columns = np.zeros((len(sizes), 4 * FREQUENCIES))
    for rows, at in runs(sizes):
        columns[rows] = _coefficients(values[at], sizes[rows])
    return lists_of(np.nan_to_num(columns))


def _coefficients(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    counts = np.repeat(sizes, sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slope = np.zeros_like(values)
    if len(values) > 1:
        inside = place[1:] > 0
        slope[1:][inside] = np.diff(values)[inside] * counts[1:][inside]
    columns = np.zeros((len(sizes), 4 * FREQUENCIES))
    # A wave of frequency f is the f-th power of the first: one cosine and one sine per value.
    angle = 2 * np.pi * ((place + 0.5) / counts)
    base = np.cos(angle) + 1j * np.sin(angle)
    wave = np.ones_like(base)
    for f in range(FREQUENCIES):
        for at, curve in ((2 * f, values), (2 * FREQUENCIES + 2 * f, slope)):
            told = segment_mean(curve * wave, sizes)
            columns[:, at], columns[:, at + 1] = told.real, told.imag
        wave *= base
    return columns


def _seed(*parts) -> int:
    return int(hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8], 16)


def _wave(rng: np.random.Generator, alpha: float, scale: np.ndarray) -> np.ndarray:
    """Weights that turn coefficients into alpha <x, d> + (1 - alpha) <x', d> for a random wave d."""
    f = rng.integers(0, FREQUENCIES)
    phase = rng.uniform(0, 2 * np.pi)
    weights = np.zeros(4 * FREQUENCIES)
    for offset, share in ((0, alpha / scale[0]), (2 * FREQUENCIES, (1 - alpha) / scale[1])):
        weights[offset + 2 * f] = share * math.cos(phase)
        weights[offset + 2 * f + 1] = -share * math.sin(phase)
    return weights


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n leaves."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, alpha: float, depth: int, scale: np.ndarray, level: int = 0) -> list:
    """Nested [weights, threshold, low, high]; a leaf is its path length."""
    if len(rows) > 1 and level < depth:
        weights = _wave(rng, alpha, scale)
        at = rows @ weights
        low, high = at.min(), at.max()
        if high > low:
            cut = rng.uniform(low, high)
            return [
                weights.tolist(),
                float(cut),
                grow_tree(rows[at <= cut], rng, alpha, depth, scale, level + 1),
                grow_tree(rows[at > cut], rng, alpha, depth, scale, level + 1),
            ]
    return [level + average_path(len(rows))]


def _flatten(tree: list) -> list[tuple]:
    """Node rows (weights or None, threshold or path, low child, high child)."""
    nodes: list = []

    def add(node: list) -> int:
        place = len(nodes)
        nodes.append(None)
        if len(node) == 1:
            nodes[place] = (None, node[0], place, place)
        else:
            nodes[place] = (node[0], node[1], add(node[2]), add(node[3]))
        return place

    add(tree)
    return nodes


class FunctionalIsolationForest(Scorer):
    """Trees on seeded 32-curve samples of the first sequence of each reference sample; higher = odder."""

    def __init__(
        self,
        n_trees: int = 50,
        sample_size: int = 32,
        alpha: float = 0.9,
        seed: int = 42,
        column: str = "token_scores",
        by: str | None = None,
    ):
        """With ``by``, each of its values (a detector's key, say) has a forest of its own; all are fitted and used in the same passes."""
        self.n_trees, self.sample_size, self.alpha, self.seed, self.column, self.by = n_trees, sample_size, alpha, seed, column, by
        self.score_names = (f"fif_{column}",)

    def _key(self) -> Column:
        return F.col(self.by).cast("string") if self.by else F.lit("")

    def fit(self, reference: DataFrame) -> FunctionalIsolationForest:
        keyed = reference.select(*key_columns(reference), self._key().alias("key"), F.col(self.column).alias("curve"))
        firsts = keyed.where((F.col("seq_id") == 0) & (F.size("curve") > 0) & F.col("key").isNotNull())
        size, seed, alpha = self.sample_size, self.seed, self.alpha
        totals = {r["key"]: r["count"] for r in firsts.groupBy("key").count().collect()}
        depth = math.ceil(math.log2(max(2, size)))

        def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
            tree = int(key[1])
            rows = np.stack(sample.sort_values("_rn")["x"].to_numpy())
            scale = [max(np.linalg.norm(part, axis=1).mean(), 1e-12) for part in np.split(rows, 2, axis=1)]
            nodes = _flatten(grow_tree(rows, np.random.default_rng(_seed(seed, tree)), alpha, depth, np.array(scale)))
            table = pd.DataFrame(nodes, columns=["weights", "value", "low", "high"])
            return table.assign(key=key[0], tree=tree, node=range(len(nodes)))

        grown = self._samples(firsts, totals).groupBy("key", "tree").applyInPandas(grow, _NODES).collect() if totals else []
        return self._use(reference.sparkSession, grown, totals)

    def state(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "nodes": spark.createDataFrame([tuple(r) for r in self.nodes], _NODES),
            "totals": spark.createDataFrame(list(self.totals.items()), "key string, n long"),
        }

    def restore(self, spark: SparkSession, tables: dict[str, DataFrame]) -> FunctionalIsolationForest:
        return self._use(spark, tables["nodes"].collect(), {r["key"]: r["n"] for r in tables["totals"].collect()})

    def _use(self, spark: SparkSession, nodes: list, totals: dict[str, int]) -> FunctionalIsolationForest:
        self.nodes, self.totals = nodes, totals
        trees: dict = {}
        for row in sorted(nodes, key=lambda r: (r["key"], r["tree"], r["node"])):
            trees.setdefault(row["key"], {}).setdefault(row["tree"], []).append(row)
        forests = {
            key: (
                [
                    (
                        np.array([r["weights"] or [0.0] * (4 * FREQUENCIES) for r in nodes]),
                        np.array([r["value"] for r in nodes]),
                        np.array([r["low"] for r in nodes]),
                        np.array([r["high"] for r in nodes]),
                    )
                    for nodes in of_key.values()
                ],
                average_path(min(self.sample_size, totals[key])) or 1.0,
            )
            for key, of_key in trees.items()
        }
        depth = math.ceil(math.log2(max(2, self.sample_size)))
        self.shared = spark.sparkContext.broadcast((forests, depth))
        return self

    def _samples(self, firsts: DataFrame, totals: dict[str, int]) -> DataFrame:
        """key, tree, x, _rn: for each tree the curves with the least hashes of all of its key.

        Hashes are even over 60 bits, so a bound six deviations above the wanted number leaves little more than the samples to be
        reduced and sorted; it is widened until every tree has enough.
        """
        size, trees = self.sample_size, self.n_trees
        draws = F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda tree: F.struct(tree.alias("tree"), hash_key(self.seed, tree, F.col("sample_id")).alias("_h")),
        )
        coefficients = F.arrow_udf(curve_coefficients, "array<double>")
        bound = size + 6 * math.sqrt(size) + 10
        while True:
            shares = {key: min(1.0, bound / total) for key, total in totals.items()}
            limits = F.create_map(*[F.lit(x) for key, share in shares.items() for x in (key, int(share * (2**60 - 1)))])
            # Curves without a draw under the limit go before anything is copied per tree.
            drawn = firsts.withColumn("_draws", F.filter(draws, lambda d: d["_h"] <= limits[F.col("key")])).where(F.size("_draws") > 0)
            reduced = drawn.select("key", "sample_id", "_draws", coefficients(F.col("curve")).alias("x"))
            pool = materialize(reduced.select("key", "sample_id", "x", F.explode("_draws").alias("_d")).select("key", "sample_id", "x", "_d.*"))
            counts: dict = {}
            for r in pool.groupBy("key", "tree").count().collect():
                counts.setdefault(r["key"], []).append(r["count"])
            if all(
                shares[key] >= 1 or (len(counts.get(key, [])) == trees and min(counts[key]) >= min(size, total))
                for key, total in totals.items()
            ):
                break
            bound *= 2
        order = W.partitionBy("key", "tree").orderBy("_h", "sample_id")
        return pool.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= size).select("key", "tree", "x", "_rn")

    def score_map(self, outputs: DataFrame) -> Column:
        return F.create_map(F.lit(self.score_names[0]), self._oddness())

    def transform(self, outputs: DataFrame) -> DataFrame:
        return outputs.select(
            *key_columns(outputs), F.lit(self.score_names[0]).alias("detector"), self._oddness().alias("score")
        )

    def _oddness(self) -> Column:
        """NULL for a key without a forest."""
        shared = self.shared

        def paths(x: np.ndarray, key: str) -> np.ndarray:
            forests, depth = shared.value
            trees, norm = forests[key]
            length = np.zeros(len(x))
            for weights, value, low, high in trees:
                at = x @ weights.T
                node = np.zeros(len(x), dtype=np.int64)
                rows = np.arange(len(x))
                for _ in range(depth):
                    node = np.where(at[rows, node] <= value[node], low[node], high[node])
                length += value[node]
            return 2.0 ** (-(length / len(trees)) / norm)

        def score(keys: pa.Array, curves: pa.Array) -> pa.Array:
            out = np.full(len(curves), np.nan)
            names = np.array(keys.to_pylist(), object)
            x = matrix(curve_coefficients(curves)) if len(curves) else None
            for key in set(names.tolist()) & shared.value[0].keys():
                mine = names == key
                out[mine] = paths(x[mine], key)
            return pa.array(out, from_pandas=True)

        return F.arrow_udf(score, "double")(self._key(), F.col(self.column))
