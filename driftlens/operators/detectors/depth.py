"""Integrated rank-weighted depth over seeded directions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.arrow import lists_of, matrix
from driftlens.operators.detectors.base import Scorer, key_columns
from driftlens.operators.ordering import LEAF_ROWS, running_total
from driftlens.session import materialize

KEYS = ["sample_id", "seq_id"]
SMALL_BYTES = 64 * 2**20  # of a reference's projections, which every Python worker then holds
MOST_BUCKETS = 2_000  # per direction
DECIMALS = 9  # projections closer than this count as equal, so copies of a row rank alike


def directions(count: int, width: int, seed: int = 42) -> np.ndarray:
    """Unit vectors with normal components drawn from md5 (Box-Muller)."""

    def uniform(*parts) -> float:
        digest = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()
        return (int(digest[:8], 16) + 0.5) / 2**32

    raw = np.array(
        [
            [
                math.sqrt(-2 * math.log(uniform(seed, k, i, "r"))) * math.cos(2 * math.pi * uniform(seed, k, i, "t"))
                for i in range(width)
            ]
            for k in range(count)
        ]
    )
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class DataDepth(Scorer):
    """Mean over directions u of min(F_u(x), 1 - F_u(x)), F_u the reference's distribution along u."""

    score_names = ("depth",)

    def __init__(self, n_directions: int = 64, seed: int = 42, features: str = "features", small_bytes: int = SMALL_BYTES, bucket_rows: int = LEAF_ROWS):
        self.n_directions, self.seed, self.features = n_directions, seed, features
        self.small_bytes, self.bucket_rows = small_bytes, bucket_rows

    def fit(self, reference: DataFrame) -> DataDepth:
        return self._use(reference.select(F.col(self.features).alias("vector")))

    def state(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"reference": self.reference}

    def restore(self, spark: SparkSession, tables: dict[str, DataFrame]) -> DataDepth:
        return self._use(tables["reference"])

    def _use(self, reference: DataFrame) -> DataDepth:
        self.reference = reference
        self.size, width = self.reference.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.directions = directions(self.n_directions, width, self.seed)
        self.sorted = None
        return self

    def transform(self, outputs: DataFrame) -> DataFrame:
        left = outputs.select(*key_columns(outputs), F.col(self.features).alias("vector"))
        n, k = float(self.size), float(self.n_directions)
        share = F.col("below") / n
        if 8 * self.size * self.n_directions <= self.small_bytes:
            each = self._by_broadcast(left)
            depth = F.aggregate("below", F.lit(0.0), lambda acc, b: acc + F.least(b / n, F.lit(1.0) - b / n)) / F.lit(k)
            return each.select(*KEYS, F.lit("depth").alias("detector"), depth.alias("score"))
        depths = self._by_ranks(left).groupBy(*KEYS).agg(F.avg(F.least(share, 1.0 - share)).alias("score"))
        return depths.select(*KEYS, F.lit("depth").alias("detector"), "score")

    def _by_broadcast(self, left: DataFrame) -> DataFrame:
        """below: per direction, how many reference rows project to at most this row's point; the sorted projections travel."""
        axes = self.directions
        if self.sorted is None:
            rows = matrix(self.reference.select("vector").toArrow()["vector"])
            self.sorted = left.sparkSession.sparkContext.broadcast(np.sort(_project(rows, axes), axis=0))
        shared = self.sorted

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    points = _project(matrix(batch["vector"]), axes)
                    below = [np.searchsorted(shared.value[:, d], points[:, d], side="right") for d in range(len(axes))]
                    columns = [*batch.columns[: len(KEYS)], lists_of(np.stack(below, axis=1).astype(np.float64))]
                    yield pa.RecordBatch.from_arrays(columns, [*KEYS, "below"])

        return left.mapInArrow(rank, "sample_id long, seq_id int, below array<double>")

    def _by_ranks(self, left: DataFrame) -> DataFrame:
        """The same numbers, one row per direction, by ranks: work and rows grow with the sum of both sides' sizes.

        Points are equal or in order along a direction; different ones are counted once per side, bucketed by the reference's own quantiles,
        and ranked by bucket totals and a sum inside each bucket.
        """
        axes, spark = self.directions, left.sparkSession
        by = ["direction", "point"]
        reference = _points(self.reference, [], axes).groupBy(*by).agg(F.count("*").alias("n"))
        reference = materialize(reference)
        parts = max(2, min(MOST_BUCKETS, -(-self.size // self.bucket_rows)))
        cuts = reference.groupBy("direction").agg(F.percentile_approx("point", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts"))
        edges = {r["direction"]: np.unique(np.array(r["cuts"], float)) for r in cuts.collect()}
        shared = spark.sparkContext.broadcast(edges)

        def bucket(directions: pa.Array, points: pa.Array) -> pa.Array:
            direction, point = directions.to_numpy(zero_copy_only=False), points.to_numpy(zero_copy_only=False)
            out = np.zeros(len(point), np.int64)
            for d in np.unique(direction):
                mine = direction == d
                out[mine] = np.searchsorted(shared.value[d], point[mine], side="left")
            return pa.array(out)

        asked = _points(left, KEYS, axes)
        points = asked.select(*by).distinct().withColumns({"n": F.lit(0).cast("long"), "asks": F.lit(1)})
        both = reference.withColumn("asks", F.lit(0)).unionByName(points)
        both = both.withColumn("bucket", F.arrow_udf(bucket, "long")("direction", "point"))
        ranked = running_total(both, ["direction"], "bucket", [F.col("point"), F.col("asks")], "n", "below")
        return asked.join(ranked.where("asks = 1").select(*by, "below"), by)


def _project(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return np.round(rows @ axes.T, DECIMALS) + 0.0  # no negative zero


def _points(df: DataFrame, keys: list[str], axes: np.ndarray) -> DataFrame:
    """keys, direction, point: one row per row and direction."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(axes)
        for batch in batches:
            if batch.num_rows:
                points = _project(matrix(batch["vector"]), axes)
                place = pa.array(np.repeat(np.arange(len(points)), count))
                columns = [*(batch[k].take(place) for k in keys), pa.array(np.tile(np.arange(count, dtype=np.int32), len(points))), pa.array(points.ravel())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "direction", "point"])

    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.select(*keys, "vector").mapInArrow(step, f"{kinds}direction int, point double")
