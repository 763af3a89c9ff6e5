"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A are never moved or changed: a pass solves every row through the triangular factors found so far and sums the Gram matrix of the
result. The first factor is the Cholesky factor of A'A plus a small shift, so that it exists for any A; each later pass factors the Gram of
the already almost orthogonal rows, until they are orthogonal to rounding. The product R of all factors has A = QR with orthogonal Q,
hence A and R have the same singular values and right vectors, which are taken from R (and not from A'A, where the small ones would drown).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.arrow import lists_of
from driftlens.llm.common import written

SCALE, OFFSET = 64, 1_000_000
# Entries beyond this are taken for it, so that sums of products of whole numbers stay exact for millions of rows.
LARGEST = 1 << 40
COMPONENTS = 16
PASSES = 8
# Components whose deviation is below this share of the largest one are numerical zeros (rank).
ZERO = 1e-10
# Rows that a task works on at a time, and tasks (or two per core) that hand on a matrix.
ROWS = 4_096
TASKS = 2_000


@dataclass
class Whitening:
    """n fitted rows with whole-number sums per dimension; unit components as columns, with their variances, by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)


def whole_numbers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x: floor(SCALE * entry) + OFFSET of every row whose vector is there and has neither NULL nor non-finite entries."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (bad[ends[1:]] == bad[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
            kept = np.repeat(good, sizes)
            x = np.clip(np.floor(SCALE * values[kept]), -LARGEST, LARGEST).astype(np.int64) + OFFSET
            offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, x)], [key, "x"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInArrow(step, f"{key} {kind}, x array<long>")


def _matrix(x: pa.ListArray, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centred(x: np.ndarray, sums: Sequence[int], n: int) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off exactly, then the rest."""
    return (x - np.array([s // n for s in sums], np.int64)).astype(float) - np.array([(s % n) / n for s in sums])


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q with Q factor = rows, for an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for k in range(rows.shape[1]):
        out[:, k] = (rows[:, k] - out[:, :k] @ factor[:k, k]) / factor[k, k]
    return out


def gram(spark: SparkSession, fitted: DataFrame, n: int, sums: Sequence[int], prepare: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sums of the columns (first row) and of their products, over the prepared rows; one matrix per task is shuffled, one comes to the driver."""
    shared = spark.sparkContext.broadcast((list(sums), n))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = shared.value
        total = np.zeros((width + 1, width))
        for batch in batches:
            x = _matrix(batch.column(0), len(sums))
            for at in range(0, len(x), ROWS):
                rows = prepare(centred(x[at : at + ROWS], sums, n))
                total[0] += rows.sum(axis=0)
                total[1:] += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), lists_of(total)], ["i", "row"])

    tasks = max(TASKS, 2 * spark.sparkContext.defaultParallelism)
    partial = fitted.select("x").coalesce(tasks).mapInArrow(step, "i long, row array<double>")
    each = partial.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width + 1, width))
    for row in each.collect():
        out[row.i, row.j] = row.value
    return out


def _cholesky(matrix: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor of matrix + shift, with the least shift (from the given one on) for which there is one."""
    width, step = len(matrix), 4 * np.finfo(float).eps * len(matrix) * max(np.trace(matrix), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(matrix + shift * np.eye(width)).T
        except np.linalg.LinAlgError:
            shift = max(2 * shift, step)


def triangular_factor(spark: SparkSession, fitted: DataFrame, n: int, sums: Sequence[int]) -> np.ndarray:
    """R of the centred rows, as the product of the factors of all passes."""
    width, eps = len(sums), np.finfo(float).eps
    factors: list[np.ndarray] = []
    for turn in range(PASSES):
        known = list(factors)
        products = gram(spark, fitted, n, sums, lambda rows: reduce(solve_rows, known, rows), width)[1:]
        # The usual shift: 11 (rows columns + columns (columns + 1)) eps |A|^2, here by a root, as sums over blocks err far less.
        shift = 11 * (np.sqrt(float(n)) * width + width * (width + 1)) * eps * np.linalg.norm(products, 2) if turn == 0 else 0.0
        if not products.any():
            return np.zeros((width, width))
        factors.append(_cholesky(products, shift))
        if turn and np.abs(products - np.eye(width)).max() < 64 * eps * width:
            break
    return reduce(lambda product, factor: factor @ product, factors)


def fit(spark: SparkSession, fitted: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows x of `fitted`, which is read once per pass; None for none."""
    first = fitted.agg(F.count("*"), F.max(F.size("x"))).first()
    n, width = first
    if not n:
        return None
    sums = [int(r.s) for r in _column_sums(fitted, width).orderBy("i").collect()]
    factor = triangular_factor(spark, fitted, n, sums)
    _, deviations, rows = np.linalg.svd(factor)
    kept = (deviations > ZERO * deviations[0])[:components] if deviations[0] > 0 else np.zeros(0, bool)
    axes = rows[: len(kept)][kept].T
    for k in range(axes.shape[1]):  # the sign is free; the largest entry is positive
        axes[:, k] *= np.sign(axes[np.abs(axes[:, k]).argmax(), k])
    variances = deviations**2 / n
    found = Whitening(n, sums, axes, variances[: len(kept)][kept], float(variances.sum()))
    found.identity_error = _identity_error(spark, fitted, found)
    return found


def _column_sums(fitted: DataFrame, width: int) -> DataFrame:
    """i, s: exact sums per dimension, from one row per task and dimension."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(width, object)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), ROWS):  # whole numbers below 2^41, so a block's sum fits
                totals += x[at : at + ROWS].sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array([str(t) for t in totals])], ["i", "s"])

    partial = fitted.select("x").mapInArrow(step, "i long, s string")
    return partial.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def _identity_error(spark: SparkSession, fitted: DataFrame, found: Whitening) -> float:
    """The largest entry of whitened's covariance less the identity; the mean is found first and taken off before multiplying."""
    width = found.components.shape[1]
    if not width:
        return 0.0
    axes = found.components / np.sqrt(found.variances)
    mean = gram(spark, fitted, found.n, found.sums, lambda rows: rows @ axes, width)[0] / found.n
    covariance = gram(spark, fitted, found.n, found.sums, lambda rows: rows @ axes - mean, width)[1:] / found.n
    return float(np.abs(covariance - np.eye(width)).max())


def _deviations(x: np.ndarray, sums: Sequence[int], n: int) -> pa.Array:
    """Sum over dimensions of (n x - sums)^2, exactly; NULL where a long can't hold it."""
    shift = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)
    near = x - shift
    if len(near) and (float(np.abs(near).max()) + 1) ** 2 * float(n) ** 2 * len(sums) < 2.0**62:
        off = near * n - rest.astype(np.int64)
        return pa.array((off * off).sum(axis=1))
    off = near.astype(object) * n - rest
    return pa.array([d if d < 2**63 else None for d in (off * off).sum(axis=1).tolist()], pa.int64())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    Rows without a vector, with an empty one, or with NULL or non-finite entries are left out. Where vectors differ in length, those of the commonest
    length (the longer of equally common ones) are whitened and the others left out. The fit takes each different vector once; keys may be NULL or repeat.
    Components without variance have no rows, so there are as many as the rank at most: none for one vector or equal ones. Components of equal
    variance are any basis of their space. A deviation beyond a long is NULL; entries beyond 2^40 / 64 count as that. Other columns are
    not read. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    numbers = written(whole_numbers(rows.select(key, F.col(vector).alias("_v")), key, "_v"), "whitening-rows")
    widths = numbers.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(2).collect()
    if len(widths) > 1:
        numbers = numbers.where(F.size("x") == widths[0].width)
    fitted = written(numbers.select("x").distinct(), "whitening-fit")
    found = fit(spark, fitted, components)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not found.components.shape[1]:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        axes = model.components / np.sqrt(model.variances)
        count = axes.shape[1]
        for batch in batches:
            x = _matrix(batch.column(1), model.width)
            place = np.repeat(np.arange(len(x)), count)
            rows = len(place)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(place)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, model.n)),
                    _deviations(x, model.sums, model.n).take(pa.array(place)),
                    pa.array((centred(x, model.sums, model.n) @ axes).ravel()),
                    pa.array(np.tile(model.variances / model.total, len(x))),
                    pa.array(np.full(rows, model.identity_error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return numbers.select(key, "x").mapInArrow(project, schema)
