"""Best partners in a large reference, searched by tasks that keep their own rows.

The reference is laid out once: every vector goes to its nearest pivot by angle, and a pivot's vectors are stored as blocks of bounded size on the
shared storage, with the block's radius. A task holds its rows' k best so far and reads blocks one after the other, those with the nearest
possible partners first. A block is skipped for a row when the triangle inequality of angles leaves no better partner in it, so the result is that
of all pairs. Rows of the left side are not copied or shuffled; what is broadcast is one pivot, radius and number per block.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.arrow import lists_of, matrix
from driftlens.operators.pairing import TABLE_CELLS, best_partners
from driftlens.session import scratch_path

PIVOTS = 1_024
BLOCK_ROWS = 16_384
BLOCK_BYTES = 32 * 2**20
KEPT_BLOCKS = 4  # blocks that a worker keeps from one batch of rows to the next
SLACK = 1e-6  # of angles; arccos is no better near zero


@dataclass
class Measure:
    """A score, and what makes it searchable: unit vectors whose angles bound it. Signed scores are best when lowest."""

    signed: Callable[[np.ndarray, np.ndarray], np.ndarray]
    units: Callable[[np.ndarray], np.ndarray]  # a zero row where there is no direction
    least: Callable[[np.ndarray], np.ndarray]  # the lowest signed score at an angle of at least this


@dataclass
class Layout:
    """The blocks of a reference: folder of each, index and radius of its pivot."""

    path: str
    key: str
    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def readable(path: str) -> bool:
    """Whether tasks can open this storage by themselves."""
    try:
        fs.FileSystem.from_uri(_local(path))
    except (pa.ArrowException, OSError):
        return False
    return True


def lay_out(right: DataFrame, key: str, vector: str, measure: Measure, block_rows: int = BLOCK_ROWS) -> Layout:
    """Store the reference (key, vector) as blocks. A zero vector is in blocks of its own that nothing skips."""
    spark = right.sparkSession
    rows, width = right.agg(F.count("*"), F.max(F.size(vector))).first()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width or 1))))
    count = min(PIVOTS, 4 * -(-rows // block_rows))
    drawn = right.select(key, vector).orderBy(F.xxhash64(key), key).limit(count).toArrow()
    pivots = measure.units(matrix(drawn[vector]))
    pivots = pivots[np.linalg.norm(pivots, axis=1) > 0]
    shared = spark.sparkContext.broadcast(pivots)

    def placed(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot, angle to it); rows without a direction have a number behind the last pivot."""
        pivots = shared.value
        units = measure.units(vectors)
        if not len(pivots):
            return np.zeros(len(units), np.int64), np.zeros(len(units))
        near = units @ pivots.T
        cell = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(near)), cell], -1, 1))
        none = np.linalg.norm(units, axis=1) == 0
        return np.where(none, len(pivots), cell), np.where(none, 0.0, angle)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(placed(matrix(batch.column(0)))[0], minlength=len(total))
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(total)), "n": total})

    sizes = right.select(vector).mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    chunks = np.ones(len(pivots) + 1, np.int64)
    for row in sizes:
        chunks[row.cell] = max(1, -(-row.n // block_rows))
    first = np.concatenate([[0], np.cumsum(chunks)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, angle = placed(matrix(batch.column(1)))
                block = first[cell] + batch.column(2).to_numpy(zero_copy_only=False) % chunks[cell]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(block), pa.array(angle)], [key, "vector", "block", "angle"])

    hashed = F.pmod(F.xxhash64(key), F.lit(2**31 - 1)).alias("hash")
    blocks = right.select(key, F.col(vector).cast("array<double>").alias("vector"), hashed)
    kind = right.schema[key].dataType.simpleString()
    path = scratch_path(spark, "reference")
    stored = blocks.mapInArrow(dealt, f"{key} {kind}, vector array<double>, block long, angle double")
    stored.repartition("block").write.partitionBy("block").parquet(path)
    told = spark.read.parquet(path).groupBy(F.col("block").cast("long")).agg(F.max("angle").alias("radius")).orderBy("block").collect()
    block = np.array([r["block"] for r in told], np.int64)
    pivot = np.searchsorted(first, block, side="right") - 1
    radius = np.array([r["radius"] for r in told])
    radius[pivot == len(pivots)] = np.pi  # no direction: not skipped
    return Layout(path, key, pivots, block, np.minimum(pivot, max(0, len(pivots) - 1)), radius)


def search(
    rows: np.ndarray, layout: Layout, measure: Measure, k: int, load: Callable[[int], tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray]:
    """(partners, signed scores) of the k best per row, best first, equal scores by lower key. `load` gives a block's keys and vectors."""
    units = measure.units(rows)
    if len(layout.pivots):
        angle = np.arccos(np.clip(units @ layout.pivots.T, -1, 1))[:, layout.pivot]
        low = np.maximum(0.0, angle - layout.radius - SLACK)
        low[np.linalg.norm(units, axis=1) == 0] = 0.0
    else:
        low = np.zeros((len(rows), len(layout.block)))
    possible = measure.least(low)
    partners, best = np.empty((len(rows), 0), np.int64), np.empty((len(rows), 0))
    for place in np.argsort(possible.min(axis=0), kind="stable") if len(rows) else []:
        worst = best[:, -1] if best.shape[1] == k else np.full(len(rows), np.inf)
        open_ = np.flatnonzero(possible[:, place] <= worst + 1e-9)
        if not len(open_):
            continue
        keys, vectors = load(int(layout.block[place]))
        found, scores = best_partners(measure.signed(rows[open_], vectors), keys, k, largest=False)
        width = min(k, best.shape[1] + found.shape[1])
        both = np.full((len(rows), best.shape[1] + found.shape[1]), np.inf)
        names = np.full(both.shape, np.iinfo(np.int64).max)
        both[:, : best.shape[1]], names[:, : best.shape[1]] = best, partners
        both[open_, best.shape[1] :], names[open_, best.shape[1] :] = scores, found
        order = np.lexsort((names, both), axis=1)[:, :width]
        best, partners = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
    return partners, best


def nearest_of_blocks(left: DataFrame, layout: Layout, measure: Measure, k: int, keys: Sequence[str], vector: str, schema: str) -> DataFrame:
    """keys, partners, scores (signed) of every left row; the rows stay in their tasks."""
    shared = left.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        storage, root = fs.FileSystem.from_uri(_local(layout.path))
        kept: OrderedDict = OrderedDict()

        def load(block: int) -> tuple[np.ndarray, np.ndarray]:
            if block not in kept:
                table = ds.dataset(f"{root}/block={block}", filesystem=storage, format="parquet").to_table(columns=[layout.key, "vector"])
                names, vectors = table[layout.key].to_numpy(), matrix(table["vector"])
                order = np.argsort(names, kind="stable")
                kept[block] = names[order], vectors[order]
                if len(kept) > KEPT_BLOCKS:
                    kept.popitem(last=False)
            kept.move_to_end(block)
            return kept[block]

        step = max(1, TABLE_CELLS // max(BLOCK_ROWS, len(layout.block)))
        for batch in batches:
            rows = matrix(batch.column(len(keys)))
            for at in range(0, batch.num_rows, step):
                partners, scores = search(rows[at : at + step], layout, measure, k, load)
                columns = [c.slice(at, len(partners)) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*columns, lists_of(partners), lists_of(scores)], [*keys, "partners", "scores"])

    return left.select(*keys, F.col(vector).alias("vector")).mapInArrow(run, schema)
