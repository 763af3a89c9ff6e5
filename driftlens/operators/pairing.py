"""Rows against reference rows, as matrix blocks.

Both sides are packed into blocks of a bounded number of vectors; a task meets one pair of blocks at a
time and hands on only what the caller keeps of it (the best partners, counts). A reference that is
measured small travels to every task instead, and the rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions.arrow import lengths, matrix

BLOCK_ROWS = 1_024  # rows of a left block
REFERENCE_BLOCK_ROWS = 16_384  # rows of a right block, which is copied to every left block's task
REFERENCE_BLOCK_BYTES = 32 * 2**20
SMALL_REFERENCE_BYTES = 64 * 2**20  # every Python worker holds one copy
TABLE_CELLS = 2**24  # scores computed at a time

# (left keys, left vectors, right keys, right vectors) -> output columns for the left rows.
Emit = Callable[[dict, np.ndarray, np.ndarray, np.ndarray], dict]


def _blocks(df: DataFrame, by: Sequence[str], keys: Sequence[str], vector: str, block: Column, out: str) -> DataFrame:
    return (
        df.select(*by, block.alias(f"{out}_block"), F.struct(*keys, F.col(vector).alias("_v")).alias("_item"))
        .groupBy(*by, f"{out}_block")
        .agg(F.collect_list("_item").alias(out))
    )


def _unpack(items: pa.Array) -> Iterator[tuple[dict, np.ndarray]]:
    """Per row: key arrays and the matrix of a packed block."""
    sizes, flat = lengths(items), items.flatten()
    names = [f.name for f in flat.type if f.name != "_v"]
    fields = dict(zip([f.name for f in flat.type], flat.flatten()))
    vectors = matrix(fields["_v"])
    keys = {n: fields[n].to_numpy(zero_copy_only=False) for n in names}
    end = 0
    for size in sizes:
        start, end = end, end + size
        yield {n: k[start:end] for n, k in keys.items()}, vectors[start:end]


def against_reference(
    left: DataFrame,
    right: DataFrame,
    emit: Emit,
    schema: str,
    left_keys: Sequence[str],
    right_key: str,
    vector: str = "vector",
    small_bytes: int = SMALL_REFERENCE_BYTES,
    block_rows: int = BLOCK_ROWS,
    reference_rows: int = REFERENCE_BLOCK_ROWS,
) -> tuple[DataFrame, bool]:
    """Every left row against all right rows. The flag tells whether a left row was emitted once per block."""
    spark = left.sparkSession
    count, width = right.agg(F.count("*"), F.max(F.size(vector))).first()
    if 8 * count * (width or 0) <= small_bytes:
        rows = right.select(right_key, vector).orderBy(right_key).toArrow()
        shared = spark.sparkContext.broadcast((rows[right_key].to_numpy(), matrix(rows[vector])))

        def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            right_keys, reference = shared.value
            step = max(1, TABLE_CELLS // max(1, len(right_keys)))
            for batch in batches:
                keys = {k: batch[k].to_numpy(zero_copy_only=False) for k in left_keys}
                rows = matrix(batch[vector])
                for at in range(0, batch.num_rows, step):
                    part = slice(at, at + step)
                    found = emit({k: v[part] for k, v in keys.items()}, rows[part], right_keys, reference)
                    yield pa.RecordBatch.from_pydict(found)

        return left.select(*left_keys, vector).mapInArrow(stay, schema), False

    reference_rows = max(1, min(reference_rows, REFERENCE_BLOCK_BYTES // (8 * width)))
    parts = -(-count // reference_rows)
    rows = max(1, left.count())
    right_block = F.pmod(F.xxhash64(right_key), F.lit(parts))
    left_block = F.pmod(F.xxhash64(*left_keys), F.lit(-(-rows // block_rows)))
    right_side = _blocks(right, [], [right_key], vector, right_block, "right")
    left_side = _blocks(left, [], left_keys, vector, left_block, "left")
    met = left_side.withColumn("right_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return _meet(met.join(right_side, "right_block"), [], right_key, emit, schema), True


def within_group(
    left: DataFrame,
    right: DataFrame,
    by: str,
    emit: Emit,
    schema: str,
    left_keys: Sequence[str],
    right_key: str,
    vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, bool]:
    """Every left row against the right rows of its group. ``right_key`` and the first left key are
    unique whole numbers per group, so a block is a range of them and a large group is many blocks."""
    left_block = F.floor(F.col(left_keys[0]) / block_rows)
    right_block = F.floor(F.col(right_key) / block_rows)
    right_side = _blocks(right, [by], [right_key], vector, right_block, "right")
    left_side = _blocks(left, [by], left_keys, vector, left_block, "left")
    several = right.agg(F.max(right_block) > F.min(right_block)).first()[0]
    if several:
        left_side = left_side.join(right.select(by, right_block.alias("right_block")).distinct(), by)
        met = left_side.join(right_side, [by, "right_block"])
    else:
        met = left_side.join(right_side, by)
    return _meet(met, [by], right_key, emit, schema), bool(several)


def _meet(met: DataFrame, by: Sequence[str], right_key: str, emit: Emit, schema: str) -> DataFrame:
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(_unpack(batch["left"]), _unpack(batch["right"]))
            for row, ((keys, mine), (others, theirs)) in enumerate(pairs):
                order = np.argsort(others[right_key], kind="stable")
                columns = emit(keys, mine, others[right_key][order], theirs[order])
                rows = len(next(iter(columns.values())))
                for name in by:
                    columns[name] = np.repeat(batch[name][row].as_py(), rows)
                yield pa.RecordBatch.from_pydict(columns)

    return met.select(*by, "left", "right").mapInArrow(tasks, schema)


def best_partners(scores: np.ndarray, right_keys: np.ndarray, k: int, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(partners, scores) of the k best columns per row, best first; equal scores by lower key."""
    signed = -scores if largest else scores
    k = min(k, scores.shape[1])
    if k == 1:
        places = signed.argmin(axis=1)[:, None]
    elif scores.shape[1] <= 8 * k:
        places = np.argsort(signed, axis=1, kind="stable")[:, :k]
    else:
        places = np.empty((len(signed), k), dtype=np.int64)
        worst = np.partition(signed, k - 1, axis=1)[:, k - 1]
        for row, values in enumerate(signed):
            near = np.flatnonzero(values <= worst[row])
            places[row] = near[np.argsort(values[near], kind="stable")[:k]]
    return right_keys[places], np.take_along_axis(scores, places, axis=1)


def merge_partners(found: DataFrame, keys: Sequence[str], k: int, largest: bool) -> DataFrame:
    """Best k per row out of the best k per block."""
    pairs = found.select(*keys, F.explode(F.arrays_zip("partners", "scores")).alias("_p"))
    order = F.desc("_p.scores") if largest else F.asc("_p.scores")
    ranked = pairs.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order, "_p.partners")))
    lists = ranked.where(F.col("_rn") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "_p"))).alias("_l"))
    return lists.select(
        *keys,
        F.transform("_l", lambda s: s["_p"]["partners"]).alias("partners"),
        F.transform("_l", lambda s: s["_p"]["scores"]).alias("scores"),
    )
