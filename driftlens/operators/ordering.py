"""Exact order statistics without a global sort.

A slice, a split or a quantile needs the key found at some rank, not the rank of every row. These
helpers find such keys from bucket counts (partial aggregation, a few thousand numbers) and look
closely only at the buckets that hold a wanted rank. Rows themselves are never sorted or moved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions.hashing import hash_key
from driftlens.session import broadcast_if_small, materialize

LEAF_ROWS = 200_000  # a bucket this small is ranked by one task
FAN_OUT = 1_000  # splitters per bucket and round
MAX_EDGES = 20_000  # splitters per round over all buckets
HASH_SHIFT = 44  # top 16 of the 60 hash bits: 65,536 even buckets


def _bucketed(keys: DataFrame, edges: Sequence[float]) -> DataFrame:
    if len(edges) == 2:
        return keys.withColumn("b", F.lit(0.0))
    model = Bucketizer(splits=list(edges), inputCol="d", outputCol="b", handleInvalid="keep")
    return model.transform(keys)


def keys_at_ranks(
    df: DataFrame,
    key: str,
    ranks: Callable[[int], Iterable[int]] | Iterable[int],
    leaf_rows: int = LEAF_ROWS,
    fan_out: int = FAN_OUT,
    skip_missing: bool = False,
) -> tuple[int, dict[int, object]]:
    """(row count, {zero-based rank: key at that rank in ascending order}).

    A NULL or NaN key has no place in the order and raises, unless such rows are to be skipped.

    Ranks outside the table are left out. ``ranks`` may be a function of the row count. Exact for any
    numeric key: each round splits the buckets that hold a wanted rank at sampled quantiles (each
    splitter gets a bucket of its own, so one value may fill any share of the table) and recounts.
    """
    keys = df.select(F.col(key).alias("k"), (F.col(key).cast("double") + F.lit(0.0)).alias("d"))
    placed = F.col("k").isNotNull() & ~F.isnan("d")
    kept = F.when(placed, F.col("k"))
    every, n, low, high = keys.agg(F.count("*"), F.count(kept), F.min(kept), F.max(kept)).first()
    if n < every and not skip_missing:
        raise ValueError(f"{every - n} rows have no {key}")
    keys = keys.where(placed)
    edges = [-math.inf, math.inf]
    wanted = sorted({r for r in (ranks(n) if callable(ranks) else ranks) if 0 <= r < n})
    if not wanted:
        return n, {}
    counts = [(0.0, n, low, high)]
    while True:
        found, open_ranks, before = {}, {}, 0
        for bucket, size, low, high in counts:
            for rank in (r for r in wanted if before <= r < before + size):
                if low == high:
                    found[rank] = low
                else:
                    open_ranks.setdefault(bucket, []).append((rank, rank - before))
            before += size
        sizes = {bucket: (size, low, high) for bucket, size, low, high in counts}
        large = [b for b in open_ranks if sizes[b][0] > leaf_rows]
        fresh = _splitters(keys, edges, large, sizes, fan_out) - set(edges) if large else set()
        if not fresh:
            break
        edges = sorted(set(edges) | fresh)
        counts = sorted(
            tuple(row)
            for row in _bucketed(keys, edges)
            .groupBy("b")
            .agg(F.count("k"), F.min("k"), F.max("k"))
            .collect()
        )
    if open_ranks:
        found |= _leaf_keys(keys, edges, open_ranks, sizes)
    return n, found


def _within(sizes: dict, buckets: Iterable[float]) -> Column:
    """Range predicate over the raw key, so it reaches the scan."""
    test = F.lit(False)
    for bucket in buckets:
        _, low, high = sizes[bucket]
        test = test | F.col("k").between(F.lit(low), F.lit(high))
    return test


def _splitters(keys, edges, buckets, sizes, fan_out) -> set[float]:
    fan_out = max(2, min(fan_out, MAX_EDGES // len(buckets)))
    shares = [i / fan_out for i in range(1, fan_out)]
    rows = (
        _bucketed(keys.where(_within(sizes, buckets)), edges)
        .where(F.col("b").isin(buckets))
        .groupBy("b")
        .agg(F.percentile_approx("d", shares, 10 * fan_out).alias("q"))
        .collect()
    )
    cuts = {q for row in rows for q in row["q"] if math.isfinite(q)}
    return cuts | {float(np.nextafter(q, math.inf)) for q in cuts}


def _leaf_keys(keys, edges, open_ranks, sizes) -> dict[int, object]:
    spark = keys.sparkSession
    wanted = [(b, rank, offset + 1) for b, pairs in open_ranks.items() for rank, offset in pairs]
    wanted = spark.createDataFrame(wanted, "b double, rank long, rn int")
    ranked = (
        _bucketed(keys.where(_within(sizes, open_ranks)), edges)
        .where(F.col("b").isin(list(open_ranks)))
        .withColumn("rn", F.row_number().over(W.partitionBy("b").orderBy("k")))
    )
    rows = ranked.join(F.broadcast(wanted), ["b", "rn"]).select("rank", "k").collect()
    return {row["rank"]: row["k"] for row in rows}


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, for any number of shares in the same rounds."""

    def neighbours(n: int) -> list[int]:
        return [r for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))]

    n, found = keys_at_ranks(df, column, neighbours, skip_missing=True)
    if n == 0:
        return [None] * len(shares)
    result = []
    for q in shares:
        position = q * (n - 1)
        low, high = found[math.floor(position)], found[math.ceil(position)]
        result.append(float(low) + (float(high) - float(low)) * (position - math.floor(position)))
    return result


def running_total(
    df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over the rows before each row, per ``by`` group.

    ``bucket`` must not decrease along ``order``. Only bucket totals are summed per group; rows are
    summed per (group, bucket), so a group of any size is spread over its buckets.
    """
    before = W.unboundedPreceding, -1
    offsets = (
        df.groupBy(*by, bucket)
        .agg(F.sum(value).alias("_sum"))
        .withColumn(
            "_offset",
            F.coalesce(F.sum("_sum").over(W.partitionBy(*by).orderBy(bucket).rowsBetween(*before)), F.lit(0)),
        )
        .drop("_sum")
    )
    inner = F.sum(value).over(W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(*before))
    return (
        df.withColumn(out, F.coalesce(inner, F.lit(0)))
        .join(offsets, [*by, bucket])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_offset")
    )


def split_by_hash(
    df: DataFrame,
    names: Sequence[str],
    cut_ranks: Callable[[Column], Sequence[Column]],
    by: Sequence[str] = (),
    seed: int = 42,
    row_id: str = "row_id",
    order_key: bool = False,
) -> DataFrame:
    """Label every row with the part of the seeded shuffle it falls in, per ``by`` group, exact sizes.

    ``cut_ranks(n)`` gives the ranks (as columns over the group size) where a new part begins. Sizes
    come from counts per hash bucket; only rows of the buckets with a cut in them are ranked.
    ``order_key`` keeps the shuffle position of the rows as a column.
    """
    keyed = df.withColumn("_h", hash_key(seed, F.col(row_id)))
    keyed = keyed.withColumn("_b", F.shiftright("_h", HASH_SHIFT))
    groups = [f"_g{i}" for i in range(len(by))]
    slim = keyed.select(
        *[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(row_id).alias("_id"), "_h", "_b"
    )
    histogram = (
        slim.groupBy(*groups, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(W.partitionBy(*groups).orderBy("_b")))
        .withColumn("_size", F.sum("_n").over(W.partitionBy(*groups)))
    )
    ranks = F.array(*[r.cast("long") for r in cut_ranks(F.col("_size"))])
    start = F.col("_end") - F.col("_n")
    edges = materialize(
        histogram.select("*", F.posexplode(ranks).alias("_cut", "_rank"))
        .where((F.col("_rank") >= start) & (F.col("_rank") < F.col("_end")))
        .select(
            *[F.col(g).alias(f"{g}_e") for g in groups],
            F.col("_b").alias("_b_e"),
            "_cut",
            (F.col("_rank") - start + 1).alias("_rn_e"),
        )
    )
    same_bucket = _null_safe([*groups, "_b"], [*[f"{g}_e" for g in groups], "_b_e"])
    near = broadcast_if_small(edges.select(*[f"{g}_e" for g in groups], "_b_e").distinct())
    in_bucket = W.partitionBy(*groups, "_b").orderBy("_h", "_id")
    ranked = slim.join(near, same_bucket, "left_semi").withColumn("_rn", F.row_number().over(in_bucket))
    parts = len(names) - 1
    here = F.struct(F.col("_h").alias("h"), F.col("_id").alias("id"))
    cuts = (
        ranked.join(edges, same_bucket & (F.col("_rn") == F.col("_rn_e")))
        .groupBy(*[F.col(g).alias(f"{g}_e") for g in groups])
        .agg(*[F.max(F.when(F.col("_cut") == i, here)).alias(f"_cut{i}") for i in range(parts)])
    )
    if by:
        keyed = keyed.join(broadcast_if_small(cuts), _null_safe(by, [f"{g}_e" for g in groups]), "left")
        bounds = [F.col(f"_cut{i}") for i in range(parts)]
    else:
        row = cuts.first()
        bounds = [
            F.struct(F.lit(row[i]["h"]).alias("h"), F.lit(row[i]["id"]).alias("id")) if row[i] else F.lit(None)
            for i in range(parts)
        ]
    here = F.struct(F.col("_h").alias("h"), F.col(row_id).alias("id"))
    label = F.lit(names[-1])
    for name, bound in reversed(list(zip(names, bounds))):
        label = F.when(bound.isNull() | (here < bound), F.lit(name)).otherwise(label)
    kept = [F.col(c) for c in df.columns if c != "split"]
    if order_key:
        kept.append(F.col("_h").alias("order_key"))
    return keyed.select(*kept, label.alias("split"))


def _null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    test = F.lit(True)
    for a, b in zip(left, right):
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test
