"""Caps, slices and split recipes with exact sizes. Row order is the order of ``row_id``."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.operators.ordering import keys_at_ranks, split_by_hash


class Piece(NamedTuple):
    """Rows [start:stop] of split ``source`` (slice rules, None = open end) go to ``target``, ``times`` over."""

    target: str
    source: str
    start: int | None = None
    stop: int | None = None
    times: int = 1


def _slice_test(n: int, found: dict, key: str, start: int | None, stop: int | None) -> Column:
    low, high, _ = slice(start, stop).indices(n)
    if low >= high:
        return F.lit(False)
    test = F.lit(True)
    if low > 0:
        test = test & (F.col(key) >= F.lit(found[low]))
    if high < n:
        test = test & (F.col(key) < F.lit(found[high]))
    return test


def _edges(slices: Sequence[tuple[int | None, int | None]]) -> Callable[[int], list[int]]:
    return lambda n: [edge for s in slices for edge in slice(*s).indices(n)[:2]]


def _slice_tests(df: DataFrame, slices: Sequence[tuple[int | None, int | None]], key: str) -> list[Column]:
    """One predicate per slice; only slices with a bound need a look at the data."""
    if all(not start and stop is None for start, stop in slices):
        return [F.lit(True) for _ in slices]
    n, found = keys_at_ranks(df, key, _edges(slices))
    return [_slice_test(n, found, key, start, stop) for start, stop in slices]


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, key: str = "row_id") -> DataFrame:
    """Contiguous rows [start:stop]; the bounds become key predicates, which reach a Parquet scan."""
    return df.where(_slice_tests(df, [(start, stop)], key)[0])


def tail_rows(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """The last n rows."""
    return slice_rows(df, -n, None, key) if n else df.where(F.lit(False))


def cap(df: DataFrame, n: int | None | Mapping[str, int | None], key: str | None = None) -> DataFrame:
    """First n rows per split: 0 is empty, negative drops the last rows, None keeps all.

    Rows are ordered by ``part`` where ``recompose`` set it, then by ``key``: ``order_key`` where a
    recipe set it, else ``row_id``.
    """
    key = key or ("order_key" if "order_key" in df.columns else "row_id")
    if "split" not in df.columns:
        return slice_rows(df, None, n, key) if n is not None else df
    has_part = "part" in df.columns
    group = ["split", "part"] if has_part else ["split"]
    sizes = {tuple(r[:-1]): r[-1] for r in df.groupBy(*group).count().collect()}
    tests = []
    for split in sorted({g[0] for g in sizes}):
        limit = n.get(split) if isinstance(n, Mapping) else n
        pieces = sorted(g for g in sizes if g[0] == split)
        left = slice(None, limit).indices(sum(sizes[g] for g in pieces))[1]
        for piece in pieces:
            take = min(left, sizes[piece])
            left -= take
            if take == 0:
                continue
            test = F.col("split") == piece[0]
            if has_part:
                test = test & (F.col("part") == piece[1])
            if take < sizes[piece]:
                test = test & _slice_tests(df.where(test), [(None, take)], key)[0]
            tests.append(test)
    return df.where(reduce(Column.__or__, tests, F.lit(False)))


def split_fraction(df: DataFrame, fractions: Sequence[float], names: Sequence[str], key: str = "row_id") -> DataFrame:
    """Contiguous split: floor(fraction * n) rows per leading part, the rest to the last name."""

    def cuts(n: int) -> list[int]:
        edges = []
        for fraction in fractions:
            edges.append((edges[-1] if edges else 0) + math.floor(fraction * n))
        return edges

    n, found = keys_at_ranks(df, key, cuts)
    label = F.lit(names[-1])
    for name, edge in reversed(list(zip(names, cuts(n)))):
        label = F.when(F.col(key) < F.lit(found[edge]), name).otherwise(label) if edge < n else F.lit(name)
    return df.withColumn("split", label)


def holdout(
    df: DataFrame, fraction: float = 0.1, seed: int = 42, row_id: str = "row_id", order_key: bool = False
) -> DataFrame:
    """The last floor(fraction * n) rows of a seeded shuffle become validation, the others train."""

    def cuts(n: Column) -> list[Column]:
        return [n - F.floor(F.lit(fraction) * n)]

    return split_by_hash(df, ("train", "validation"), cuts, seed=seed, row_id=row_id, order_key=order_key)


def prefix_holdout(
    df: DataFrame, share: int = 10, fraction: float = 0.1, seed: int = 42, order_key: bool = False
) -> DataFrame:
    """Keep the first n // share rows, then hold out from those."""
    n, found = keys_at_ranks(df, "row_id", lambda n: [n // share])
    keep = n // share
    first = df.where(F.col("row_id") < F.lit(found[keep])) if keep < n else df
    return holdout(first, fraction, seed, order_key=order_key)


def split_stratified(
    df: DataFrame,
    by: str,
    fractions: Sequence[float] = (0.8, 0.1),
    seed: int = 42,
    row_id: str = "row_id",
    order_key: bool = False,
) -> DataFrame:
    """Seeded shuffle inside each group, then floor(fraction * n) rows per part, the rest to test."""

    def cuts(n: Column) -> list[Column]:
        sizes = [F.floor(F.lit(f) * n) for f in fractions]
        return [reduce(Column.__add__, sizes[: i + 1]) for i in range(len(sizes))]

    return split_by_hash(
        df, ("train", "validation", "test"), cuts, by=[by], seed=seed, row_id=row_id, order_key=order_key
    )


def recompose(df: DataFrame, recipe: Sequence[Piece], key: str = "row_id") -> DataFrame:
    """New splits from slices of old ones; pieces may overlap or repeat.

    Each row is read once and emitted for every piece it belongs to; ``part`` is the piece's position,
    so (part, row_id) is the order of the new split.
    """
    tests: list[Column] = [F.lit(False)] * len(recipe)
    for source in {p.source for p in recipe}:
        mine = [i for i, p in enumerate(recipe) if p.source == source]
        old = df.where(F.col("split") == source)
        for i, test in zip(mine, _slice_tests(old, [(recipe[i].start, recipe[i].stop) for i in mine], key)):
            tests[i] = (F.col("split") == source) & test
    homes, part = [], 0
    for piece, test in zip(recipe, tests):
        for _ in range(piece.times):
            homes.append(F.when(test, F.struct(F.lit(piece.target).alias("split"), F.lit(part).alias("part"))))
            part += 1
    kept = [c for c in df.columns if c not in ("split", "part")]
    return (
        df.where(reduce(Column.__or__, tests))
        .withColumn("_home", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull())))
        .select(*kept, "_home.split", "_home.part")
    )


def union_all(*dfs: DataFrame) -> DataFrame:
    """Concatenate by column name, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
