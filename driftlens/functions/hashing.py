"""Seeded draws that any SQL engine with md5 can repeat."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.arrow import segment_starts


def _as_column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by ':'; plain values count as literals."""
    return F.md5(F.concat_ws(":", *[_as_column(p).cast("string") for p in parts]))


def hits(sizes: np.ndarray, keys: Sequence[str | None], name: str, p: float) -> np.ndarray:
    """Whether the draw of each item has probability p; row i has sizes[i] items, the rows follow each other.

    A draw is eight hex digits of hash_hex(name, key, k // 4), so one md5 gives four of them and any SQL engine the same ones.
    """
    quads = (sizes + 3) // 4
    starts = [f"{name}:" if key is None else f"{name}:{key}:" for key in keys]
    digests = (md5(f"{start}{k}".encode(), usedforsecurity=False).digest() for start, n in zip(starts, quads.tolist()) for k in range(n))
    dice = np.frombuffer(b"".join(digests), ">u4")
    # The last md5 of a row may give more draws than are left to make.
    surplus = 4 * quads - sizes
    spare = np.repeat(np.cumsum(4 * quads) - surplus - segment_starts(surplus), surplus) + np.arange(surplus.sum())
    return np.delete(dice, spare) < np.uint64(int(min(p, 1.0) * 2**32))


def hash_key(*parts) -> Column:
    """60 hash bits as a non-negative long: the order of every seeded shuffle."""
    return F.conv(F.substring(hash_hex(*parts), 1, 15), 16, 10).cast("long")
