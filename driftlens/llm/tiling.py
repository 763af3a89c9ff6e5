"""Benchmark decontamination by greedy string tiling.

A document and a test item become a pair if they share a seed, SHORTEST consecutive words. In a pair the longest match of words that are
not marked yet, found by Karp-Rabin hashes of SHORTEST words that run on along one diagonal, is marked as a tile in both, again and again, until no match
of SHORTEST words is left. The part of the item under tiles is its coverage; reordered passages keep theirs, as tiles may come in
any order. Items come in blocks of bounded size, each sent to all tasks; every block reads the documents once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import drop_rows, row_key, text_batches
from driftlens.session import materialize

SHORTEST = 5
COVERAGE = 0.8
# Bytes of item texts per block (words and seeds of a block take about ten times as much in a task).
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"[^\W_]+")
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def seed_hashes(ids: np.ndarray) -> np.ndarray:
    """Polynomial hashes of every SHORTEST consecutive numbers."""
    n = len(ids) - SHORTEST + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(SHORTEST):
        h = h * _RADIX + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return h


class Items:
    """Word numbers and seeds of a block of test items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        numbered = [(item, np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int64)) for item, text in items]
        found = [(item, words, seed_hashes(words)) for item, words in numbered if len(words) >= SHORTEST]
        self.names, self.words = [item for item, _, _ in found], [words for _, words, _ in found]
        hashes = np.concatenate([h for _, _, h in found]) if found else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(h), i) for i, (_, _, h) in enumerate(found)]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for _, _, h in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]

    def coverages(self, text: str | None) -> list[tuple[int, float]]:
        """(item, coverage) of every item that shares a seed with the text."""
        words = words_of(text)
        if len(words) < SHORTEST or not len(self.hashes):
            return []
        number = self.vocabulary.get
        ids = np.array([number(w, -1) for w in words], np.int64)
        known = np.convolve(ids >= 0, np.ones(SHORTEST, np.int64), "valid") == SHORTEST
        at = np.flatnonzero(known)
        if not len(at):
            return []
        hashes = seed_hashes(ids)[at]
        low, high = (np.searchsorted(self.hashes, hashes, side) for side in ("left", "right"))
        some = high > low
        at, low, high = at[some], low[some], high[some]
        if not len(at):
            return []
        count = high - low
        entry = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place_in_text, owner, place = np.repeat(at, count), self.owner[entry], self.place[entry]
        out = []
        for o in np.unique(owner).tolist():
            mine = owner == o
            item = self.words[o]
            covered = tile(ids, item, place_in_text[mine], place[mine])
            if covered:
                out.append((self.names[o], covered / len(item)))
        return out


def tile(text: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray) -> int:
    """Words of the item under tiles. (i, j) are the places of equal seed hashes; their words are compared."""
    reach = np.arange(SHORTEST)
    true = (text[i[:, None] + reach] == item[j[:, None] + reach]).all(axis=1)
    i, j = i[true], j[true]
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    marked = 0
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    while len(i):
        diagonal = i - j
        new = np.ones(len(i), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (i[1:] != i[:-1] + 1)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(i)])
        best = starts[np.lexsort((i[starts], j[starts], -sizes))[0]]
        length = int(sizes.max()) + SHORTEST - 1
        free_text[i[best] : i[best] + length] = False
        free_item[j[best] : j[best] + length] = False
        marked += length
        still = free_text[i[:, None] + reach].all(axis=1) & free_item[j[:, None] + reach].all(axis=1)
        i, j = i[still], j[still]
    return marked


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage for every document that holds at least this part of an item.

    Words are letters and digits in lower case, so punctuation, case and white space don't matter. NULL and empty texts, and items under
    SHORTEST words, match nothing. Rows that repeat each give their pairs, and items with equal ids
    each count for themselves. A NULL item_id is left out; a NULL doc_id stays. Other columns are not read.
    """
    return _matches(docs, benchmark, coverage).drop("key")


def _matches(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """As `matches`, with the document's key beside its id."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / BLOCK_BYTES))
    text_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), F.col("text").cast("string"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    out = None
    for part in range(parts):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()]
        shipped = context.broadcast(Items(sorted(block)))

        def step(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            known = shipped.value
            for batch in batches:
                found = [
                    (doc, key, item, share)
                    for doc, key, text in zip(*(batch.column(k).to_pylist() for k in range(3)))
                    for item, share in known.coverages(text)
                    if share >= coverage
                ]
                columns = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "key", "item_id", "coverage"]
                )

        told = rows.mapInArrow(step, "doc_id long, key long, item_id long, coverage double")
        out = told if out is None else out.union(told)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents without those that `matches` finds, all columns kept. A NULL or repeated id is judged row by row with its text."""
    return drop_rows(docs, materialize(_matches(docs, benchmark, coverage).select("doc_id", "key").distinct()))
