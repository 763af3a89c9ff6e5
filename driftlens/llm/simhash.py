"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of the Hamming code on all but one bit (covering radius 1), times both values of the last bit.
Every fingerprint goes to each anchor within `REACH` = radius + ceil(threshold / 2). Two fingerprints at 2 bits or fewer
have a fingerprint between them that is at most one bit from both, and that one has an anchor at most one bit away: so both
reach that anchor, and no link is lost. An anchor receives at most 1 + n + n(n-1)/2 different n-bit fingerprints, whatever the data:
groups are bounded by construction (2,081 for 64 bits), copies having been merged before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import as_bytes, drop_rows, keep_likely, map_batches, popcount, row_key
from driftlens.llm.graph import components
from driftlens.session import materialize

WIDTH = 3
THRESHOLD = 2
RADIUS = 1
REACH = RADIUS + (THRESHOLD + 1) // 2
SEED = 42
# Bit sums are taken over this many shingles at a time.
SHINGLES_AT_ONCE = 1 << 15


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the `width`-word shingles, repeats included; fewer words make one shingle, none make none."""
    words = text.lower().split()  # of bytes: lowers A-Z and splits at white space of ASCII, nothing else
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][: len(words) - width + 1]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(starts))


def majority_bits(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        sums += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(sums * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key (of the row), fp (the 64 bits as a long). A NULL text has no words."""

    def step(batch: pa.RecordBatch) -> dict:
        found = [majority_bits(shingle_hashes(t, width)) for t in as_bytes(batch.column(2))]
        return {"doc_id": batch.column(0), "key": batch.column(1), "fp": np.array(found, np.uint64).view(np.int64)}

    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("key"), F.col("text").cast("string"))
    return map_batches(rows, step, "doc_id long, key long, fp long")


def anchors_of(fps: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor within REACH.

    `bits` - 1 must be 2^m - 1. Bit i < bits - 1 has the position i + 1; a code word's positions xor to zero.
    """
    n, one = bits - 1, np.uint64(1)
    syndrome = np.zeros(len(fps), np.uint64)
    for p in range(1, n + 1):
        syndrome ^= ((fps >> np.uint64(p - 1)) & one) * np.uint64(p)
    index = np.arange(len(fps))
    at_word, off = index[syndrome == 0], index[syndrome != 0]
    last = np.uint64(1 << n)

    def flip(x: np.ndarray, position: np.ndarray) -> np.ndarray:
        return x ^ (one << (position - one))

    rows, anchors = [at_word, at_word], [fps[at_word], fps[at_word] ^ last]
    x, s = fps[off], syndrome[off]
    near = flip(x, s)
    rows += [off, off]
    anchors += [near, near ^ last]
    for p in range(1, n + 1):
        other = s ^ np.uint64(p)
        pair = other > p  # each pair of positions once; never the position itself or zero
        rows.append(off[pair])
        anchors.append(flip(flip(x[pair], np.full(pair.sum(), p, np.uint64)), other[pair]))
    return np.concatenate(rows), np.concatenate(anchors)


def local_stars(values: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(least member, member) of every component of a small link matrix."""
    label = np.arange(len(values))
    while True:
        least = np.where(linked, label[None, :], len(values)).min(axis=1)
        least = np.minimum(least, label)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(values[r]), int(values[i])) for i, r in enumerate(label) if r != i]


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of different fingerprints; their components are those of all links at THRESHOLD bits or fewer."""

    def spread(batch: pa.RecordBatch) -> dict:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        row, anchor = anchors_of(fp)
        return {"anchor": anchor.view(np.int64), "fp": fp[row].view(np.int64)}

    def compare(batch: pa.RecordBatch) -> dict:
        sizes = np.diff(batch.column(0).offsets.to_numpy())
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        twos = starts[sizes == 2]
        x, y = flat[twos], flat[twos + 1]
        near = popcount(x ^ y) <= THRESHOLD
        a, b = [x[near].view(np.int64)], [y[near].view(np.int64)]
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            members = np.unique(flat[at : at + size])
            stars = local_stars(members.view(np.int64), popcount(members[:, None] ^ members[None, :]) <= THRESHOLD)
            if stars:
                pairs = np.array(stars, np.int64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        return {"a": np.concatenate(a), "b": np.concatenate(b)}

    placed = map_batches(fps.select("fp"), spread, "anchor long, fp long")
    groups = placed.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return map_batches(groups, compare, "a long, b long").distinct()


def _roots(nodes: DataFrame) -> DataFrame:
    """Different fingerprints (fp, ...) with the root of their component."""
    roots = components(links(nodes))
    return nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per document, in no order.

    Components join fingerprints that differ in at most THRESHOLD bits. Documents with equal fingerprints (copies, and all
    texts without a word) are one node. NULL text: no words, fingerprint zero. NULL doc_id: stays a row, and is passed over in
    the least id of its component (NULL if it has no other). Repeated rows and ids stay as they are; other columns
    are not read. An empty table gives an empty table.
    """
    marked = materialize(fingerprints(docs, width).drop("key"))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = materialize(_roots(nodes))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(of_fp, marked.fp == of_fp.of_fp).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id (then row key); all columns are kept.

    Groups are the components of `near_duplicates`, so of all texts without a word one stays. Of rows with equal id and text, one
    stays. A NULL id stays only where its group has no other. An empty table gives an empty table.
    """
    marked = materialize(fingerprints(docs, width).groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")))
    named = materialize(_roots(nodes))
    chosen = named.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = named.select("fp", "root").join(chosen, "root").select("fp", "first")
    stays = (F.col("key") == F.col("first.key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    told = materialize(marked.join(of_fp, "fp").select("doc_id", "key", stays.alias("stays"), "n"))
    kept = drop_rows(docs, told.where(~F.col("stays") | (F.col("n") > 1)))
    several = told.where(F.col("stays") & (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    if several.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = keep_likely(docs.select(row, F.col("doc_id").alias("_own"), row_key().alias("_hash")), "_hash", several.select("_key"))
    again = rows.join(several, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key")))
    return kept.unionAll(again.dropDuplicates(["_id", "_key"]).select("row.*"))
