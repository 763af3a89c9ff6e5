"""Removal of repeated byte strings by sorting suffixes.

Wanted is every byte under a string of WIDTH bytes that starts anywhere else too. Sorting all suffixes would move a text WIDTH times over,
so only suffixes that can matter are sorted:

1. Each window of WIDTH bytes has an anchor, the place in it where the SEED-byte string has the least hash (leftmost of equals). That
   depends on the window alone, so equal windows have equal seeds at equal places. Windows that follow each other share anchors: a run.
2. Runs whose seed stands at one place of one distinct text only cannot repeat. The others become segments (all bytes of
   their windows); equal segments are counted and merged before anything is compared.
3. The suffixes at the anchors, with the bytes before them, are range-partitioned by their first SEED bytes with splitters that Spark samples,
   so windows that may be equal meet in one bucket and none lies across a boundary. A bucket sorts its suffixes, and the bytes before the anchors
   read backwards, keyed by one place after the other; lengths of common prefixes of neighbours then tell the groups of equal windows.
4. Seeds with more than HOT places could fill a bucket; their windows are counted by a 128-bit digest over all tasks instead.

Copies of whole texts are one text with a count, settled by their hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import keep_likely, map_batches, text_batches
from driftlens.llm.syncmers import mix
from driftlens.session import materialize, scratch_path

WIDTH = 200
SEED = 40
HOT = 200_000
# Bytes that are hashed at once, places of one piece (they fit the low bits of a key), suffixes that are sorted at once.
BLOCK = 1 << 20
PIECE = 1 << 22
PLACE_BITS = 24
SORTED = 5_000
# Rows whose bytes are gathered at once, and bytes of segments that leave a task at once.
GATHERED = 4_096
SEGMENT_BYTES = 4 << 20

_SPAN = WIDTH - SEED + 1  # seeds in a window
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(text's number, place, bytes); the windows of a long text are split among pieces, which overlap for that."""
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WIDTH + 1), PIECE):
            yield i, at, text[at : at + PIECE + WIDTH - 1]


def _runs_of_block(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(b) for _, _, b in held])
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join([b for _, _, b in held]), np.uint8)
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    whole, width = least, 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = len(whole) - _SPAN + 1
    least = np.minimum(least[:windows], least[_SPAN - width : _SPAN - width + windows])
    real = np.zeros(windows + 1, np.int8)
    enough = sizes >= WIDTH
    firsts, lasts = starts[enough], (starts + sizes - WIDTH)[enough]
    np.add.at(real, firsts, 1)
    np.add.at(real, lasts + 1, -1)
    inside = np.cumsum(real[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    begins[firsts] = True
    at = np.flatnonzero(begins)
    of = np.searchsorted(starts, at, side="right") - 1
    ends = np.minimum(np.r_[at[1:], windows], (starts + sizes - WIDTH + 1)[of])
    anchor = (least[at] & low).astype(np.int64)
    return of, at - starts[of], ends - at, anchor - at, h[anchor]


def runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, first window, number of windows, anchor's distance from the first window, seed) of all runs, piece by piece."""
    held, total = [], 0

    def flush() -> Iterator:
        of, first, number, anchor, seed = _runs_of_block(held)
        bounds = np.searchsorted(of, np.arange(len(held) + 1))
        for j, (i, at, _) in enumerate(held):
            part = slice(bounds[j], bounds[j + 1])
            if bounds[j + 1] > bounds[j]:
                yield i, first[part] + at, number[part], anchor[part], seed[part]

    for piece in _pieces(texts):
        if held and total + len(piece[2]) > BLOCK:
            yield from flush()
            held, total = [], 0
        held.append(piece)
        total += len(piece[2])
    if held:
        yield from flush()


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _seeds(docs: DataFrame) -> DataFrame:
    """h1, first, seed for every run of every text."""

    def step(batch: pa.RecordBatch) -> dict:
        hashes = batch.column(0).to_numpy(zero_copy_only=False)
        found = [(np.full(len(first), hashes[i]), first, seed) for i, first, _, _, seed in runs(_bytes(batch.column(1)))]
        joined = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return {"h1": joined[0], "first": joined[1], "seed": joined[2].view(np.int64)}

    return map_batches(docs.select("h1", "text"), step, "h1 long, first long, seed long")


def _segments(candidates: DataFrame) -> DataFrame:
    """h1, h2, first, number (of windows), anchor, hot, segment: all candidate runs with their bytes."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(2))
            wanted = [dict(zip(f, h)) for f, h in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            h1, h2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            held = 0
            for i, first, number, anchor, _ in runs(texts):
                for f, n, a in zip(first.tolist(), number.tolist(), anchor.tolist()):
                    if f in wanted[i]:
                        rows.append((h1[i], h2[i], f, n, a, wanted[i][f], texts[i][f : f + n + WIDTH - 1]))
                        held += n + WIDTH
                        if held > SEGMENT_BYTES:
                            yield _table(rows)
                            rows, held = [], 0
            if rows:
                yield _table(rows)

    return candidates.select("h1", "h2", "text", "firsts", "hots").mapInArrow(
        step, "h1 long, h2 long, first long, number int, anchor int, hot boolean, segment binary"
    )


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = ("h1", "h2", "first", "number", "anchor", "hot", "segment")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], list(names))


def _merged(segments: DataFrame) -> DataFrame:
    """Different segments with their number of places. A task merges what it has before the shuffle."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(zip(*(batch.column(k).to_pylist() for k in range(4))))
            if counts:
                columns = [*zip(*counts), list(counts.values())]
                kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], ["number", "anchor", "hot", "segment", "places"]
                )

    told = segments.select("number", "anchor", "hot", "segment").mapInArrow(
        step, "number int, anchor int, hot boolean, segment binary, places long"
    )
    return told.groupBy("segment", "number", "anchor", "hot").agg(F.sum("places").alias("places"))


def _side(flat: np.ndarray, at: np.ndarray, room: np.ndarray, width: int, step: int) -> np.ndarray:
    """`width` bytes from each place on, forwards or backwards; zeros beyond the segment."""
    reach = np.arange(width)
    out = np.empty((len(at), width), np.uint8)
    for first in range(0, len(at), GATHERED):
        part = slice(first, first + GATHERED)
        index = at[part, None] + step * reach
        beyond = reach >= room[part, None]
        index[beyond] = 0
        out[part] = flat[index]
        out[part][beyond] = 0
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix with the row before; 0 for the first."""
    differ = rows[1:] != rows[:-1]
    length = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[0, length]


def repeated_windows(segments: list[bytes], number: np.ndarray, anchor: np.ndarray, places: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each segment the runs [from, to) of its windows that equal another segment's window, or all if it has several places."""
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(segments), np.uint8)
    m = len(segments)
    right = _side(flat, starts + anchor, sizes - anchor, WIDTH, 1)
    by_right = _order(right)
    common = _common(right[by_right])
    kind = np.cumsum(common < SEED)  # suffixes with the same seed
    of = np.empty(m, np.int64)
    of[by_right] = kind
    left = _side(flat, starts + anchor - 1, anchor, _SPAN, -1)
    seed_first = np.concatenate([of.astype(">u8").view(np.uint8).reshape(m, 8), left], axis=1)
    by_left = _order(seed_first)
    common_left = _common(seed_first[by_left]) - 8  # under zero: another seed
    rows, ways = [], []
    group_right, group_left = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(_SPAN):  # windows that start d bytes before the anchor
        live = (anchor - number < d) & (d <= anchor)
        if not live.any():
            continue
        group_right[by_right] = np.cumsum(common < WIDTH - d)
        group_left[by_left] = np.cumsum(common_left < d)
        at = np.flatnonzero(live)
        key = group_right[at] * (m + 1) + group_left[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        twin = np.r_[False, same] | np.r_[same, False]
        rows.append(at[twin])
        ways.append((anchor[at] - d)[twin])
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    window = np.concatenate(ways) if ways else np.zeros(0, np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    for i, a, b in zip(row[at].tolist(), window[at].tolist(), window[np.r_[at[1:], len(row)] - 1].tolist() if len(at) else []):
        out[i].append((a, b + 1))
    for i in np.flatnonzero(places > 1).tolist():
        out[i] = [(0, int(number[i]))]
    return out


_FOUND = "segment binary, number int, anchor int, spans array<struct<a:int,b:int>>"


def _found(segments: list[bytes], number: list[int], anchor: list[int], spans: list) -> pa.RecordBatch:
    some = [i for i, s in enumerate(spans) if s]
    return pa.RecordBatch.from_pydict(
        {
            "segment": pa.array([segments[i] for i in some], pa.binary()),
            "number": pa.array([int(number[i]) for i in some], pa.int32()),
            "anchor": pa.array([int(anchor[i]) for i in some], pa.int32()),
            "spans": pa.array(
                [[{"a": a, "b": b} for a, b in spans[i]] for i in some],
                pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])),
            ),
        }
    )


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's rows come in the order of their leading bytes; they are sorted in parts that end where the leading bytes change."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        segments, number, anchor, places = (list(c) for c in zip(*rows))
        return _found(segments, number, anchor, repeated_windows(segments, np.array(number), np.array(anchor), np.array(places)))

    for batch in batches:
        held += zip(*(batch.column(k).to_pylist() for k in range(4)))
        if len(held) >= SORTED:
            lead = held[-1][0][held[-1][2] : held[-1][2] + SEED]
            cut = len(held)
            while cut and held[cut - 1][0][held[cut - 1][2] : held[cut - 1][2] + SEED] == lead:
                cut -= 1
            if cut:
                yield flush(held[:cut])
                held = held[cut:]
    if held:
        yield flush(held)


def _count_windows(merged: DataFrame) -> DataFrame:
    """For seeds with very many places: windows are counted by digest over all tasks."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[bytes, bytes, int, int, int, int]] = []
            for segment, number, anchor, places in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for w in range(number):
                    digest = hashlib.blake2b(segment[w : w + WIDTH], digest_size=16).digest()
                    rows.append((digest, segment, number, anchor, w, places))
                if len(rows) > 20_000:
                    yield _digest_rows(rows)
                    rows = []
            if rows:
                yield _digest_rows(rows)

    windows = merged.select("segment", "number", "anchor", "places").mapInArrow(
        digests, "digest binary, segment binary, number int, anchor int, at int, places long"
    )
    several = windows.groupBy("digest").agg(F.sum("places").alias("n")).where("n > 1").select("digest")
    spans = F.transform(F.array_sort(F.collect_set("at")), lambda w: F.struct(w.alias("a"), (w + 1).alias("b")))
    return windows.join(several, "digest").groupBy("segment", "number", "anchor").agg(spans.alias("spans"))


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    names = ["digest", "segment", "number", "anchor", "at", "places"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(_bytes(batch.column(2)), batch.column(3).to_pylist()):
            kept, end, removed, count = [], 0, 0, 0
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                b += WIDTH - 1
                if a > end or count == 0:
                    kept.append(text[end:a])
                    count += 1
                    end = a
                removed += max(0, b - max(a, end))
                end = max(end, b)
            kept.append(text[end:])
            out["n_removed"].append(removed)
            out["n_spans"].append(count)
            out["kept"].append(b"".join(kept))
        yield pa.RecordBatch.from_pydict(
            {
                "h1": batch.column(0),
                "h2": batch.column(1),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "n_spans": pa.array(out["n_spans"], pa.int64()),
                "kept": pa.array(out["kept"], pa.binary()),
            }
        )


def _hashed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})


def _wanted(rows: DataFrame, hot: int) -> DataFrame:
    """h1, firsts, hots: the runs of each text whose seed stands elsewhere too. Seeds are computed twice, which is less than keeping them."""
    seeds = _seeds(rows)
    place = F.xxhash64("h1", "first")
    # Written first, so that both sides of the join are plain shuffles, which adaptive execution can split where a seed is hot.
    several = materialize(
        seeds.groupBy("seed")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
        .where("low <> high")
        .select("seed", (F.col("n") > hot).alias("hot"))
    )
    return materialize(
        seeds.join(several, "seed")
        .select("h1", "first", "hot")
        .groupBy("h1")
        .agg(F.collect_set(F.struct("first", "hot")).alias("wanted"))
        .select("h1", F.col("wanted.first").alias("firsts"), F.col("wanted.hot").alias("hots"))
    )


def repeats(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, n_bytes, whole_sha256, copies per document; h1, h2, n_removed, n_spans, kept for texts that lose a part).

    Texts of WIDTH bytes or more with copies lose everything; they are not in the second table.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = _hashed(docs)
    whole = rows.select("doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    whole = materialize(whole)
    texts = whole.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    wanted = _wanted(rows, hot)
    # One document stands for a text with copies; of rows that repeat with their id, each does, which changes nothing.
    chosen = wanted.join(texts.drop("copies"), "h1").withColumnRenamed("doc_id", "chosen")
    once = keep_likely(rows, "h1", wanted.select("h1")).join(chosen.withColumnsRenamed({"h1": "c1", "h2": "c2"}), on=(
        (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("chosen"))
    ))
    path = scratch_path(spark, "texts")
    once.select("h1", "h2", "text", "firsts", "hots").write.parquet(path)
    candidates = spark.read.parquet(path)
    segments = _segments(candidates)
    merged = _merged(segments)
    lead = F.expr(f"substring(segment, anchor + 1, {SEED})")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = (
        merged.where(~F.col("hot"))
        .withColumn("lead", lead)
        .repartitionByRange(parts, "lead")
        .sortWithinPartitions("lead")
        .select("segment", "number", "anchor", "places")
    )
    found = buckets.mapInArrow(_sort_bucket, _FOUND)
    if not wanted.where(F.exists("hots", lambda x: x)).isEmpty():
        found = found.unionByName(_count_windows(merged.where("hot")))

    def digest(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"g1": F.xxhash64("segment", "number", "anchor"), "g2": F.xxhash64(F.lit("second"), "segment", "anchor")}
        ).drop("segment", "number", "anchor")

    spans = materialize(digest(found))
    occurrences = digest(segments.select("h1", "h2", "first", "number", "anchor", "segment"))
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    of_text = (
        occurrences.join(spans, ["g1", "g2"])
        .select("h1", "h2", shifted.alias("spans"))
        .groupBy("h1", "h2")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    cut = (
        candidates.select("h1", "h2", "text")
        .join(of_text, ["h1", "h2"])
        .select("h1", "h2", "text", "spans")
        .mapInArrow(_cut, "h1 long, h2 long, n_removed long, n_spans long, kept binary")
    )
    return whole.join(texts.drop("doc_id"), ["h1", "h2"]), cut


def removed(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document.

    NULL text counts as empty. Repeated rows, also with the same or a NULL id, are documents of their own, so each removes the others'
    strings of WIDTH bytes. Texts shorter than WIDTH stay as they are. Other columns are not read.
    """
    whole, cut = repeats(docs, hot)
    parts = cut.select("h1", "h2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["h1", "h2"])
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= WIDTH)
    return whole.join(parts, ["h1", "h2"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
