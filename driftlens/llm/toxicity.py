"""Toxicity from class-conditional Kneser-Ney models of expressions (words as byte sequences).

Training texts are turned into document counts of words per class and fold, words into counts of byte n-grams (ORDER bytes, the last one
given those before it). Each class has the probability

    P_c(b | h) = (n_c(hb) - d(n_c(hb)) + D_c(h) * S(b | h')) / n_c(h)

with the discount d(n) = n up to two documents and TOP from three on, D_c(h) the sum of the discounts under h, and S the continuation
probability of the shorter context h', from counts that both classes share. A rare n-gram is so left to the shared counts and speaks
for neither class; how many documents that takes does not depend on the corpus. An expression's evidence is the difference of its two
log-likelihoods. A document has two terms: the difference over its whole text, every occurrence counted, divided by its length in bytes,
and the sum over its STRONGEST expressions, which a long ordinary text cannot dilute. A logistic curve makes them a score.

A document is never scored by counts that it is part of: rows of one training fold are scored by the counts of the other one, held-out rows
by both. So the curve is fitted to evidence as new documents have it.

The difference splits into a part per context and one per n-gram; both are exactly zero but where some n-gram has three documents. What is left is
a table that grows with the corpus. Its HEAD most frequent entries are read by all workers; the others are joined to the keys that need them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import drop_rows, fold, is_held_out, is_training, keep_likely, row_key, text_batches
from driftlens.session import materialize, scratch_path

ORDER = 8
TOP = 2.75
# Entries of the model that every worker reads from the shared folder and holds, the most frequent ones: 64 MB at most. The rest is joined.
HEAD = 1 << 21
# Bits of the filter that tells which keys may have a joined entry; with a very large model more keys pass it, in vain.
TAIL_BITS = 24
# Different expressions of a document's second term.
STRONGEST = 3
# Words that a task holds before it hands over its counts; words in a worker's cache; words looked up at once.
HELD = 100_000
CACHE = 1 << 17
AT_ONCE = 10_000
# Steps of both terms, and how far they go, where the curve is fitted.
MEAN_STEP, MEAN_END = 0.01, 1.0
TOP_STEP, TOP_END = 0.25, 100.0
REJECT = 0.7

# The folds whose counts a model has: the one for held-out rows, for rows of fold 0 and of fold 2.
MODELS = ((0, 2), (2,), (0,))
_COUNTS = ("toxic_0", "toxic_2", "other_0", "other_2")
_TAIL = "array<struct<model:int,times:int,known:double,keys:array<bigint>>>"
_REST = pa.list_(pa.struct([("model", pa.int32()), ("times", pa.int32()), ("known", pa.float64()), ("keys", pa.list_(pa.int64()))]))

_WORD = re.compile(r"[^\W\d_]+")
_WORKER: dict = {}


def stored(path: str) -> str:
    """A path of the shared folder as workers open it: a plain one is a file's."""
    return path if "://" in path or path.startswith("/") else path.removeprefix("file:")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of every byte and of the end, packed into a long; number of them per word)."""
    coded = [w.encode() for w in words]
    pad = b"\0" * (ORDER - 1)
    flat = np.frombuffer(pad + b"".join(w + b" " + pad for w in coded), np.uint8)
    n = len(flat) - ORDER + 1
    grams = np.zeros(n, np.uint64)
    for k in range(ORDER):
        grams = (grams << np.uint64(8)) | flat[k : k + n]
    sizes = np.array([len(w) + 1 for w in coded])
    ends = flat[ORDER - 1 :] != 0  # the last byte of a gram is never padding
    return grams.view(np.int64)[ends], sizes


def _word_counts(labelled: DataFrame) -> DataFrame:
    """word, documents that hold it per class and fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            values = np.array(list(held.values()), np.int64).reshape(-1, len(_COUNTS))
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string())} | {c: values[:, k] for k, c in enumerate(_COUNTS)})

        for batch in batches:
            for text, toxic, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                at = 2 * (1 - toxic) + (part == 2)
                for w in set(words_of(text)):
                    held.setdefault(w, [0, 0, 0, 0])[at] += 1
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = labelled.select("text", "toxic", fold(F.col("doc_id")).cast("int").alias("part"))
    told = rows.mapInArrow(count, "word string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return told.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _gram_counts(words: DataFrame) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, sizes = word_grams(batch.column(0).to_pylist())
            of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(grams, kind="stable")
            grams, of = grams[order], of[order]
            starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            columns = {c: np.add.reduceat(batch.column(k + 1).to_numpy(zero_copy_only=False)[of], starts) for k, c in enumerate(_COUNTS)}
            yield pa.RecordBatch.from_pydict({"gram": grams[starts]} | columns)

    told = words.mapInArrow(step, "gram long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return told.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _marks(labels: DataFrame) -> DataFrame:
    marks = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return marks.agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def _count(kind: str, folds: tuple[int, ...]) -> Column:
    return sum((F.col(f"{kind}_{f}") for f in folds[1:]), F.col(f"{kind}_{folds[0]}"))


def _discount(n: Column) -> Column:
    return F.when(n > 2, F.lit(TOP)).otherwise(n.cast("double"))


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, n, value_0 .. value_2: what a context or n-gram adds to the toxic log-likelihood over the ordinary one, per model.

    An n-gram's key is its bytes; that of a context has a zero for the last byte. Entries that add nothing to any model are left out.
    """
    marks = _marks(labels)
    texts = docs.where(is_training(F.col("doc_id")) & F.col("text").isNotNull())
    texts = texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = keep_likely(texts, "doc_id", marks.select("doc_id"))
    grams = materialize(_gram_counts(_word_counts(texts.join(marks, "doc_id"))))
    context, suffix = F.shiftrightunsigned("gram", 8), F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1))
    sums, shares, before, before_all = [], [], [], []
    for m, folds in enumerate(MODELS):
        for kind in ("toxic", "other"):
            n = _count(kind, folds)
            sums += [F.sum(n).alias(f"n_{kind}_{m}"), F.sum(_discount(n)).alias(f"d_{kind}_{m}")]
            seen = F.col(f"n_{kind}_{m}")
            shares.append(F.when(seen > 0, F.col(f"d_{kind}_{m}") / seen).otherwise(1.0).alias(f"l_{kind}_{m}"))
        before.append(F.count_if(_count("toxic", folds) + _count("other", folds) > 0).alias(f"before_{m}"))
        before_all.append(F.sum(f"before_{m}").alias(f"before_all_{m}"))
    sizes = [f"n_{kind}_{m}" for m in range(len(MODELS)) for kind in ("toxic", "other")]
    of_context = grams.groupBy(context.alias("context")).agg(*sums).select("context", *sizes, *shares)
    of_context = materialize(of_context.where(F.least(*[F.col(f"l_{kind}_{m}") for m in range(len(MODELS)) for kind in ("toxic", "other")]) < 1))
    of_suffix = grams.groupBy(suffix.alias("suffix")).agg(*before)
    of_short = of_suffix.groupBy(F.shiftrightunsigned("suffix", 8).alias("short")).agg(*before_all)
    kept = grams.where((_count("toxic", MODELS[0]) > 2) | (_count("other", MODELS[0]) > 2))
    kept = (
        kept.withColumns({"context": context, "suffix": suffix, "short": F.shiftrightunsigned(suffix, 8)})
        .join(of_context, "context")
        .join(of_suffix, "suffix")
        .join(of_short, "short")
    )
    total = F.col("n_toxic_0") + F.col("n_other_0")
    back = [F.log(F.col(f"l_toxic_{m}") / F.col(f"l_other_{m}")) for m in range(len(MODELS))]

    def extra(m: int, folds: tuple[int, ...]) -> Column:
        own = {}
        for kind in ("toxic", "other"):
            n, seen = _count(kind, folds), F.col(f"n_{kind}_{m}")
            own[kind] = F.when(seen > 0, (n - _discount(n)) / seen).otherwise(0.0)
        shared = F.col(f"before_{m}") / F.nullif(F.col(f"before_all_{m}"), F.lit(0))
        parts = [own[kind] + F.col(f"l_{kind}_{m}") * shared for kind in ("toxic", "other")]
        return F.when(own["toxic"] + own["other"] > 0, F.log(parts[0] / parts[1]) - back[m]).otherwise(0.0)

    values = [f"value_{m}" for m in range(len(MODELS))]
    of_grams = kept.select(
        F.col("gram").alias("key"), (_count("toxic", MODELS[0]) + _count("other", MODELS[0])).alias("n"), *[extra(m, f).alias(values[m]) for m, f in enumerate(MODELS)]
    )
    of_contexts = of_context.select(F.shiftleft("context", 8).alias("key"), total.alias("n"), *[b.alias(v) for b, v in zip(back, values)])
    return of_grams.unionAll(of_contexts).where(" OR ".join(f"{v} <> 0" for v in values))


def _bit(keys: np.ndarray) -> np.ndarray:
    """A key's place in the bit set of the joined entries."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TAIL_BITS)).astype(np.int64)


def _loaded(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and values of the stored head."""
    storage, root = fs.FileSystem.from_uri(stored(path))
    files = ds.dataset(root, filesystem=storage, format="parquet")
    names = ["key", *[f"value_{m}" for m in range(len(MODELS))]]
    n, at = files.count_rows(), 0
    keys, values = np.empty(n, np.int64), np.empty((n, len(MODELS)))
    for batch in files.to_batches(columns=names, batch_size=1 << 16, batch_readahead=1, fragment_readahead=1, use_threads=False):
        to = at + batch.num_rows
        keys[at:to] = batch.column(0).to_numpy()
        for m in range(len(MODELS)):
            values[at:to, m] = batch.column(m + 1).to_numpy()
        at = to
    pa.default_memory_pool().release_unused()
    order = np.argsort(keys)
    for m in range(len(MODELS)):  # one column at a time: no second copy of the whole
        values[:, m] = values[order, m]
    return keys[order], values


def _tiers(model: DataFrame) -> tuple[str, np.ndarray, DataFrame]:
    """(path of at most HEAD frequent entries, bit set of the others' keys, the others)."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = sorted(model.groupBy(level.alias("level")).count().collect(), reverse=True)  # at most 16 x 63 rows
    least, total = math.inf, 0
    for row in levels:
        total += row["count"]
        if total > HEAD:
            break
        least = row["level"]
    in_head = level >= F.lit(float(least))
    path = scratch_path(model.sparkSession, "head")
    model.where(in_head).drop("n").write.parquet(path)
    tail = model.where(~in_head)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_pydict({"word": bit >> 6, "one": (np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64)})

    told = tail.select("key").mapInArrow(bits, "word long, one long").groupBy("word").agg(F.bit_or("one").alias("bits")).toPandas()
    there = np.zeros((1 << TAIL_BITS) // 64, np.int64)
    there[told["word"].to_numpy(np.int64)] = told["bits"].to_numpy(np.int64)
    return path, there, tail


def evidence(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, key (of the row), held_out, mean (per byte), top (of the strongest expressions): one row per document."""
    path, there, tail = _tiers(model)
    shipped = docs.sparkSession.sparkContext.broadcast(there)

    def known(words: list[str]) -> list[tuple]:
        """Per word: length, value in each model by the head, keys that may have an entry among the others."""
        keys, values = _WORKER["head"]
        there = shipped.value
        grams, sizes = word_grams(words)
        both = np.stack([grams, grams & ~np.int64(255)], 1).ravel()
        found = np.zeros((len(both), len(MODELS)))
        open_ = np.ones(len(both), bool)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, both), len(keys) - 1)
            hit = keys[at] == both
            found[hit], open_ = values[at[hit]], ~hit
        bit = _bit(both)
        open_ &= ((there[bit >> 6] >> (bit & 63)) & 1).astype(bool)
        starts = 2 * (np.cumsum(sizes) - sizes)
        totals = np.add.reduceat(found, starts).tolist()
        ends = (starts + 2 * sizes).tolist()
        rest: list = [None] * len(words)
        for i in np.flatnonzero(np.logical_or.reduceat(open_, starts)).tolist():
            part = slice(int(starts[i]), ends[i])
            rest[i] = both[part][open_[part]].tolist()
        return list(zip(sizes.tolist(), totals, rest))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _WORKER.get("model") != path:
            _WORKER.clear()
            _WORKER.update(model=path, cache={}, head=_loaded(path))
        cache: dict[str, tuple] = _WORKER["cache"]
        for batch in batches:
            length, total, top, rest = [], [], [], []
            for text, m in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                words = Counter(words_of(text))
                new = [w for w in words if w not in cache]
                if new:
                    if len(cache) > CACHE:
                        cache.clear()
                        new = list(words)
                    for k in range(0, len(new), AT_ONCE):
                        some = new[k : k + AT_ONCE]
                        cache.update(zip(some, known(some)))
                size, value, single, later = 0, 0.0, [], []
                for w, times in words.items():
                    of, values, keys = cache[w]
                    size += times * of
                    if keys is None:
                        value += times * values[m]
                        if values[m] > 0:
                            single.append(values[m])
                    else:
                        later.append({"model": m, "times": times, "known": values[m], "keys": keys})
                length.append(size)
                total.append(value)
                top.append(sorted(single, reverse=True)[:STRONGEST])
                rest.append(later)
            kept = {c: batch.column(k) for k, c in ((0, "doc_id"), (2, "key"), (3, "held_out"), (5, "row"))}
            told = {"length": pa.array(length, pa.int64()), "total": pa.array(total, pa.float64()), "top": pa.array(top, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(kept | told | {"rest": pa.array(rest, _REST)})

    held_out = is_held_out(F.col("doc_id")).alias("held_out")
    own = F.coalesce(F.when(fold(F.col("doc_id")) == 0, 1).when(fold(F.col("doc_id")) == 2, 2), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("key"), held_out, own.alias("model"), F.monotonically_increasing_id().alias("row")
    )
    fields = f"doc_id long, key long, held_out boolean, row long, length long, total double, top array<double>, rest {_TAIL}"
    told = materialize(rows.mapInArrow(step, fields))
    words = told.where(F.size("rest") > 0).select("row", F.posexplode("rest").alias("word", "w")).select("row", "word", "w.*")
    value = F.element_at(F.array(*[F.col(f"value_{m}") for m in range(len(MODELS))]), F.col("model") + 1)
    joined = words.select("row", "word", "model", F.explode("keys").alias("key")).join(tail.drop("n"), "key")
    added = joined.groupBy("row", "word").agg(F.sum(value).alias("added"))
    whole = words.select("row", "word", "times", "known").join(added, ["row", "word"], "left")
    whole = whole.withColumn("value", F.col("known") + F.coalesce("added", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("value")))
    of_row = whole.withColumn("place", place).groupBy("row").agg(
        F.sum(F.col("times") * F.col("value")).alias("more"),
        F.collect_list(F.when((F.col("place") <= STRONGEST) & (F.col("value") > 0), F.col("value"))).alias("also"),
    )
    ranked = F.slice(F.sort_array(F.concat("top", F.coalesce("also", F.array().cast("array<double>"))), asc=False), 1, STRONGEST)
    mean = (F.col("total") + F.coalesce("more", F.lit(0.0))) / F.nullif(F.col("length"), F.lit(0))
    return told.join(of_row, "row", "left").select(
        "doc_id", "key", "held_out", F.coalesce(mean, F.lit(0.0)).alias("mean"), F.aggregate(ranked, F.lit(0.0), lambda s, x: s + x).alias("top")
    )


def logistic(terms: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Weights of the terms (rows of `terms`) and offset of the curve through counts per step, with Platt's smoothed targets; NaN where a class is missing."""
    if not len(toxic) or not toxic.sum() or not other.sum():
        return np.full(len(terms) + 1, math.nan)
    high, low = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / (other.sum() + 2)
    n, y = toxic + other, (toxic * high + other * low) / (toxic + other)
    weights = np.r_[np.zeros(len(terms)), math.log(toxic.sum() / other.sum())]
    design, ridge = np.vstack([terms, np.ones(len(n))]), np.r_[np.full(len(terms), 1e-3), 0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(weights @ design, -50, 50)))
        hessian = (design * (n * p * (1 - p))) @ design.T + np.diag(ridge + 1e-9)
        move = np.linalg.solve(hessian, design @ (n * (y - p)) - ridge * weights)
        weights = weights + move * min(1.0, 4.0 / max(1e-12, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    return weights


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key, held_out, score, predicted: see `toxicity`."""
    text_batches(docs.sparkSession)
    told = materialize(evidence(docs, materialize(fit(docs, labels))))
    mean = F.greatest(F.least(F.col("mean"), F.lit(MEAN_END)), F.lit(-MEAN_END))
    top = F.least(F.col("top"), F.lit(TOP_END))
    steps = (
        told.where(is_training(F.col("doc_id")))
        .join(_marks(labels), "doc_id")
        .groupBy(F.round(mean / MEAN_STEP).alias("mean"), F.round(top / TOP_STEP).alias("top"))
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other"))
        .toPandas()  # as many rows as there are pairs of steps, at most
    )
    # the first term brought to the size of the second, so that both are held back alike
    scale = TOP_STEP / MEAN_STEP
    terms = np.stack([steps["mean"].to_numpy(np.float64) * MEAN_STEP * scale, steps["top"].to_numpy(np.float64) * TOP_STEP])
    a, b, c = logistic(terms, steps["toxic"].to_numpy(np.float64), steps["other"].to_numpy(np.float64)).tolist()
    score = F.lit(0.0) if math.isnan(a) else 1 / (1 + F.exp(-(F.lit(a * scale) * mean + F.lit(b) * top + F.lit(c))))
    return told.select("doc_id", "key", "held_out", score.cast("double").alias("score")).withColumn(
        "predicted", (F.col("score") >= REJECT).cast("int")
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from REJECT on), one row per document.

    Learns from documents outside the held-out fold that have a label 0 or 1 (more than one label: the highest counts).
    NULL and empty texts have no expression and get the score of no evidence. A NULL id is in no fold, so never
    learnt from. Without labels of both classes every score is 0. Repeated rows are scored each; other columns are not read.
    """
    return scored(docs, labels).drop("key")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents without those that are predicted toxic, all columns kept."""
    return drop_rows(docs, materialize(scored(docs, labels).where("predicted = 1").select("doc_id", "key")))
