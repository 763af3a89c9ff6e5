"""Mixing sources to target weights through soft membership in domains.

A classifier, fitted to a bounded sample of a labelled table, gives every document a posterior over domains. Document d with n_d
tokens and posterior p_d adds r_d n_d p_d to the domains' expected tokens at rate r_d. The rates minimise the weighted squares

    (T(r) - B)' M (T(r) - B),  T(r) = sum of r_d n_d p_d,  r >= 0,

from r = 1 on by projected gradient steps, r <- max(0, r - p_d' M (T(r) - B) / total). M is the inverse of sum n_d p_d p_d' / total, with which
a step of one is never too long, as leaving out documents at rate 0 only lowers the curvature. A step sums as many numbers
over the documents as there are domains; rates follow from the steps so far, so nothing per document is kept between steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import as_bytes, blocks, map_batches
from driftlens.session import materialize

# Labelled rows that the classifier is fitted to, give or take six deviations: a share of them by the id's hash, or all if they are fewer.
SAMPLE = 20_000
STEPS = 200
CLOSE = 1e-6
BINS = 64

_FEATURES = BINS + 6


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shares of byte classes and of some shapes per text, number of words). Empty texts have zeros."""
    out, words = np.zeros((len(texts), _FEATURES)), np.zeros(len(texts), np.int64)
    for start, part in blocks(texts, 1 << 20):
        sizes = np.array([len(t) for t in part])
        flat = np.frombuffer(b"".join(part), np.uint8)
        of = np.repeat(np.arange(len(part)), sizes)
        upper = (flat >= 65) & (flat <= 90)
        bins = np.where(upper, flat + 32, flat) % BINS
        rows = np.bincount(of * BINS + bins, minlength=len(part) * BINS).reshape(-1, BINS)
        space = (flat == 32) | ((flat >= 9) & (flat <= 13))
        begin = ~space
        begin[1:] &= space[:-1]
        begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = ~space[(np.cumsum(sizes) - sizes)[sizes > 0]]
        letter = upper | ((flat >= 97) & (flat <= 122)) | (flat >= 128)
        sums = [np.bincount(of, x, len(part)) for x in (upper, letter, space, flat == 10, begin, (flat >= 48) & (flat <= 57))]
        at = slice(start, start + len(part))
        whole = np.maximum(sizes, 1)
        out[at, :BINS] = rows / whole[:, None]
        for k, x in enumerate(sums):
            out[at, BINS + k] = x / whole
        words[at] = sums[4]
    return out, words


def described(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_tokens (words between white space), features."""

    def step(batch: pa.RecordBatch) -> dict:
        found, words = features_of(as_bytes(batch.column(2)))
        lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * _FEATURES, found.ravel())
        return {"doc_id": batch.column(0), "text_hash": batch.column(1), "n_tokens": words, "features": lists}

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, step, f"doc_id {kind}, text_hash long, n_tokens long, features array<double>")


def posteriors(rows: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """(rows with `posterior` in place of `features`, the domains in its order). `labelled` has doc_id and domain."""
    marks = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = min(1.0, SAMPLE / max(1, marks.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = rows.where(draw).join(marks, "doc_id")
    sample = materialize(sample.select("domain", array_to_vector("features").alias("features")))
    domains = sorted(r.domain for r in sample.select("domain").distinct().collect())
    if len(domains) < 2:
        return rows.withColumn("posterior", F.array(*[F.lit(1.0)] * max(1, len(domains)))).drop("features"), domains or [""]
    number = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, float(i))])
    fitted = LogisticRegression(labelCol="number", regParam=1e-4, maxIter=60, family="multinomial").fit(
        sample.select("features", number[F.col("domain")].alias("number"))
    )
    told = fitted.transform(rows.withColumn("features", array_to_vector("features")))
    return told.withColumn("posterior", vector_to_array("probability")).select("doc_id", "text_hash", "n_tokens", "posterior"), domains


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return tokens, flat.reshape(len(tokens), -1)


def rates_of(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    rate = np.ones(len(p))
    for move in moves:
        rate = np.maximum(0.0, rate - p @ move)
    return rate


def _summed(rows: DataFrame, moves: list[np.ndarray], width: int, gram: bool = False) -> np.ndarray:
    """Sums of rate * tokens * posterior over all documents; with `gram`, of the products of posteriors at rate 1."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width if gram else width)
        for batch in batches:
            if batch.num_rows:
                tokens, p = _matrix(batch)
                total += ((p * tokens[:, None]).T @ p).ravel() if gram else (rates_of(p, moves) * tokens) @ p
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "x": total})

    told = rows.select("n_tokens", "posterior").mapInArrow(part, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(width * width if gram else width)
    out[told["at"].to_numpy()] = told["x"].to_numpy()
    return out.reshape(width, width) if gram else out


def fit_rates(rows: DataFrame, domains: list[str], weights: dict[str, float], tokens: float | None = None) -> list[np.ndarray]:
    """The steps whose rates bring the expected domain tokens to the weights' parts of `tokens` (default: as many as there are)."""
    width = len(domains)
    now = _summed(rows, [], width)
    total = now.sum()
    wish = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if not total or not wish.sum():
        return []
    goal = wish / wish.sum() * (total if tokens is None else tokens)
    curve = _summed(rows, [], width, gram=True) / total
    inverse = np.linalg.inv(curve + 1e-9 * np.trace(curve) * np.eye(width))
    moves: list[np.ndarray] = []
    for _ in range(STEPS):
        off = (now - goal) / total
        if np.abs(off).max() < CLOSE:
            break
        moves.append(inverse @ off)
        now = _summed(rows, moves, width)
    return moves


def rated(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], tokens: float | None = None) -> DataFrame:
    """doc_id, text_hash, n_tokens, domain (the likeliest), rate: one row per document.

    Words between white space are the tokens; NULL and empty texts have none, so any rate suits them, and theirs follows from their posterior like others'.
    A document with several labels counts under the first by name. Domains that the labels don't have are left out of the weights; with one
    domain or none all rates scale alike. Weights without any known domain leave all rates at 1. Repeated rows have equal rates;
    a NULL id is rated, and never used for fitting. Other columns are not read.
    """
    rows, domains = posteriors(materialize(described(docs)), labelled)
    rows = materialize(rows)
    moves = fit_rates(rows, domains, weights, tokens)

    def step(batch: pa.RecordBatch) -> dict:
        _, p = _matrix(batch.select([2, 3]))
        names = np.array(domains, object)[p.argmax(axis=1)]
        return {
            "doc_id": batch.column(0),
            "text_hash": batch.column(1),
            "n_tokens": batch.column(2),
            "domain": pa.array(names, pa.string()),
            "rate": rates_of(p, moves),
        }

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(
        rows.select("doc_id", "text_hash", "n_tokens", "posterior"),
        step,
        f"doc_id {kind}, text_hash long, n_tokens long, domain string, rate double",
    )


def language_and_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the registered query: doc_id, domain = language and judged quality."""
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    of = docs.where("lang is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    return of.join(marks, "doc_id").select("doc_id", F.concat("lang", F.when(F.col("quality") == 1, "/good").otherwise("/poor")).alias("domain"))


# Production weights: half English, the rest shared out, a twentieth of each language from the poor part.
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
WEIGHTS = {f"{lang}/{kind}": w * part for lang, w in LANGUAGES.items() for kind, part in (("good", 0.95), ("poor", 0.05))}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], tokens: float | None = None) -> DataFrame:
    """The documents with `rate` and `copies` (the rate, its fraction rounded up with that probability by the document's hash); rate 0 goes.

    All columns are kept; of clashing names, the document's own go first and rate and copies take the place of such columns.
    """
    told = rated(docs, labelled, weights, tokens).where("rate > 0")
    told = told.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("rate").alias("_rate"))
    joined = docs.join(told, docs.doc_id.eqNullSafe(told._id) & (F.xxhash64("text") == told._hash))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("rate", "copies")]
    whole = F.floor("_rate")
    return joined.select(*kept, F.col("_rate").alias("rate"), (whole + (draw < F.col("_rate") - whole).cast("long")).alias("copies"))
