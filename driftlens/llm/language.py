"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts up to ORDER bytes with frozen counts. A byte costs -log2 of its count in the longest known
context over (count of the context + number of its different bytes), and each context left before costs an escape, its number of different
bytes over the same sum (method C, no exclusions); below the empty context all 256 bytes are alike. The text goes to the
language that codes it in the fewest bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import as_bytes, is_held_out, is_training, text_batches
from driftlens.session import materialize

ORDER = 3
# Entries of all trees together: a language's n-gram stays if it has at least (languages / ENTRIES) of the language's bytes.
ENTRIES = 1 << 20
# Distinct n-grams that a task holds before it hands over its counts.
HELD = 1 << 19
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def pieces(texts: list[bytes], size: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(text's number, the ORDER bytes before, a part of at most `size` bytes); zeros stand before a text's start."""
    for i, text in enumerate(texts):
        for at in range(0, len(text), size):
            yield i, (b"\0" * ORDER + text[max(0, at - ORDER) : at])[-ORDER:], text[at : at + size]


def packed_blocks(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about `size` bytes: (every byte with the ORDER bytes before it as one number, text numbers, bytes of each of them)."""

    def pack(held: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(part) for _, _, part in held])
        flat = np.frombuffer(b"".join([x for _, before, part in held for x in (before, part)]), np.uint8)
        n = len(flat) - ORDER
        grams = np.zeros(n, np.uint32)
        for k in range(ORDER + 1):
            grams = (grams << np.uint32(8)) | flat[k : k + n]
        real = np.repeat(np.tile([False, True], len(held)), np.stack([np.full(len(held), ORDER), sizes], 1).ravel())
        return grams[real[ORDER:]], np.array([i for i, _, _ in held]), sizes

    held, total = [], 0
    for piece in pieces(texts, size):
        held.append(piece)
        total += len(piece[2])
        if total >= size:
            yield pack(held)
            held, total = [], 0
    if held:
        yield pack(held)


class Trees:
    """Code lengths of all languages for every known n-gram, longest first."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        width = len(self.languages)
        number = counts["lang"].map({l: i for i, l in enumerate(self.languages)}).to_numpy(np.int64)
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        self.keys: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        lower = np.full((1, width), 8.0)
        for order in range(ORDER + 1 if width else 0):
            grams, at = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.zeros((len(grams), width))
            np.add.at(seen, (at, number), n)
            contexts, of = np.unique(grams >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            if order:
                lower = self.cost[-1][np.searchsorted(self.keys[-1], grams & ((1 << 8 * order) - 1))]
            own = -np.log2(np.maximum(seen, 1) / np.maximum((total + kinds)[of], 1))
            self.keys.append(grams)
            self.cost.append(np.where(seen > 0, own, escape[of] + lower))
            self.contexts.append(contexts)
            self.escape.append(escape)

    def bits(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Rows of code lengths, one column per language."""
        if order < 0:
            return np.full((len(grams), len(self.languages)), 8.0)
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        found = self.cost[order][at]
        missed = np.flatnonzero(keys[at] != grams)
        if len(missed):
            rest = grams[missed]
            cost = self.bits(rest & ((1 << 8 * order) - 1), order - 1)
            contexts = self.contexts[order]
            where = np.minimum(np.searchsorted(contexts, rest >> 8), len(contexts) - 1)
            cost = cost + np.where((contexts[where] == rest >> 8)[:, None], self.escape[order][where], 0.0)
            found[missed] = cost
        return found

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        for grams, of, sizes in packed_blocks(texts, 1 << 18):
            cost = self.bits(grams.astype(np.int64))
            np.add.at(out, of, np.add.reduceat(cost, np.cumsum(sizes) - sizes, axis=0))
        return out


def fit(docs: DataFrame) -> pd.DataFrame:
    """lang, gram, n: byte counts of training rows in their contexts; at most ENTRIES rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.astype(np.int64), "n": n}
                )
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            texts = as_bytes(batch.column(0))
            for lang in set(langs.tolist()):
                for grams, _, _ in packed_blocks([texts[i] for i in np.flatnonzero(langs == lang)], 1 << 22):
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
            held.update({lang: [merged(parts)] for lang, parts in held.items() if parts})
            if sum(len(parts[0][0]) for parts in held.values()) > HELD:
                yield from out()
        yield from out()

    rows = docs.where(is_training(F.col("doc_id")) & F.col("lang").isNotNull()).select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string")
    )
    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams)
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = totals.count()
    kept = grams.join(totals, "lang").where(F.col("n") >= F.lit(languages / ENTRIES) * F.col("total"))
    return kept.select("lang", "gram", "n").toPandas()


def identify(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language's posterior from the code lengths, one row per document.

    Learns from rows of `known` (default: docs) outside the held-out fold with a language; `score` is 2^-(bits - fewest bits),
    normalised. Ties go to the language that sorts first. A NULL text, one without a letter, and every text when
    nothing was learnt: `und`, score 0. A NULL id is in no fold, so never learnt from. Other columns are not read.
    """
    text_batches(docs.sparkSession)
    trees = Trees(fit(docs if known is None else known))
    shipped = docs.sparkSession.sparkContext.broadcast(trees)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            able = [i for i, t in enumerate(texts) if trees.languages and t and has_letter(t)]
            if able:
                bits = trees.code_lengths([texts[i].encode() for i in able])
                best = bits.argmin(axis=1)
                share = np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
                score[able] = 1 / share
                for i, k in zip(able, best):
                    lang[i] = trees.languages[k]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array(lang, pa.string()), "score": score}
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), is_held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(step, "doc_id long, held_out boolean, lang_pred string, score double")
