"""Token counts from two tiers of pre-token lengths, without a shuffle of pre-tokens.

The model never joins a piece across the place before a run of spaces, so a text's count is the sum over its pre-tokens (a run of spaces
and the word after it). Tier one is a broadcast table of frequent pre-tokens, found from per-task summaries of all texts
of at most SUMMARY words each; tier two is a bounded cache in every Python worker, filled by encoding. The table only saves
time: every count is what the library gives for the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import text_batches

SPACE = "▁"
# Summaries: words kept while a task counts, words that it hands over, words in the broadcast table, and their longest length
# (so that the table is under 65,536 * (48 characters and a number), a few megabytes).
WORKING = 200_000
SUMMARY = 8_192
TABLE = 65_536
LONGEST = 48
# The workers' caches start anew at this size.
CACHE = 200_000

_WORKER: dict = {}


def pre_tokens(text: str) -> list[str]:
    """Each is what follows the one space (or the text's start) before it: a word, after further spaces if there are any."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    found, empty = [], 0
    for part in parts:
        if part:
            found.append(" " * empty + part)
            empty = 0
        else:
            empty += 1
    if empty:  # spaces at the end: one symbol each
        found.append(" " * (empty - 1))
    return found


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    """Counts may be summed over pre-tokens only if no piece has a space after another character."""
    for i in range(model.vocab_size()):
        if SPACE in model.id_to_piece(i).lstrip(SPACE):
            raise ValueError(f"piece {i} reaches over a word's start; this model needs whole texts")


def _encoder(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    key = hash(proto)
    if _WORKER.get("key") != key:
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        _WORKER.update(key=key, model=model, cache={}, space=len(model.encode("a ")) - len(model.encode("a")))
    return _WORKER["model"]


def lengths_of(words: list[str], proto: bytes) -> list[int]:
    model = _encoder(proto)
    found = [len(ids) for ids in model.encode(words, num_threads=1)] if words else []
    return [_WORKER["space"] if w == "" else n for w, n in zip(words, found)]


def frequent_pre_tokens(docs: DataFrame) -> list[str]:
    """At most TABLE words, from one summary of bounded size per task over all texts."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(pre_tokens(text or ""))
                if len(counts) > WORKING:
                    counts = Counter(dict(counts.most_common(WORKING // 2)))
        top = [(w, n) for w, n in counts.most_common(SUMMARY) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    told = docs.select("text").mapInArrow(summary, "word string, n long")
    ranked = told.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE)
    return [row.word for row in ranked.collect()]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit`), one row per document.

    NULL text counts as empty: 0 bytes, 0 tokens, within the limit. NULL or repeated ids stay as they are; other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with open(model_path, "rb") as file:
        proto = file.read()
    text_batches(docs.sparkSession)
    check_model(_encoder(proto))
    words = frequent_pre_tokens(docs)
    context = docs.sparkSession.sparkContext
    table = context.broadcast(dict(zip(words, lengths_of(words, proto))))
    model = context.broadcast(proto)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, proto = table.value, model.value
        _encoder(proto)
        cache: dict[str, int] = _WORKER["cache"]
        for batch in batches:
            totals = []
            for text in batch.column(1).to_pylist():
                words = pre_tokens(text)
                found = list(map(frequent.get, words))
                total = 0
                if None in found:
                    rare = [w for w, n in zip(words, found) if n is None]
                    if len(cache) > CACHE:
                        cache.clear()
                    new = list({w for w in rare if w not in cache})
                    fresh = dict(zip(new, lengths_of(new, proto)))
                    total = sum(fresh[w] if w in fresh else cache[w] for w in rare)
                    cache.update((w, n) for w, n in fresh.items() if len(w) <= LONGEST)
                    found = [n for n in found if n is not None]
                totals.append(total + sum(found))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(totals, pa.int64())}
            )

    counted = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
