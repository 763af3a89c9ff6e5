"""Byte-pair encoding by a table of distinct words, and decoding by a table of pieces.

Texts are split into words as the tokenizer splits them, and each distinct word is encoded once. The FREQUENT most frequent words (found from
per-task summaries of all texts) are the first part of the word table; its size is fixed, so it is broadcast, and texts are written as numbers of
its words. Any other word of a text has a slot there; all slots of a word meet in one task, which encodes the word once, and the ids go back to
the slots' positions. Only numbers and rare words are shuffled, no text. What is in the first part changes the time alone, not the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from driftlens.llm.common import row_key, text_batches
from driftlens.session import dealt

# Words with a number in all texts, and their longest length: under 2^19 * (48 characters and some ids), about 20 MB in practice.
FREQUENT = 1 << 19
LONGEST = 48
# Summaries: words kept while a task counts (and characters of texts after which it drops long ones), and words that it hands over.
WORKING = 1 << 19
WORKING_CHARS = 1 << 24
SUMMARY = 1 << 17
# Slots of a word longer than LONGEST, which no number keeps from being everywhere, meet in this many tasks.
SALTS = 64
# Texts leave a task in batches of about this many ids.
IDS_AT_ONCE = 1 << 19

# The pattern that the plain splitter below stands for.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Characters that composition leaves alone and whose class and lower case all Unicode versions agree on, and WORDS among their lower case.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ¡¿«»–—‘’“”…€]*")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\x0b\x0c\r\x20a-z0-9ß-öø-ÿ]+")

_WORKER: dict = {}


class Numbers(dict):
    """Word -> number of the known words; another word gets the next slot of its text, as -1 - slot."""

    def of(self, words: list[str]) -> tuple[list[int], list[str]]:
        """(a number for every word, the words that have slots)."""
        self.slots: dict[str, int] = {}
        numbers = list(map(self.__getitem__, words))
        return numbers, list(self.slots)

    def __missing__(self, word: str) -> int:
        return self.slots.setdefault(word, -1 - len(self.slots))


class Words:
    """A tokenizer file's splitting and encoding, word by word."""

    def __init__(self, spec: str):
        described = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        steps = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = steps[0] if len(steps) == 2 else {}
        if split.get("behavior") != "Removed" or not split.get("invert") or steps[1].get("type") != "ByteLevel" or steps[1].get("use_regex"):
            raise ValueError("words must come from one pattern whose matches are kept, and go to bytes then")
        if described["decoder"] or described["post_processor"]:
            raise ValueError("a decoder or a post-processor is not supported")
        added = described["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be found as they stand")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_strings = re.compile("|".join(map(re.escape, longest_first))) if added else None
        normal = [step["type"] for step in (described["normalizer"] or {}).get("normalizers", [])]
        self.plain = normal == ["NFC", "Replace", "Lowercase"] and split["pattern"] == {"Regex": WORDS} and not steps[1]["add_prefix_space"]
        # Bytes that are printable in Latin-1 stand for themselves, the others for the characters from 256 on.
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
        hidden = [c for c in range(256) if c not in shown]
        self.letter_of = {c: chr(c) for c in shown} | {c: chr(256 + k) for k, c in enumerate(hidden)}
        self.byte_of = {letter: c for c, letter in self.letter_of.items()}

    def _words(self, text: str) -> list[str]:
        if self.plain and _PLAIN.fullmatch(text):
            return _PLAIN_WORDS.findall(text.lower())
        if not text:
            return []
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [bytes(map(self.byte_of.__getitem__, word)).decode() for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def words(self, text: str) -> list[str]:
        """The words of a text in order; an added token's string is one word, with a space before it (no other word has a space)."""
        if not self.special or not any(s in text for s in self.special):
            return self._words(text)
        found, at = [], 0
        for match in self.special_strings.finditer(text):
            found += self._words(text[at : match.start()])
            found.append(" " + match[0])
            at = match.end()
        return found + self._words(text[at:])

    def ids(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.special[word[1:]]]
        return [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letter_of))]


def _words_of(spec: str) -> Words:
    if _WORKER.get("spec") != spec:
        _WORKER.update(spec=spec, words=Words(spec))
    return _WORKER["words"]


def frequent_words(docs: DataFrame, spec: str) -> DataFrame:
    """word, n, ids: the FREQUENT most frequent words, in no order."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _words_of(shared.value).words
        counts, chars = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split(text))
                chars += len(text)
                if chars > WORKING_CHARS:
                    counts, chars = Counter({w: n for w, n in counts.items() if len(w) <= LONGEST}), 0
                if len(counts) > WORKING:
                    counts = Counter(dict(counts.most_common(WORKING // 2)))
        top = Counter({w: n for w, n in counts.items() if len(w) <= LONGEST}).most_common(SUMMARY)
        words, n = pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())
        yield pa.RecordBatch.from_arrays([words, n], ["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _words_of(shared.value).ids
        for batch in batches:
            ids = pa.array([ids_of(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], ["word", "n", "ids"])

    counted = docs.select("text").mapInArrow(summary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = counted.orderBy(F.desc("n"), "word").limit(FREQUENT)
    return ranked.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(encode, "word string, n long, ids array<int>")


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, so that equal high bytes lie together."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: one row per document, in no order, as the tokenizer at `path` encodes its whole text without special tokens around it.

    NULL and empty texts, and those of white space only, have no ids. Strings of added tokens in a text are these tokens. Ids may be NULL or
    repeat; rows stay as many as they are. Other columns are not read. An empty table gives an empty table.
    """
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select("doc_id", row_key().alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Frequent words get low numbers, whose high bytes are equal and pack well.
    common = frequent_words(docs, spec).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    shared = spark.sparkContext.broadcast(spec)
    known = spark.sparkContext.broadcast(common.column("word").to_pylist())
    lists = common.column("ids").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids_of_known = spark.sparkContext.broadcast((lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), ends))

    def splitter() -> tuple:
        if _WORKER.get("known") is not known.value:
            _WORKER.update(known=known.value, numbers=Numbers({w: i for i, w in enumerate(known.value)}))
        return _words_of(shared.value).words, _WORKER["numbers"].of

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = splitter()
        for batch in batches:
            words = [number(split(text))[1] for text in batch.column(2).to_pylist()]
            rows = np.repeat(np.arange(len(words)), [len(own) for own in words])
            at = np.concatenate([np.arange(len(own), dtype=np.int32) for own in words] or [np.zeros(0, np.int32)])
            keys = [batch.column(k).take(pa.array(rows)) for k in (0, 1)]
            columns = [*keys, pa.array(at), pa.array([w for own in words for w in own], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_key", "slot", "word"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = splitter()
        for batch in batches:
            numbers = [_pack(np.array(number(split(text))[0], np.int32)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(numbers, pa.binary())], ["doc_id", "_key", "numbers"])

    def encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one word lie together: it is encoded once. Slot and ids are bytes of 32-bit numbers. Equal rows of one word make one."""
        ids_of, last, ids, row = _words_of(shared.value).ids, None, b"", None
        for batch in batches:
            found, kept = [], []
            doc_ids, keys, slots, words = (c.to_pylist() for c in batch.columns)
            for k, word in enumerate(words):
                if word != last:
                    last, ids, row = word, np.array(ids_of(word), "<i4").tobytes(), None
                if row != (row := (doc_ids[k], keys[k])):
                    kept.append(k)
                    found.append(slots[k].to_bytes(4, "little") + ids)
            columns = [batch.column(k).take(pa.array(kept, pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], ["doc_id", "_key", "found"])

    def place_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, ends = ids_of_known.value
        for batch in batches:
            out, sizes, held, first = [], [], 0, 0
            brought = batch.column(2).to_pylist()
            for row, packed in enumerate(batch.column(1).to_pylist()):
                numbers = _unpack(packed)
                if brought[row]:
                    used, numbers = np.unique(numbers, return_inverse=True)
                    ids = _gather(numbers, *_table_of(used, flat, ends, brought[row]))
                else:
                    ids = _gather(numbers, flat, ends)
                out.append(ids)
                sizes.append(len(ids))
                held += len(ids)
                if held >= IDS_AT_ONCE or row + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(out))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sizes)), lists], ["doc_id", "ids"])
                    out, sizes, held, first = [], [], 0, row + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    rare = docs.mapInArrow(slots, f"doc_id {kind}, _key long, slot int, word string")
    salt = F.when(F.length("word") > LONGEST, F.spark_partition_id() % SALTS).otherwise(0)
    together = dealt(rare.withColumn("_salt", salt), "word", "_salt").drop("_salt").sortWithinPartitions("word", "doc_id", "_key")
    brought = together.mapInArrow(encode_runs, f"doc_id {kind}, _key long, found binary")
    # Dealt out before the grouping: half-made sets would be longer than the rows.
    brought = dealt(brought, "doc_id", "_key").groupBy("doc_id", "_key").agg(F.collect_set("found").alias("found"))
    brought = brought.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_row"), "found")
    numbered = docs.mapInArrow(number, f"doc_id {kind}, _key long, numbers binary")
    met = numbered.join(brought, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left")
    return met.select("doc_id", "numbers", "found").mapInArrow(place_ids, f"doc_id {kind}, ids array<int>")


def _table_of(used: np.ndarray, flat: np.ndarray, ends: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a text's own words, which are its slots (negative, ascending) and known numbers, and where each word ends."""
    brought = {int.from_bytes(f[:4], "little"): f for f in found}
    slots = [np.frombuffer(brought[-1 - n], "<i4", offset=4) for n in used[used < 0].tolist()]
    known = used[used >= 0].astype(np.int64)
    ids = _gather(known, flat, ends)
    sizes = np.concatenate([[0], [len(s) for s in slots], ends[known + 1] - ends[known]])
    return np.concatenate([*slots, ids]), np.cumsum(sizes).astype(np.int64)


def _gather(numbers: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ids of the words in order; word k has flat[ends[k] : ends[k + 1]]."""
    starts = ends[numbers]
    sizes = ends[numbers.astype(np.int64) + 1] - starts
    total = int(sizes.sum())
    within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return flat[np.repeat(starts, sizes) + within].astype(np.int32)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with `text`: the pieces of `ids`, added tokens too, with a space between them, as a tokenizer without a decoder gives them.

    The pieces are a table of one row per id, whose size the file fixes; every task joins its ids with it. Ids without a piece are left out;
    no ids, or NULL, give an empty text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_pieces(path))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(_texts(batch.column(batch.schema.get_field_index("ids")), shared.value), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "text"])

    kept = encoded.select(*[f"`{c}`" for c in encoded.columns if c != "text"])
    return kept.mapInArrow(join, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))


def _pieces(path: str) -> list[str | None]:
    with open(path, encoding="utf-8") as file:
        tokenizer = Words(file.read()).tokenizer
    pieces = {i: p for p, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [pieces.get(i) for i in range(max(pieces) + 1)]


def _texts(lists: pa.ListArray, pieces: list[str | None]) -> Iterator[str]:
    names = np.array([*pieces, None], object)
    whole, last = None not in pieces, len(pieces)
    for k in range(len(lists)):
        ids = lists[k].values
        ids = ids.to_numpy(zero_copy_only=False) if ids is not None else np.zeros(0, np.int32)
        known = not len(ids) or (ids.min() >= 0 and ids.max() < last)
        found = names[ids if known else np.where((ids < 0) | (ids >= last), last, ids)].tolist()
        yield " ".join(found if known and whole else [p for p in found if p is not None])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), decoded_sha256 (of the decoded text in UTF-8).

    The rows are those of `encode`, their texts those of `decode`; only the digests leave the tasks.
    """
    encoded = encode(docs, path)
    shared = encoded.sparkSession.sparkContext.broadcast(_pieces(path))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            lists = batch.column(1)
            ids = [sha(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest() for x in lists]
            texts = [sha(t.encode()).hexdigest() for t in _texts(lists, shared.value)]
            n = pa.array(lists.value_lengths(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
