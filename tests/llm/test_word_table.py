"""Encoding and decoding by word table against the library, on hard texts and on the given documents."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlens.llm import word_table
from driftlens.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", " \t\n", "one", "One ONE one", "it's we'll 'sometimes 'D 're'", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|",
    "é é É ﬁ Å Å", "Σς ΑΣ İstanbul ẞ ß ÿ Ÿ", "１２ ½ ² Ⅷ 12345", "日本語のテキスト 漢字", "مرحبا بالعالم", "🙂🙂!! 👩‍👩‍👧", "a\x1cb\x1fc\x85d\xa0e f​g﻿h",
    "\x00nul\x07\x7f", "«¿qué?» – “así” … 5€", "x×y÷z ªº", "́alone", "á<|endoftext|>́", "...,,,;;;---", "क्षत्रिय हिन्दी", "ǅ ǆ Ǆ", "don’t l'été L'Été",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def check(library, df, texts):
    rows = {r.doc_id: tuple(r)[1:] for r in word_table.digests(df, PATH).collect()}
    assert rows == {i: expected(library, t) for i, t in texts.items()}


def test_words_and_ids_are_the_librarys(library):
    words = word_table.Words(open(PATH, encoding="utf-8").read())
    rng = random.Random(3)
    pool = [t for t in HARD if t] + [chr(c) for c in range(1, 0x250)] + list(" '\n'sStTdD19éÉ")
    for text in [*HARD, *("".join(rng.choice(pool) for _ in range(30)) for _ in range(300))]:
        ids = [i for w in words.words(text or "") for i in words.ids(w)]
        assert ids == library.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("frequent", [word_table.FREQUENT, 3, 0])
def test_hard_texts(library, docs_of, monkeypatch, frequent):
    monkeypatch.setattr(word_table, "FREQUENT", frequent)
    check(library, docs_of(HARD), dict(enumerate(HARD)))


def test_given_documents(library, spark, monkeypatch):
    monkeypatch.setattr(word_table, "FREQUENT", 500)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(library, docs, {r.doc_id: r.text for r in docs.collect()})


def test_long_texts_and_words(library, docs_of, monkeypatch):
    monkeypatch.setattr(word_table, "FREQUENT", 2)
    monkeypatch.setattr(word_table, "WORKING", 10)
    monkeypatch.setattr(word_table, "IDS_AT_ONCE", 1000)
    texts = ["word " * 100_000 + "Ω" * 1_000, "x" * 100_000, "".join(f"w{i} " for i in range(20_000))]
    check(library, docs_of(texts), dict(enumerate(texts)))


def test_repeats_null_ids_and_clashing_columns(library, spark):
    rows = [(None, "rare words here", 1), (None, "others there", 2), (7, "same text", 3), (7, "same text", 3), (7, "not the same", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumns({"word": F.lit("x"), "numbers": F.lit("x")})
    found = sorted((str(r.doc_id), r.ids) for r in word_table.encode(docs, PATH).collect())
    assert found == sorted((str(i), library.encode(t, add_special_tokens=False).ids) for i, t, _ in rows)
    assert word_table.digests(docs.limit(0), PATH).count() == 0


def test_decode_leaves_unknown_ids_out(library, spark):
    df = spark.createDataFrame([(1, [320, 49406, -5, 10**6, 49407]), (2, []), (3, None)], "doc_id long, ids array<int>")
    rows = {r.doc_id: r.text for r in word_table.decode(df, PATH).collect()}
    assert rows == {1: library.decode([320, 49406, 49407], skip_special_tokens=False), 2: "", 3: ""}
