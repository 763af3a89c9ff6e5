"""Token counts against whole texts given to the library."""

import random

import public_tokenizers
import sentencepiece

from driftlens.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(2)
    bits = [" ", "  ", "   ", "a", "the", "Word", "é", "▁", "<s>", "</s>", "<unk>", "\n", "\t", "😀", "漢", "0x0A", ".", "　", "supercalifragilistic", "\x00"]
    found = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return [None, "", " ", "  ", "a ", " a", "▁", "x" * 20_000, "ab " * 30_000, *found]


def test_counts(spark, docs_of):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = {r.doc_id: r for r in T.token_counts(docs_of(texts()), PATH).collect()}
    for i, text in enumerate(texts()):
        n = len(model.encode(text or ""))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 4096), repr(text)[:80]


def test_null_ids_repeats_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, n_tokens int")
    rows = T.token_counts(docs, PATH).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None"] and {r.n_tokens for r in rows} == {2}
    assert T.token_counts(docs.limit(0), PATH).count() == 0
