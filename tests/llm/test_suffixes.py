"""Repeated strings against a dictionary of all windows."""

import hashlib
import random

import pytest

from driftlens.llm import suffixes


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for p in range(len(t) - 199):
            w = t[p : p + 200]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in data:
        drop = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                drop[p : p + 200] = b"\1" * 200
        runs = sum(drop[i] and not (i and drop[i - 1]) for i in range(len(t)))
        kept = bytes(c for c, d in zip(t, drop) if not d)
        out.append((len(t), sum(drop), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "y" * 200, "z" * 450, "ab " * 200, "ab " * 90 + "c"]
    for _ in range(40):
        parts = [prose(rng.randint(0, 80)) for _ in range(3)]
        if rng.random() < 0.7:
            passage = rng.choice(passages)
            cut = rng.randint(0, 100)
            parts.insert(rng.randint(0, 3), passage[cut:] if rng.random() < 0.5 else passage)
        texts.append(" ".join(parts))
    texts += [texts[20], texts[21]] + [t[:150] + "!" + t[151:] for t in texts[22:30]]
    self_repeat = prose(50)
    texts.append(self_repeat + " middle " + self_repeat)
    return texts


def check(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.removed(docs, **options).collect()}
    expected = brute(texts)
    assert len(rows) == len(texts)
    for i, want in enumerate(expected):
        assert rows[i] == want, (i, texts[i])


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_windows(spark, seed):
    check(spark, corpus(seed))


def test_hot_seeds_take_the_digest_path(spark):
    check(spark, corpus(3), hot=1)


def test_small_pieces_and_parts(spark, monkeypatch):
    texts = corpus(4)
    pieces = [p for p in suffixes._pieces([t.encode() for t in texts if t])]
    assert len(pieces) == sum(1 for t in texts if t)
    monkeypatch.setattr(suffixes, "PIECE", 300)
    data = [t.encode() for t in texts if t and len(t.encode()) >= 200]
    covered = {(i, w) for i, first, number, _, _ in suffixes.runs(data) for f, n in zip(first, number) for w in range(f, f + n)}
    assert covered == {(i, w) for i, t in enumerate(data) for w in range(len(t) - 199)}


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = "many words here " * 3 + "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(150))
    rows = [(1, long), (1, long), (None, "a" + long), (None, None), (2, "unique")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.removed(docs).collect())
    n = len(long)
    assert out == sorted([(1, n, n), (1, n, n), (0, n + 1, n), (0, 0, 0), (2, 6, 0)])
    assert suffixes.removed(docs.limit(0)).count() == 0
