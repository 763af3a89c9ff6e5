"""Personal data against plain regular expressions, and the disclosure rule on a corpus made for it."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from driftlens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    text = text or ""
    spans = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern) in enumerate(PLAIN.items())
        for m in re.finditer(pattern, text)
        if holds(kind, m.group())
    ]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans)]


def random_texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "b.c", "@", "@x", ".", ".co", "_", "+1", "+", "1", "4111 1111 1111 1111", "4242-4242-4242-4242", "10.0.0.1", "256", "0255",
            " ", "  ", "-", "(", ")", "555-0100", "\n", "é", "😀", "%", "1234567890123", "+44 20 7946 0958", "a@b.c_d@e.f"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_spans_equal_plain_patterns(spark):
    texts = [None, "", *random_texts(1, 400), "9" * 30_000, "a" * 50_000 + "@b.c", "+1" + "(" * 20_000, "1 " * 10_000 + "x"]
    found = pii.spans_of(rows_of(spark, texts)).collect()
    assert len(found) == len(texts)
    for row in found:
        expected = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), texts[row.doc_id][:200]
        assert [s for s in row.spans.split(",") if s and not s.startswith("term")] == expected
        assert row.n_email == sum(s.startswith("email") for s in expected)


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [f"call Zyxwv at jo{i % 3}@mail.org about the thing number {'abcdefghij'[i % 10] * 4}" for i in range(9)]
    texts += [f"the thing is about {'klmnopqrst'[i % 10] * 5}" for i in range(60)]
    return rows_of(spark, texts), texts


def test_terms_that_reveal(spark, corpus):
    docs, texts = corpus
    rows = {r.doc_id: r for r in pii.spans_of(docs).collect()}
    for i in range(9):
        terms = [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[i].spans.split(",")) if k == "term"]
        assert "the" not in terms and "about" not in terms and "thing" not in terms
    assert all(rows[i].spans == "" for i in range(9, 69))


def test_disclosure_figures(spark):
    """Two documents share an address and a word that is nowhere else: the word tells the address for certain."""
    texts = ["write quorble x@y.zz now", "ask quorble x@y.zz then"] + ["write now then ask words"] * 30
    rows = pii.spans_of(rows_of(spark, texts)).orderBy("doc_id").collect()
    assert rows[0].spans == "term:6:13,email:14:20" and rows[1].spans == "term:4:11,email:12:18"
    clean = {r.doc_id: r.text for r in pii.sanitise(rows_of(spark, texts)).collect()}
    assert clean[0] == "write  [EMAIL] now" and clean[5] == texts[5] and len(clean) == 32


def brute_terms(texts):
    """Term spans by the definition: all pairs of entities and words of a document, counted over all documents."""
    n_entity, n_term, n_both, held = Counter(), Counter(), Counter(), []
    for text in texts:
        spans = [(m.start(), m.end(), kind) for kind, p in PLAIN.items() for m in re.finditer(p, text) if holds(kind, m.group())]
        entities = {(kind, text[a:b].lower()) for a, b, kind in spans}
        found = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text)]
        held.append((spans, entities, found))
        terms = {t for t, _, _ in found}
        n_entity.update(entities)
        n_term.update(terms)
        n_both.update((e, t) for e in entities for t in terms)
    n, out = len(texts), []

    def told(e, t):
        own = math.log(n / n_entity[e])
        return n_both[e, t] >= 2 and own > 0 and math.log(n_both[e, t] * n / (n_term[t] * n_entity[e])) / own >= pii.GENERALISE

    for spans, entities, found in held:
        free = [f for f in found if not any(f[1] < b and a < f[2] for a, b, _ in spans)]
        out.append([f"term:{a}:{b}" for t, a, b in free if any(told(e, t) for e in entities)])
    return out


def test_terms_of_whole_documents(spark):
    """A word reveals from any place of the document, and all its occurrences are marked: other lines, far away, before and after."""
    far = "Quorble wrote.\n" + "now then ask words " * 20 + "\nx@y.zz\n" + "ask then now " * 30 + "\nsigned QUORBLE"
    texts = [far, "then quorble\n\nx@y.zz"] + ["write now then ask words wrote signed"] * 30
    rows = {r.doc_id: r for r in pii.spans_of(rows_of(spark, texts)).collect()}
    at = far.index("QUORBLE")
    assert [s for s in rows[0].spans.split(",") if s.startswith("term")] == ["term:0:7", f"term:{at}:{at + 7}"] and rows[0].n_term == 2
    assert rows[1].spans == "term:5:12,email:14:20" and all(rows[i].spans == "" for i in range(2, 32))


def test_terms_equal_all_pairs(spark):
    rng = random.Random(4)
    common = [f"word{c}{d}" for c in "abcdefgh" for d in "xyz"]
    values = ["jo@mail.org", "JO@mail.org", "ann@mail.org", "10.0.0.7", "+44 20 7946 0958", "4111 1111 1111 1111"]
    rare = {v.lower(): [f"{c * 4}é{k}na" for c in "pqrst"] for k, v in zip("abcdef", values)}
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    for _ in range(90):
        some = rng.sample(values, rng.randint(1, 3))
        bits = [*some, *(rng.choice(rare[v.lower()]) for v in some for _ in range(3)), *(rng.choice(common) for _ in range(rng.randint(0, 40)))]
        rng.shuffle(bits)
        texts.append("".join(b + rng.choice([" ", "\n", ", "]) for b in bits))
    texts += texts[-20:] + texts[-3:] * 10
    rows = {r.doc_id: r for r in pii.spans_of(rows_of(spark, texts)).collect()}
    got = [[s for s in rows[i].spans.split(",") if s.startswith("term")] for i in range(len(texts))]
    assert got == brute_terms(texts) and sum(map(len, got)) > 100


def test_long_texts_with_many_values(spark):
    """Entities and terms of copies meet as one pair, not each with each."""
    text = "\n".join(f"user{i}@mail.org {''.join(chr(97 + int(d)) for d in str(10_000 + i))}" for i in range(1_500))
    rows = pii.spans_of(rows_of(spark, [text, text, *["some other words"] * 20])).orderBy("doc_id").collect()
    assert rows[0].n_email == 1_500 and rows[0].n_term == 1_500 and rows[0].spans == rows[1].spans and rows[2].spans == ""


def test_sanitise_keeps_columns_nulls_and_repeats(spark):
    rows = [(1, "a x@y.zz", 8, "s"), (1, "a x@y.zz", 8, "s"), (None, "b +1 (555) 555-0100", 5, None), (2, None, None, "t"), (3, "", 0, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, base string")
    out = sorted(map(tuple, pii.sanitise(docs).collect()), key=str)
    assert pii.sanitise(docs).columns == docs.columns
    assert out == sorted([(1, "a [EMAIL]", 9, "s"), (1, "a [EMAIL]", 9, "s"), (None, "b [PHONE]", 9, None), (2, None, None, "t"), (3, "", 0, "t")], key=str)


def test_sanitise_counts_code_points(spark):
    texts = ["😀é x@y.zz 日本 +1 (555) 555-0100😀", "x@y.zz", "é" * 3_000 + " a@b.cc " + "😀" * 3_000]
    clean = {r.doc_id: r.text for r in pii.sanitise(rows_of(spark, texts)).collect()}
    assert clean == {0: "😀é [EMAIL] 日本 [PHONE]😀", 1: "[EMAIL]", 2: "é" * 3_000 + " [EMAIL] " + "😀" * 3_000}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.spans_of(docs).count() == 0 and pii.sanitise(docs).count() == 0


def test_plan_has_no_python(spark, corpus):
    plan = pii.spans_of(corpus[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
