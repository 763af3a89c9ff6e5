"""Tiling, fingerprints, URL rules and mixing against direct computations."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from driftlens.llm import mixing, syncmers, tiling, url_rules


def brute_tiling(text, item, shortest):
    """Greedy string tiling, word by word."""
    used_t, used_i, marked = [False] * len(text), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(text)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and not used_t[i + k] and not used_i[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < shortest:
            return marked
        used_t[i : i + k] = [True] * k
        used_i[j : j + k] = [True] * k
        marked += k


def test_tiling_equals_word_by_word():
    rng = random.Random(1)
    for _ in range(150):
        words = [f"w{k}" for k in range(rng.choice([3, 8, 40]))]
        item = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(item))
            text[rng.randint(0, len(text)) : 0] = item[a : a + rng.randint(3, 20)]
        found = dict(tiling.Items([(7, " ".join(item))]).coverages(" ".join(text)))
        assert found.get(7, 0) == pytest.approx(brute_tiling(text, item, tiling.SHORTEST) / len(item))


def test_decontamination(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    passage = words[:40]
    moved = words[20:40] + ["other"] * 3 + words[:20]
    rows = [(1, "intro " + " ".join(passage).upper() + ", end."), (2, " ".join(moved)), (3, " ".join(words[:20])), (4, None), (5, ""),
            (None, " ".join(passage)), (6, "a b c d"), (6, " ".join(passage)), (6, "a b c d")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(1, " ".join(passage)), (2, "a b c d"), (3, None), (None, "x"), (1, " ".join(words[40:]))], "item_id long, text string")
    for size in (8 << 20, 50):  # one block of items, or several
        monkeypatch.setattr(tiling, "BLOCK_BYTES", size)
        found = sorted(((r.doc_id or 0, r.item_id, r.coverage) for r in tiling.matches(docs, benchmark).collect()))
        assert found == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (6, 1, 1.0)]
        kept = tiling.decontaminate(docs, benchmark)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, rows[2][1]), (4, ""), (5, ""), (6, "a b c d"), (6, "a b c d")]
    assert tiling.matches(docs.limit(0), benchmark).count() == 0
    assert tiling.matches(docs, benchmark.limit(0)).count() == 0 and tiling.decontaminate(docs, benchmark.limit(0)).count() == len(rows)


def brute_anchors(text):
    """Closed syncmers by looking at every string."""
    def h(b):
        return int(syncmers.mix(np.array([int.from_bytes(b, "big")], np.uint64))[0])

    out = []
    for i in range(len(text) - syncmers.K + 1):
        inner = [h(text[j : j + syncmers.S]) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_fingerprints_have_the_least_anchors_and_their_share():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (0, 5, 19, 20, 21, 60, 200, 200, 9000)] + ["é äö ".encode() * 30, b"a" * 500]
    for text, found in zip(texts, syncmers.fingerprints(texts)):
        places = brute_anchors(text)
        distinct = len({text[p : p + syncmers.K] for p in places})
        keys, at = syncmers._anchors(found)
        assert set(at.tolist()) <= set(places or [0]) and (np.diff(keys) > 0).all()
        assert bool(len(keys)) == bool(text)
        if places:
            assert len(keys) == max(min(distinct, syncmers.KEEP), (keys < syncmers._LOW).sum())
    assert len(syncmers._anchors(syncmers.fingerprints(texts)[8])[0]) > 2 * syncmers.KEEP
    assert syncmers.fingerprints(texts) == [syncmers.fingerprints([t])[0] for t in texts]
    some = syncmers.fingerprints([b"abc"])[0]
    assert syncmers.likeness("", "") == 1 and syncmers.likeness("", some) == 0 and syncmers.likeness(some, some) == 1


def test_passages_are_found_wherever_they_stand():
    rng = random.Random(8)

    def text(words):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))

    found = 0
    for _ in range(20):
        one, other, shared = text(8000), text(8000), text(60)
        a, b = syncmers.fingerprints([f"{one[:20000]} {shared} {one[20000:]}".encode(), f"{other[:30000]} {shared} {other[30000:]}".encode()])
        found += syncmers.likeness(a, b) > 0
    assert found >= 16
    whole = text(2000)
    inserted, swapped = whole[:6000] + " " + text(20) + " " + whole[6000:], whole[6000:] + whole[:6000]
    a, b, c, d = syncmers.fingerprints([x.encode() for x in (whole, inserted, swapped, text(2000))])
    assert syncmers.likeness(a, b) > 0.95 and syncmers.likeness(a, c) > 0.95 and syncmers.likeness(a, d) < 0.05


def test_fingerprint_of_a_megabyte():
    rng = random.Random(5)
    long = "".join(rng.choice("abcde fgh") for _ in range(1_200_000))
    a, b = syncmers.fingerprints([long.encode(), (long[:600_000] + long[700_000:]).encode()])
    assert 0.9 < syncmers.likeness(a, b) < 1


def test_edits(spark):
    rng = random.Random(3)
    texts = [None, "", "é", "ab"] + ["".join(rng.choice("abcdé 😀") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "last one"), (2000, "twin"), (2000, "twin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = syncmers.fingerprint_edits(docs).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for k, (doc, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        marks = syncmers.fingerprints([text.encode(), changed.encode(), following.encode()])
        expected.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), marks[0], marks[1], syncmers.likeness(*marks[:2]), syncmers.likeness(marks[0], marks[2])))
    assert sorted(map(tuple, told), key=str) == sorted(expected, key=str)
    single = syncmers.fingerprint_edits(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).first()
    assert single.near_next == 1 and single.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert syncmers.fingerprint_edits(docs.limit(0)).count() == 0


URLS = ["http://a.Example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "https://example.org/en/2", "http://x.org", "http://b.com/fr/3#t", "http://com/de/", "http://badcom/de/",
        "http://net/de/?u=http://org/", "no scheme", "", None, "://org/", "ftp://m.org?q/", "HTTP://c.com/de/é\n?z"]


def brute_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_given_rules_and_mined_ones(spark):
    rng = random.Random(5)
    more = [f"http://{rng.choice(['good', 'good', 'good', 'spam'])}.net/{rng.choice(['a', 'b'])}/{k}?{rng.choice(['u', 'v'])}=1" for k in range(300)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, *more])] + [(None, "http://spam.net/a/1?u=1", "x"), (400, more[0], "x"), (400, more[0], "x")], "page_id long, url string, rule string")
    marks = [(i + len(URLS), int("spam" not in u), 0) for i, u in enumerate(more) if i % 2]
    labels = spark.createDataFrame([*marks, (None, 0, 1)], "doc_id long, quality int, toxic int")
    told = url_rules.judge(pages, labels).collect()
    assert len(told) == len(URLS) + 303
    for r in told:
        if r.page_id is not None and r.page_id < len(URLS):
            host, path, rule, verdict = brute_rule(URLS[r.page_id])
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
        elif r.page_id is not None and r.page_id < 400:
            assert r.verdict == ("block" if "spam" in more[r.page_id - len(URLS)] else "allow") and r.rule is None
    assert [r.verdict for r in told if r.page_id is None] == ["block"]
    assert url_rules.judge(pages.limit(0), labels).count() == 0
    assert {r.mined_rule for r in url_rules.judge(pages, labels.limit(0)).collect()} == {None}


def test_mined_rules_equal_counting_every_combination(spark):
    rng = random.Random(7)
    rows = [(f"http://{rng.choice('ab')}.{rng.choice(['net', 'com'])}/{rng.choice('pq')}", int(rng.random() < 0.4)) for _ in range(80)]
    labelled = spark.createDataFrame(rows, "url string, block int")
    tokens = {r.url: set(r.t) for r in labelled.select("url", url_rules.tokens_of(labelled.url).alias("t")).distinct().collect()}
    found = {tuple(r.antecedent): (r.confidence, r.support) for r in url_rules.mine(labelled, 0.05, 0.45).collect()}
    expected = {}
    for size in range(1, 6):
        for combo in itertools.combinations(sorted(set().union(*tokens.values())), size):
            have = [b for u, b in rows if tokens[u] >= set(combo)]
            if sum(have) >= 0.05 * len(rows) and sum(have) / len(have) >= 0.45:
                expected[combo] = (sum(have) / len(have), sum(have) / len(rows))
    assert set(found) == set(expected)
    assert all(found[c] == pytest.approx(expected[c]) for c in expected)


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 500)
    tokens = rng.integers(0, 300, 500)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p)], "n_tokens long, posterior array<double>")
    moves = mixing.fit_rates(rows, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1, "none": 3.0})
    rate = mixing.rates_of(p, moves)
    reached = (rate * tokens) @ p
    assert (rate >= 0).all() and reached / reached.sum() == pytest.approx([0.6, 0.3, 0.1], abs=1e-4)
    assert reached.sum() == pytest.approx(tokens.sum(), rel=1e-4)
    # Out of reach: two kinds of documents, both half in either domain; the best is the least square.
    flat = spark.createDataFrame([(10, [0.5, 0.5])] * 4, "n_tokens long, posterior array<double>")
    assert mixing.rates_of(np.full((4, 2), 0.5), mixing.fit_rates(flat, ["a", "b"], {"a": 1.0})) == pytest.approx([1.0] * 4, abs=1e-3)
    assert mixing.fit_rates(flat, ["a", "b"], {"z": 1.0}) == []


def test_mixing_documents(spark):
    rng = random.Random(2)
    kinds = {"x": "abcdef", "y": "uvwxyz"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(30)), k, 1.0) for i, k in enumerate("xxxy" * 50)]
    rows += [(None, "abc def", None, 1.0), (900, None, None, 1.0), (901, "", None, 1.0), (0, rows[0][1], "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate double")
    labelled = spark.createDataFrame([(i, k) for i, _, k, _ in rows[:120]] + [(None, "x"), (3, None), (5, "y")], "doc_id long, domain string")
    told = mixing.rated(docs, labelled, {"x": 1, "y": 1})
    frame = told.toPandas()
    frame["mass"] = frame.rate * frame.n_tokens
    share = frame.groupby("domain").mass.sum() / frame.mass.sum()
    assert len(frame) == len(rows) and share.to_dict() == pytest.approx({"x": 0.5, "y": 0.5}, abs=0.05)
    mixed = mixing.mix(docs, labelled, {"x": 1, "y": 1})
    assert mixed.columns == ["doc_id", "text", "lang", "rate", "copies"]
    out = mixed.collect()
    assert len(out) == len(rows) and all(abs(r.copies - r.rate) < 1 for r in out)
    assert mixing.rated(docs.limit(0), labelled, {"x": 1}).count() == 0
    assert {r.rate for r in mixing.rated(docs, labelled.limit(0), {"x": 1}).collect()} == {1.0}
