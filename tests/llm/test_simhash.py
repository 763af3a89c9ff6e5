"""SimHash fingerprints, components and the documents kept, against all pairs."""

import random
import re

import numpy as np
import xxhash

from driftlens.llm import simhash
from driftlens.llm.graph import components


def brute_fingerprint(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(300)]
    texts = [None, "", " \t\n", "One", "one", "one two", "ONE two", "é É x y z"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
            texts.append("  ".join(base))
    return texts + texts[10:14]


def test_fingerprints_and_components(docs_of):
    texts = corpus()
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs_of(texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [int(rows[i].fingerprint, 16) for i in range(len(texts))] == fps and all(len(r.fingerprint) == 16 for r in rows.values())
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in rows.items()} == brute_components(range(len(fps)), pairs)


def test_every_pair_within_the_threshold_shares_an_anchor():
    rng = np.random.default_rng(1)
    for bits in (64, 32, 16):
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
        x &= np.uint64((1 << bits) - 1)
        i, j = rng.integers(0, bits, (2, 300), dtype=np.uint64)
        y = x ^ (np.uint64(1) << i) ^ (np.uint64(1) << j) * (rng.random(300) < 0.8).astype(np.uint64)
        rows_x, anchors_x = simhash.anchors_of(x, bits)
        rows_y, anchors_y = simhash.anchors_of(y, bits)
        for k in range(300):
            assert set(anchors_x[rows_x == k]) & set(anchors_y[rows_y == k])
        assert (np.bitwise_count(anchors_x ^ x[rows_x]) <= simhash.REACH).all()
        assert np.bincount(rows_x).max() <= bits // 2 + 1


def test_null_ids_repeats_and_empty_table(docs_of):
    text = "some words that are here twice"
    rows = simhash.near_duplicates(docs_of([(None, text), (7, text), (7, text), (None, "alone in the world")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5000), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    expected = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)}
    assert found == expected


def test_keep_one(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    base = [rng.choice(words) for _ in range(600)]
    texts = [" ".join(base), "  ".join(base), " ".join(base).upper()]
    for at in (100, 300):
        texts.append(" ".join([*base[:at], "other", *base[at + 1 :]]))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], None), (9, None, "n"), (8, "", None), (None, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    groups = brute_components(range(len(rows)), pairs)
    least = {}
    for i, (doc_id, text, key) in enumerate(rows):
        least[groups[i]] = min(least.get(groups[i], (2, 0, "", "")), (doc_id is None, doc_id or 0, text or "", key or ""))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.key or "") for r in kept.collect()) == sorted(least.values())
    assert len(least) < 6 and simhash.keep_one(docs.limit(0)).count() == 0
