"""Manifests, proofs and folds against a direct version, for trees of many shapes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftlens.llm import merkle
from driftlens.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))
    return sha("".join(parts))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        start = at // 3 * 3
        out.append((nodes[start:at], nodes[at + 1 : start + 3]))
        at //= 3
    return out


def direct(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        levels[s] = levels_of([leaf(*r) for r in trees[s]])
    top = levels_of([levels[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for k, row in enumerate(trees[s]):
            path = path_of(levels[s], k) + path_of(top, at)
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row[0], text, *row[2:])
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path))
            out.append((row[0], leaf(*row), levels[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("step", [4, 1])
def test_trees_of_many_shapes(spark, step):
    sizes = {None: 5, "": 1, "=": 2, "a": 3, "b": 27, "é": 28, "ß": 81, "z": 82, "Z": 244}
    if step == 1:
        sizes = {None: 5, "": 1, "a": 9, "é": 10, "Z": 28}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 7
            rows.append((i % 1009, f"text {i}\nof\n\n{source}é" if i % 3 else "no break", None if i % 5 == 0 else "en", source, i))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(merkle.manifest(df, merkle.without_line_breaks(), step)) == direct(rows)


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "", "-", None, 0), (None, "x\ny", "en", "s", 3), (5, None, None, "s", None), (5, "a\nb", "en", "s", 3),
        (5, "a\nb", "en", "s", 3), (-3, "\n" * 10, "fr", "s", 10), (1, "word\n" * 200_000, "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "digest", "position", "total")})
    assert found(merkle.manifest(df, merkle.without_line_breaks())) == direct(rows)
    assert found(merkle.manifest(df.limit(0), merkle.without_line_breaks())) == []


def test_one_document(spark):
    row = (2, "alone\n", "en", "s", 6)
    [found_row] = merkle.manifest(spark.createDataFrame([row], SCHEMA)).collect()
    assert tuple(found_row) == (2, leaf(*row), leaf(*row), leaf(*row), sha(""), leaf(*row), True)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    told = found(merkle.manifest(docs, merkle.without_line_breaks()))
    assert told == direct(rows) and {r[-1] for r in told} == {True, False}


def test_every_change_shows(spark):
    """A changed field other than the text is found too, by the leaf alone."""
    rows = [(i, f"t{i}", "en", "s", i) for i in range(10)]
    whole = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).first().root
    for change in ((0, "t0", "fr", "s", 0), (0, "t0", "en", "s", 9), (0, "t0", "en", "r", 0), (11, "t0", "en", "s", 0), (0, None, "en", "s", 0)):
        assert merkle.manifest(spark.createDataFrame([change, *rows[1:]], SCHEMA)).first().root != whole
