"""Language and toxicity models: probabilities against direct counts, and accuracy on held-out documents."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from driftlens.llm import language, toxicity
from driftlens.llm.common import fold, table


def in_fold(spark, ids):
    from pyspark.sql import functions as F

    return {r.doc_id: r.f for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold(F.col("doc_id")).alias("f")).collect()}


def brute_bits(training, text):
    """Code length of a text by the same context trees, symbol by symbol."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in training:
        data = b"\0" * language.ORDER + t.encode()
        for at in range(language.ORDER, len(data)):
            for order in range(language.ORDER + 1):
                counts[data[at - order : at]][data[at]] += 1
    total, data = 0.0, b"\0" * language.ORDER + text.encode()
    for at in range(language.ORDER, len(data)):
        for order in range(language.ORDER, -1, -1):
            seen = counts.get(data[at - order : at])
            if seen is None:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if data[at] in seen:
                total -= math.log2(seen[data[at]] / (n + kinds))
                break
            total -= math.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


def test_code_lengths_equal_symbol_by_symbol(monkeypatch):
    training = {"xx": ["abracadabra", "abra", "é"], "yy": ["banana bandana", "anna"]}
    rows = []
    for lang, texts in training.items():
        for grams, _, _ in language.packed_blocks([t.encode() for t in texts], 5):
            kinds, n = np.unique(grams, return_counts=True)
            rows.append(pd.DataFrame({"lang": lang, "gram": kinds.astype(np.int64), "n": n}))
    counts = pd.concat(rows).groupby(["lang", "gram"], as_index=False)["n"].sum()
    trees = language.Trees(counts)
    texts = ["abra", "banana", "zebra cadabra é", "", "n"]
    found = trees.code_lengths([t.encode() for t in texts])
    for i, text in enumerate(texts):
        for k, lang in enumerate(trees.languages):
            assert found[i, k] == pytest.approx(brute_bits(training[lang], text))


def test_signs_and_numerals_are_no_letters():
    assert not any(language.has_letter(t) for t in ("", "12 _ !", "½ ² ① Ⅷ 〇")) and all(language.has_letter(t) for t in ("1 é", "语", "ª"))


def test_language_rows(spark):
    rng = random.Random(4)
    kinds = {"aa": ["bato", "lumi", "kera"], "bb": ["schn", "gruff", "zwei"]}
    rows = [(i, " ".join(rng.choice(kinds[lang]) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 34 !", "aa"), (None, "lumi kera", None), (103, "schn zwei", None), (103, "schn zwei", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = language.identify(docs).collect()
    assert len(told) == len(rows)
    by_id = {r.doc_id: r for r in told}
    folds = in_fold(spark, [r[0] for r in rows if r[0] is not None])
    assert all(r.held_out == (folds.get(r.doc_id) == 1) and 0 <= r.score <= 1 for r in told)
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows[:60])
    assert [by_id[i].lang_pred for i in (100, 101, 102, None, 103)] == ["und", "und", "und", "aa", "bb"]
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.where("lang is null")).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    told = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (told.lang_pred == told.lang).mean() > 0.98


def brute_evidence(training, text):
    """Log-likelihood differences of every word under both classes, from (text, toxic) pairs by the formula."""
    n = {0: defaultdict(int), 1: defaultdict(int)}
    for t, toxic in training:
        for w in set(t.split()):
            for g in toxicity.word_grams([w])[0].tolist():
                n[toxic][g & (1 << 64) - 1] += 1
    every = set(n[0]) | set(n[1])
    low = (1 << 8 * (toxicity.ORDER - 1)) - 1

    def discount(x):
        return 2.75 if x > 2 else x

    def p(kind, g, shared):
        follow = [x for x in every if x >> 8 == g >> 8 and n[kind].get(x)]
        seen = sum(n[kind][x] for x in follow)
        if not seen:
            return shared
        own = n[kind].get(g, 0)
        return (own - discount(own) + sum(discount(n[kind][x]) for x in follow) * shared) / seen

    def value(word):
        total = 0.0
        for g in toxicity.word_grams([word])[0].tolist():
            g &= (1 << 64) - 1
            before = len([x for x in every if x & low == g & low])
            shared = before / max(1, len([x for x in every if (x & low) >> 8 == (g & low) >> 8])) or 1e-9
            total += math.log(p(1, g, shared) / p(0, g, shared))
        return total

    words = text.split()
    values = [value(w) for w in words]
    strongest = sorted({w: v for w, v in zip(words, values) if v > 0}.values(), reverse=True)[: toxicity.STRONGEST]
    return sum(values) / sum(len(w.encode()) + 1 for w in words), sum(strongest)


@pytest.mark.parametrize("head", [1 << 19, 40, 0])
def test_toxic_evidence_equals_the_formula(spark, monkeypatch, head):
    """Whole texts, each by the folds that it is not in, however much of the model is joined instead of sent to the tasks."""
    monkeypatch.setattr(toxicity, "HEAD", head)
    rng = random.Random(6)
    folds = in_fold(spark, range(120))
    texts = {i: " ".join(rng.choice(["calm", "call", "cold", "warm", "wordless"]) for _ in range(6)) + (f" {rng.choice('abc')}x vile vilest" if i % 3 == 0 else "") for i in folds}
    docs = spark.createDataFrame([*texts.items(), (7, texts[7])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts], "doc_id long, toxic int")
    told = toxicity.evidence(docs, toxicity.materialize(toxicity.fit(docs, labels))).collect()
    assert len(told) == len(texts) + 1
    learnt = {f: [(texts[i], int(i % 3 == 0)) for i in texts if folds[i] in other] for f, other in ((1, (0, 2)), (0, (2,)), (2, (0,)))}
    learnt[2] += [(texts[7], 0)] if folds[7] == 0 else []
    learnt[0] += [(texts[7], 0)] if folds[7] == 2 else []
    learnt[1] += [(texts[7], 0)] if folds[7] != 1 else []
    for r in told:
        if r.doc_id % 5 == 0 or r.doc_id == 7:
            mean, top = brute_evidence(learnt[folds[r.doc_id]], texts[r.doc_id])
            assert r.mean == pytest.approx(mean, abs=1e-9) and r.top == pytest.approx(top, abs=1e-9)
    assert max(r.top for r in told) > 1


def test_long_clean_texts_are_kept(spark):
    """A megabyte of ordinary words has the score of a short ordinary text, and one with a slur in it does not hide it."""
    rng = random.Random(3)
    plain = ["".join(rng.choice("acdfgh") + rng.choice("eiou") for _ in range(3)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=50) + (["vile"] if i % 4 == 0 else []))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    long = " ".join(rng.choices(plain, k=160_000))
    rows += [(1000, long), (1001, long + " vile")]
    told = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert len(long) > 1_000_000 and told[1000].predicted == 0 and told[1001].predicted == 1


def test_toxicity_rows(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choice("acdfgh") + rng.choice("eiou") for _ in range(3)) for _ in range(40)]
    rows, marks = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic), None))
    rows += [(None, "calm vile"), (700, None), (701, ""), (702, "vile"), (702, "vile")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5, None, 0)], "doc_id long, toxic int, text int")
    told = toxicity.toxicity(docs, labels).collect()
    assert len(told) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in told)
    by_id = {r.doc_id: r.predicted for r in told}
    assert all(by_id[i] == toxic for i, toxic, _ in marks)
    assert [by_id[i] for i in (None, 700, 701, 702)] == [1, 0, 0, 1]
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not m[1] for m in marks) + 2
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    told = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    toxic = told.toxic == 1
    assert (told.predicted[toxic] == 1).mean() > 0.85 and (told.predicted[~toxic] == 1).mean() < 0.02
