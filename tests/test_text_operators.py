import random
import re
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from driftlens.functions.lcs import lcs_length, lcs_places, summary_hits
from driftlens.functions.text import rouge_words, shared_ngrams, words
from driftlens.operators import adapters, aggregates, dialog, metrics, perturb
from driftlens.operators.negatives import answer_pool, random_negative


@pytest.mark.parametrize("block", [1, 3, 256])
def test_dialog_prefixes(spark, block):
    rows = [(c, t, f"c{c}t{t}") for c, n in ((1, 1), (2, 2), (3, 11)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3)
    got = {(r["conv_id"], r["turn"]): (r["source"], r["target"]) for r in dialog.accumulate_dialog(df, eos="|", block_turns=block).collect()}
    want = {}
    for c, n in ((2, 2), (3, 11)):
        for t in range(n - 1):
            want[(c, t)] = ("".join(f"c{c}t{i}|" for i in range(t + 1)), f"c{c}t{t + 1}")
    assert got == want


def test_negatives_agree_on_both_ways_and_differ_from_the_answer(spark):
    rng = random.Random(2)
    # "hot" is above a thousandth of the pool, the others of 1,500 rows mostly below.
    answers = ["hot"] * 300 + [f"a{i}" for i in range(1_200)]
    rng.shuffle(answers)
    df = spark.createDataFrame([(i, "train" if i % 4 else "test", a) for i, a in enumerate(answers)], "row_id long, split string, good string")
    pool = answer_pool(df, F.array("good"))
    broadcast = random_negative(df, pool, "good")
    shuffled = random_negative(df, pool, "good", max_broadcast=0, slot=16)
    one, two = ({r["row_id"]: r["negative"] for r in d.collect()} for d in (broadcast, shuffled))
    assert one == two and len(one) == 1_500
    assert all(one[i] != a for i, a in enumerate(answers))
    drawn = Counter(one.values())
    assert drawn["hot"] > 100  # a third of the pool stays a third of the draws for other answers
    other = random_negative(df, pool, "good", max_broadcast=0, slot=16, pool_split="test")
    assert other.where("negative is null or negative = good").count() == 0 and other.count() == 1_500


def test_more_rows_than_pool_places(spark):
    df = spark.createDataFrame([(i, "train", "x") for i in range(500)], "row_id long, split string, good string")
    pool = spark.createDataFrame([("train", "x", 1), ("train", "y", 1), ("train", "z", 2)], "split string, answer string, n long")
    one = random_negative(df, pool, "good").orderBy("row_id").collect()
    two = random_negative(df, pool, "good", max_broadcast=0, slot=2).orderBy("row_id").collect()
    assert one == two and {r["negative"] for r in one} == {"y", "z"}


def test_rows_without_an_answer_draw_from_the_whole_pool(spark):
    df = spark.createDataFrame([(i, "train", None if i % 2 else "x") for i in range(40)], "row_id long, split string, good string")
    pool = spark.createDataFrame([("train", "x", 1), ("train", "y", 1)], "split string, answer string, n long")
    one, two = (random_negative(df, pool, "good", **how).orderBy("row_id").collect() for how in ({}, {"max_broadcast": 0, "slot": 2}))
    assert one == two
    assert {r["negative"] for r in one if r["good"] is None} == {"x", "y"} and {r["negative"] for r in one if r["good"]} == {"y"}


def test_pool_without_another_answer_raises(spark):
    df = spark.createDataFrame([(1, "train", "x")], "row_id long, split string, good string")
    with pytest.raises(Exception, match="no other answer"):
        random_negative(df, answer_pool(df, F.array("good")), "good").collect()


def test_perturbations(spark):
    df = spark.createDataFrame([(1, "Straße  ab cd\tef"), (2, "")], "row_id long, text string")
    every = df.select("row_id", perturb.upper_words(F.col("text"), F.col("row_id"), 1.0).alias("u"), perturb.delete_chars(F.col("text"), F.col("row_id"), 1.0).alias("d"))
    never = df.select("row_id", perturb.upper_words(F.col("text"), F.col("row_id"), 0.0).alias("u"), perturb.delete_chars(F.col("text"), F.col("row_id"), 0.0).alias("d"))
    assert [tuple(r) for r in every.orderBy("row_id").collect()] == [(1, "STRASSE AB CD EF", ""), (2, "", "")]
    assert [tuple(r) for r in never.orderBy("row_id").collect()] == [(1, "Straße ab cd ef", "Straße  ab cd\tef"), (2, "", "")]


def brute_draw(name, key, k):
    return md5(":".join([name, *([] if key is None else [str(key)]), str(k // 4)]).encode()).hexdigest()[k % 4 * 8 :][:8]


@pytest.mark.parametrize("block", [1, 20, 1 << 20])
def test_perturbations_follow_the_draws(spark, monkeypatch, block):
    monkeypatch.setattr(perturb, "BLOCK_BYTES", block)
    limit = format(int(0.4 * 2**32), "08x")
    texts = ["", None, "a", "fünf Wörter über 𝄞 Noten", " \t\n ", "日本語 テキスト", "x y z " * 200, "same words", "same words"]
    rows = [(None if i == 8 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(2)
    got = df.select("*", *[f(F.col("text"), F.col("row_id"), 0.4, 7).alias(n) for n, f in (("d", perturb.delete_chars), ("u", perturb.upper_words))])
    want = {}
    for row, text in rows:
        thin = text and "".join(c for k, c in enumerate(text) if brute_draw("7c", row, k) >= limit)
        upper = None if text is None else " ".join(w.upper() if brute_draw("7w", row, k) < limit else w for k, w in enumerate(text.split()))
        want[row] = (text, thin, upper)
    assert {r["row_id"]: (r["text"], r["d"], r["u"]) for r in got.collect()} == want


def test_perturbing_no_rows(spark):
    assert perturb.perturb(spark.createDataFrame([], "row_id long, source string"), "hallucination").collect() == []


def test_instruction_or_hallucination(spark):
    df = spark.createDataFrame([(1, "abc")], "row_id long, source string")
    assert perturb.perturb(df, None, "Do: ").first()["source"] == "Do: abc"
    assert perturb.perturb(df, "hallucination", p=1.0).first()["source"] == ""


def test_adapters_raise_on_unknown_values(spark):
    df = spark.createDataFrame([("a",), ("q",)], "label string")
    with pytest.raises(Exception, match="unknown label q"):
        adapters.map_labels(df, {"a": 0}).collect()
    with pytest.raises(Exception, match="exactly one tab"):
        adapters.parse_tsv_qa(spark.createDataFrame([("1q",)], "text string")).collect()
    codes = adapters.label_codes(spark.createDataFrame([("b",), ("ab",), ("aa",), ("b",)], "c string"), "c")
    assert {r["label"]: r["code"] for r in codes.collect()} == {"b": 0, "ab": 1, "aa": 2}


def test_idf_sums_to_one(spark):
    df = spark.createDataFrame([("a b b",), ("a c",)], "text string")
    rows = {r["token"]: r for r in aggregates.idf(df, also=spark.createDataFrame([("a b d",), ("c",)], "text string")).collect()}
    assert abs(sum(r["weight"] for r in rows.values()) - 1) < 1e-12
    assert rows["a"]["df"] == 2 and rows["d"]["df"] == 0 and rows["a"]["idf"] == 0.0


def test_token_stats_of_empty_sequences(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [])], "sample_id long, token_scores array<double>")
    got = [tuple(r)[1:] for r in aggregates.token_stats(df).orderBy("sample_id").collect()]
    assert got == [(2.0, 1.0), (None, None)]


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table


def brute_places(a, b):
    table, i, j, out = brute_lcs(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_lcs_against_the_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert lcs_length(a, b) == brute_lcs(a, b)[-1][-1]
        assert lcs_places(a, b) == brute_places(a, b)


def test_union_lcs_example():
    # Lin (2004): w1..w5 against two candidate sentences has a union of four words.
    assert summary_hits([["w1", "w2", "w3", "w4", "w5"]], [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]) == 4


def test_shared_ngrams_are_multiset_intersections(spark):
    rng = random.Random(7)
    rows = [([rng.choice("abcde") for _ in range(rng.randrange(9))], [rng.choice("abcde") for _ in range(rng.randrange(9))]) for _ in range(60)]
    rows += [([], []), (None, ["a"]), (["a"] * 9, ["a"] * 7)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").repartition(2)

    def grams(tokens, n):
        return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))

    for r in df.select("a", "b", shared_ngrams(F.col("a"), F.col("b"), 4).alias("n")).collect():
        a, b = r["a"] or [], r["b"] or []
        assert r["n"] == [sum((grams(a, n) & grams(b, n)).values()) for n in range(1, 5)]


PAIRS = [(0, 0, "the cat sat on the mat", "the cat sat on the mat"), (1, 0, "a b", "c d e f"), (2, 0, "", "x y"), (3, 0, "the the the", "the cat")]


def test_metrics_on_known_pairs(spark):
    df = spark.createDataFrame(PAIRS, "sample_id long, seq_id int, hyp string, ref string")
    bleu = {r["sample_id"]: r["bleu"] for r in metrics.sentence_bleu(df).collect()}
    assert abs(bleu[0] - 100) < 1e-9 and bleu[1] == 0 and bleu[2] == 0
    # Orders 1-3 fit three tokens: 1/3 clipped, then 0/2 and 0/1 smoothed to 1/4 and 1/4.
    assert abs(bleu[3] - 100 * (1 / 3 * 1 / 4 * 1 / 4) ** (1 / 3)) < 1e-9
    rouge = {r["sample_id"]: r for r in metrics.rouge_n(df).collect()}
    assert rouge[0]["rouge2_fmeasure"] == 1 and rouge[3]["rouge1_recall"] == 0.5 and rouge[2]["rouge1_fmeasure"] == 0
    assert {r["sample_id"]: r["rougeL_fmeasure"] for r in metrics.rouge_l(df).collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.4}
    assert abs(metrics.corpus_bleu(df.where("sample_id = 0")).first()["bleu"] - 100) < 1e-9


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corpus_rouge_is_the_mean_from_one_worker(spark):
    """The means of the metrics on stripped texts, from a single Python step with bounded batches: each further step is a worker of its own."""
    rng = random.Random(8)
    rows = [(i, i % 2, *("".join(rng.choice(["the ", "cat ", "sat. ", "Mat\n", " on "]) for _ in range(rng.randrange(40))) for _ in range(2))) for i in range(80)]
    df = spark.createDataFrame([*rows, (99, 0, "", "a b. c")], "sample_id long, seq_id int, hyp string, ref string").repartition(3)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = metrics.corpus_rouge(df)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    plan = plan_of(got)
    assert len(re.findall(r"ArrowEvalPython \[", plan.split("Initial Plan")[0])) == 1 and "BatchEval" not in plan
    stripped = df.withColumns({c: F.trim(c) for c in ("hyp", "ref")})
    for name, scores in (("rouge1", metrics.rouge_n(stripped)), ("rouge2", metrics.rouge_n(stripped)), ("rougeL", metrics.rouge_l(stripped)), ("rougeLsum", metrics.rouge_lsum(stripped))):
        values = [r[0] for r in scores.select(f"{name}_fmeasure").collect()]
        assert len(values) == 81 and abs(got.first()[name] - sum(values) / 81) < 1e-12


def test_stems_come_from_a_table(spark):
    df = spark.createDataFrame([(0, 0, "Cats sat", "cat sits")], "sample_id long, seq_id int, hyp string, ref string")
    stems = spark.createDataFrame([("cats", "cat"), ("sits", "sit"), ("sat", "sit")], "token string, stem string")
    plain = metrics.rouge_n(df, (1,)).first()["rouge1_fmeasure"]
    stemmed = metrics.rouge_n(metrics.stemmed(rouge_words, df, stems, ["hyp", "ref"]), (1,)).first()["rouge1_fmeasure"]
    assert plain == 0 and stemmed == 1


@pytest.mark.parametrize("how", [{}, {"max_broadcast": 0}, {"max_broadcast": 0, "block_bytes": 60}])
def test_stems_of_many_rows(spark, how):
    rng = random.Random(9)
    tokens = [c + d for c in "abcd" for d in "wxyz"]
    rows = [(i // 3, i % 3, i, *(" ".join(rng.choice(tokens) for _ in range(rng.randrange(12))) for _ in range(2))) for i in range(60)]
    rows += [(70, 0, 70, None, "aw  zz"), (71, 0, 71, "", None), (72, 0, 72, "é 日本", "ÀW aw")]
    df = spark.createDataFrame(rows, "sample_id long, seq_id int, more long, hyp string, ref string").repartition(3)
    stem = {t: t[0] for t in tokens[:10]}
    table = spark.createDataFrame([*stem.items(), (None, "n"), ("zz", None)], "token string, stem string")
    got = metrics.stemmed(words, df, table, ["hyp", "ref"], **how)
    assert got.columns == df.columns
    want = [(*r[:3], *(" ".join(stem.get(t, t) for t in (x or "").split()) for x in r[3:])) for r in rows]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stems_of_a_small_table_move_no_row(spark):
    """Also a token table whose every row is kept: texts are stemmed where they are, without a shuffle of tokens."""
    df = spark.createDataFrame([(0, 0, "Cats sat", "cat sits")], "sample_id long, seq_id int, hyp string, ref string")
    stems = spark.createDataFrame([("cats", "cat"), ("sits", "sit"), ("sat", "sit"), ("cat", "cat")], "token string, stem string")
    plan = plan_of(metrics.stemmed(rouge_words, df, stems, ["hyp", "ref"]))
    assert "Exchange" not in plan and "Generate" not in plan


def test_words_split_like_python(spark):
    text = " a b c\x1cd\x85e\n\tf "
    assert spark.createDataFrame([(text,)], "t string").select(words(F.col("t"))).first()[0] == text.split()


def test_mean_matrix_shapes(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0]), (3, [])], "sample_id long, s array<double>")
    assert [tuple(r) for r in adapters.pad_matrix(df, "s").orderBy("sample_id").collect()] == [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 2.0, 3.0], 3), (3, [0.0, 0.0, 0.0], 0),
    ]
