import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftlens.operators import perturb
from driftlens.operators.splits import cap
from driftlens.sources import corpus, records, recipes
from driftlens.sources.recipes import CLASSIFICATION, GENERATION, Store, load_classification, load_config, load_generation

N = 40  # rows per stored split

TEXT = {
    "glue/mnli": "premise string, hypothesis string, label int",
    "glue/rte": "sentence1 string, sentence2 string, label int",
    "glue/sst2": "sentence string, label int, text string",
    "snli": "premise string, hypothesis string, label int",
    "tweet_eval/emoji": "text string, label int",
    "go_emotions/simplified": "text string, labels array<int>",
    "trec": "text string, `label-coarse` int, `label-fine` int",
    "imdb": "text string, label int",
    "yelp_polarity": "text string, label int",
    "banking77": "text string, label int",
    "massive/en-US": "utt string, intent int",
    "emotion": "text string, label int",
    "twitter_financial_news_sentiment": "text string, label int",
    "flue/XNLI": "premise string, hypo string, label int",
    "flue/PAWS-X": "sentence1 string, sentence2 string, label int",
    "flue/CLS": "text string, label int",
    "french_book_reviews": "reader_review string, label int",
    "allocine": "review string, label int",
    "german_argument_mining": "input_sentence string, label string",
    "catalonia_independence/spanish": "TWEET string, LABEL int",
    "muchocine": "review_summary string, star_rating string",
    "sst2-es-mt": "sentence_es string, label int",
    **{f"x-stance/{lang}": "question string, comment string, label int" for lang in ("fr", "es", "de")},
    **{f"swiss_judgment_prediction/{lang}": "text string, label int" for lang in ("fr", "de")},
    **{f"tweet_sentiment_multilingual/{lang}": "text string, label int" for lang in ("french", "spanish", "german")},
    **{f"paws-x/{lang}": "sentence1 string, sentence2 string, label int" for lang in ("es", "de")},
    **{f"newsgroup/{group}": "text string" for group in recipes.NEWS_GROUPS},
    "amazon_reviews_multi/en": "review_body string, review_title string, product_category string",
}
CHOICES = "choices struct<text: array<string>, label: array<string>>, answerKey string"
ANSWERS = "context string, question string, answers struct<text: array<string>, answer_start: array<int>>"
PAIRED = "translation map<string,string>"
GENERATED = {
    "daily_dialog": "dialog array<string>",
    "multi_woz_v22": "turns struct<utterance: array<string>>",
    "wiki_movies": "text string",
    "silicone": "Utterance string",
    "wmt16/de-en": PAIRED,
    "news_commentary/en-de": PAIRED,
    "emea/de-en": PAIRED,
    "europarl_bilingual/en-es": PAIRED,
    "tatoeba_mt/deu-eng": "sourceLang string, sourceString string, targetString string",
    "web_questions": "question string, answers array<string>",
    "openbookqa/additional": f"fact1 string, question_stem string, {CHOICES}",
    "ai2_arc/ARC-Easy": f"question string, {CHOICES}",
    "quartz": f"para string, {CHOICES}",
    "sciq": "support string, question string, distractor1 string, distractor2 string, distractor3 string, correct_answer string",
    "trivia_qa/rc": "question string, answer struct<value: string>, search_results struct<search_context: array<string>>",
    "trivia_qa/rc.nocontext": "question string, answer struct<value: string>",
    "coqa": "story string, questions array<string>, answers struct<input_text: array<string>>",
    "tweetqa": "Tweet string, Question string, Answer array<string>",
    "natural_instructions": "definition string, inputs string, targets string",
    "squad_v2": ANSWERS,
    "cuad": ANSWERS,
    "cnn_dailymail/3.0.0": "article string, highlights string",
    "xsum": "document string, summary string",
    "billsum": "text string, summary string",
    "multi_news": "document string, summary string",
}


def value(name, kind, i, corpus_name):
    if name == "labels" or kind == "array<int>":
        return [i % 3]
    if name == "label" and kind == "string":
        return ["conclusion", "definition", "subsumption", "other"][i % 4]
    if name == "product_category":
        return ["toy", "book", "wine"][i % 3]
    if name == "star_rating":
        return str(i % 5 + 1)
    if name == "sourceLang":
        return "eng"
    if name == "answerKey":
        return "AB"[i % 2]
    if name == "translation":
        codes = ("de", "en") if "es" not in corpus_name.split("/")[1] else ("es", "en")
        return {c: f"{c} {i}" for c in codes}
    if kind.startswith("struct"):
        if name == "choices":
            return {"text": [f"yes {i}", f"no {i % 7}"], "label": ["A", "B"]}
        if name == "answers" and "answer_start" in kind:
            known = i % 2 == 0 or corpus_name == "cuad"
            return {"text": [f"answer {i}"] if known else [], "answer_start": [0] if known else []}
        if name == "answers":
            return {"input_text": [f"a{i}.{k}" for k in range(2)]}
        if name == "turns":
            return {"utterance": [f"u{k}" for k in range(3)]}
        if name == "search_results":
            return {"search_context": [f"line {i}\nmore"]}
        return {"value": f"value {i}"}
    if kind == "array<string>":
        return [f"{name} {i}.{k}" for k in range(3)]
    if name == "text" and corpus_name == "wiki_movies":
        return f"1question {i}\tanswer {i}"
    return f"{name} {i}" if kind == "string" else i % 2


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    for name, schema in {**TEXT, **GENERATED}.items():
        fields = spark.createDataFrame([], schema).schema.fields
        rows = [(i, *[value(f.name, f.dataType.simpleString(), i, name) for f in fields]) for i in range(N)]
        table = spark.createDataFrame(rows, f"row_id long, {schema}").toArrow()
        splits = {
            "imdb": ("train", "test", "unsupervised"), "glue/mnli": ("train", "validation", "test_matched", "test_mismatched"),
            "banking77": ("train", "test"), "web_questions": ("train", "test"), "billsum": ("train", "test"),
        }.get(name, ("train", "validation", "test"))
        os.makedirs(f"{root}/{name}")
        for split in splits:
            pq.write_table(table, f"{root}/{name}/{split}.parquet")
    return Store(spark, root)


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


SIZES = {  # train, validation, test of each recipe on stored splits of N rows
    "mnli": (N, N, 2 * N), "rte": (N, 2 * N, N), "glue_sst2": (N, 2 * N, N), "go_emotions": (N, 2 * N, N), "20ng": (20 * 32, 20 * 4, 20 * 4),
    "trec": (36, 4, N), "trec_fine": (36, 4, N), "imdb": (36, 4 + N, N), "yelp": (4, 0, N), "twitterfin": (N, 0, N),
    "fr_cls": (N, 2 * N, N), "fr_book_reviews": (N, 0, 0), "de_lexarg": (N, 2 * N, N), "es_cine": (3 * N, 0, 0),
    **{f"{lang}_xstance": (N, 2 * N, N) for lang in ("fr", "es", "de")},
}


@pytest.mark.parametrize("name", sorted(CLASSIFICATION))
def test_classification_recipes(store, name):
    keys = ("text", None) if name == "yelp" else None
    df = load_classification(store, name, keys=keys)
    got = sizes(df)
    assert tuple(got.get(s, 0) for s in ("train", "validation", "test")) == SIZES.get(name, (N, N, N))
    assert df.where("text is null or labels is null").count() == 0
    assert {"row_id", "split", "text", "labels"} <= set(df.columns)


@pytest.mark.parametrize(
    "name,config,expected",
    [
        ("daily_dialog", "", (2 * N, 2 * N, 2 * N)), ("multi_woz_v22", "", (2 * N, 2 * N, 2 * N)), ("movieqa", "", (N, N, N)),
        ("silicone", None, (N, N, N)), ("wmt16", "de-en", (N, N, N)), ("tatoeba_mt", "deu-eng", (32, 8, N)),
        ("news_commentary", "de-en", (32, 4, 4)), ("emea", "de-en", (32, 4, 4)), ("europarl_bilingual", "es-en", (28, 8, 4)),
        ("amazon_reviews_multi", "en", (N, N, N)), ("web_questions", "", (N, N, N)),
        ("openbookqa", "answerable", (N, N, N)), ("openbookqa", "unanswerable", (N, N, N)),
        ("ai2_arc", "answerable_ARC-Easy", (N, N, N)), ("ai2_arc", "unanswerable_ARC-Easy", (N, N, N)),
        ("quartz", "answerable", (N, N, N)), ("quartz", "unanswerable", (N, N, N)), ("sciq", "answerable", (N, N, N)), ("sciq", "unanswerable", (N, N, N)),
        ("trivia_qa", "closed_book", (N, N, N)), ("trivia_qa", "open_book_answerable", (N, N, N)), ("coqa", "answerable", (2 * N, 0, 2 * N)),
        ("tweetqa", "answerable", (N, N, N)), ("tweetqa", "unanswerable", (N, N, N)), ("natural_instructions", "", (N, N, N)),
        ("squad_v2", "answerable", (0, 20 + 20, 0)), ("squad_v2", "unanswerable", (0, 20 + 20, 0)), ("cuad", "answerable", (0, N + N, 0)), ("cuad", "unanswerable", (0, N + N, 0)),
        ("cnn_dailymail", "3.0.0", (N, N, N)), ("xsum", "", (N, N, N)), ("billsum", "", (N, 0, N)), ("multi_news", "", (N, N, N)),
    ],
)
def test_generation_recipes(store, name, config, expected):
    df = load_generation(store, name, config)
    got = sizes(df)
    assert tuple(got.get(s, 0) for s in ("train", "validation", "test")) == expected
    assert df.where("source is null or target is null").count() == 0
    if "unanswerable" in (config or ""):
        assert df.where("target <> 'None'").count() == 0


def first(df, split="train"):
    return df.where(F.col("split") == split).orderBy("row_id").first()


def test_prompt_texts(store):
    assert first(load_config(store, "openbookqa_answerable"))["source"] == "Context:fact1 0 ; Question: question_stem 0 ; Choices: yes 0 - no 0"
    assert first(load_config(store, "openbookqa_answerable"))["target"] == "yes 0"
    assert first(load_config(store, "ai2arceasy_answerable"))["source"] == "Context: ; Question: question 0 ; Choices: yes 0 - no 0"
    assert first(load_config(store, "quartz_answerable"))["source"] == "Context:para 0 ; Question: yes 0- no 0"
    assert first(load_config(store, "triviaqa_answerable"))["source"] == "Context: line 0 more ; Question: question 0"
    assert first(load_config(store, "coqa_answerable"))["source"].startswith("Context: story 0 ; Question: questions 0.")
    assert first(load_config(store, "tweetqa_answerable"))["source"] == "Context:Tweet 0 ; Question: Question 0"
    assert first(load_config(store, "natural_instructions"))["source"] == "definition 0.\n inputs 0"
    assert first(load_config(store, "squad_v2_answerable"), "validation")["target"] == "answer 0"
    assert first(load_generation(store, "movieqa"))["source"] == "question 0"
    assert first(load_generation(store, "tatoeba_mt", "deu-eng"))["source"] == "targetString 0"
    assert first(load_generation(store, "europarl_bilingual", "es-en"))["source"] == "es 0"
    assert first(load_generation(store, "daily_dialog"))["source"] == "dialog 0.0</s>"


def test_unanswerable_prompts_lose_the_right_choice(store):
    right = {r["row_id"]: r["target"] for r in load_config(store, "openbookqa_answerable").where("split = 'train'").collect()}
    for row in load_config(store, "openbookqa_unanswerable").where("split = 'train'").collect():
        assert right[row["row_id"]] not in row["source"].split("Choices: ")[1].split(" - ")


def test_caps_and_update(store):
    df = load_config(store, "xsum", caps={"train": 5, "validation": 0, "test": -1}, update=lambda d: perturb.perturb(d, None, "TL;DR "))
    assert sizes(df) == {"train": 5, "test": N - 1}
    assert first(df)["source"] == "TL;DR document 0"
    assert sizes(load_classification(store, "imdb", {"train": 7, "validation": 6, "test": 2})) == {"train": 7, "validation": 6, "test": 2}
    assert sizes(load_generation(store, "coqa", "answerable", caps=3)) == {"train": 3, "test": 3}


def test_unknown_names_and_configurations(store):
    with pytest.raises(ValueError, match="unknown corpus"):
        load_classification(store, "nothing")
    with pytest.raises(ValueError, match="unknown configuration"):
        load_config(store, "nothing")
    with pytest.raises(ValueError, match="answerable or unanswerable"):
        load_generation(store, "sciq", "maybe")
    with pytest.raises(ValueError, match="neither fr-it nor it-fr"):
        load_generation(store, "wmt16", "fr-it")
    assert all(name in GENERATION for name, _ in recipes.GENERATION_CONFIGS.values())


def test_missing_split_raises_unless_it_is_optional(store):
    with pytest.raises(FileNotFoundError, match="validation"):
        corpus.read_corpus(store.spark, store.root, "billsum")
    read = corpus.read_corpus(store.spark, store.root, "billsum", optional=("validation",))
    assert sizes(read) == {"train": N, "test": N}


def test_order_keys_hold_any_row_id_and_step(spark):
    rows = [(2**43 + 5, 2**20 + 7), (2**43 + 5, 3), (2**43 + 6, 0), (2**62, 2**61), (0, 2**40)]
    steps = recipes._steps(spark.createDataFrame(rows, "row_id long, turn long"), "turn")
    assert [(r.row_id, r.turn) for r in steps.orderBy("order_key").collect()] == sorted(rows)
    assert [(r.row_id, r.turn) for r in cap(steps, 3).collect()] and {(r.row_id, r.turn) for r in cap(steps, 3).collect()} == set(sorted(rows)[:3])


def test_ingest_reports_failures(store, tmp_path):
    registry = {"xsum": lambda s: load_config(store, "xsum"), "bad": lambda s: load_generation(store, "bad")}
    report = {r["name"]: r for r in corpus.ingest_all(store.spark, registry, str(tmp_path)).collect()}
    assert report["xsum"]["status"] == "ok" and report["xsum"]["rows"] == 3 * N
    assert report["bad"]["status"] == "failed" and "unknown corpus" in report["bad"]["error"]


def test_records_are_pruned_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("test", "a/b", "x", "x", 1, 0.5), ("test", "a/b", "x", "y", 2, 0.25)], "phase string, model string, dataset_in string, dataset_out string, sample_id long, score double")
    records.write_records(df, str(tmp_path / "r"))
    back = records.read_records(spark, str(tmp_path / "r"), model="a/b", dataset_out="y")
    assert [r["sample_id"] for r in back.collect()] == [2]
    assert "PartitionFilters: [isnotnull(model" in back._jdf.queryExecution().executedPlan().toString()
    assert records.record_name("a/b", "x", "y") == "a_b_x_y.json"


def test_json_has_three_decimals(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345, [0.98765, 2.0])], "sample_id long, score double, tokens array<double>")
    records.write_json(df, str(tmp_path / "j"))
    line = "".join(part.read_text() for part in (tmp_path / "j").glob("part-*.json"))
    assert json.loads(line) == {"sample_id": 1, "score": 0.123, "tokens": [0.988, 2.0]}


def test_merge_prefers_new_columns_and_rows(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "id long, x double, o string")
    new = spark.createDataFrame([(2, None, 7), (3, 3.0, 8)], "id long, x double, n long")
    got = sorted(tuple(r) for r in records.merge_records(old, new, "id").collect())
    assert got == [(1, 1.0, "a", None), (2, None, "b", 7), (3, 3.0, None, 8)]
