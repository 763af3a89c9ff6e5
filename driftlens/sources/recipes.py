"""Every corpus as a reader, split pieces and an adapter.

Stored corpora have a unique ``row_id`` in file order. Recipes return frames with row_id, split and
either text/label columns or source/target; ``part`` and ``order_key`` carry the order of rebuilt splits.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import adapters as A
from driftlens.operators.dialog import accumulate_dialog_array
from driftlens.operators.filters import answerable
from driftlens.operators.negatives import answer_pool, random_negative, replace_answer
from driftlens.operators.prompts import QUARTZ_SEPARATOR, TEMPLATES, choice_list, prompt
from driftlens.operators.splits import (
    Piece,
    cap,
    holdout,
    prefix_holdout,
    recompose,
    split_fraction,
    split_stratified,
    union_all,
)
from driftlens.sources.corpus import read_corpus, read_pair, read_pair_corpus

SEED = 42

# The text fields of the corpora that don't have one field "text", and the language taken of the reviews.
TEXT_FIELDS: dict[str, tuple[str, str | None]] = {
    "amazon_reviews_multi": ("review_body", None),
    "20ng": ("text_scr", None),
    "trec": ("text_scr", None),
    "mnli": ("premise", "hypothesis"),
    "snli": ("premise", "hypothesis"),
    "rte": ("sentence1", "sentence2"),
    "trec_fine": ("text_scr", None),
}
AMAZON_LANGUAGE = "en"

# Argument-mining labels, news groups in label order, languages of the tweet corpus.
ARGUMENT_LABELS = {"conclusion": 0, "definition": 1, "subsumption": 2, "other": 3}
NEWS_GROUPS = (
    "18828_alt.atheism",
    "18828_comp.graphics",
    "18828_comp.os.ms-windows.misc",
    "18828_comp.sys.ibm.pc.hardware",
    "18828_comp.sys.mac.hardware",
    "18828_comp.windows.x",
    "18828_misc.forsale",
    "18828_rec.autos",
    "18828_rec.motorcycles",
    "18828_rec.sport.baseball",
    "18828_rec.sport.hockey",
    "18828_sci.crypt",
    "18828_sci.electronics",
    "18828_sci.med",
    "18828_sci.space",
    "18828_soc.religion.christian",
    "18828_talk.politics.guns",
    "18828_talk.politics.mideast",
    "18828_talk.politics.misc",
    "18828_talk.religion.misc",
)
TWEET_LANGUAGES = {"en": "english", "es": "spanish", "fr": "french", "de": "german"}

# Generation configurations as (corpus, corpus configuration).
_TATOEBA = ("deu", "por", "spa", "cat", "fra", "afr", "ita", "est", "epo", "heb", "grc", "eus", "rus", "pol", "nld", "kor", "ukr", "urd")
_EMEA = {"spa": "es", "por": "pt", "nld": "nl", "fra": "fr", "ita": "it", "deu": "de"}
GENERATION_CONFIGS: dict[str, tuple[str, str]] = {
    "wmt16_de_en": ("wmt16", "de-en"),
    "news_commentary_de_en": ("news_commentary", "de-en"),
    **{f"tatoeba_mt_{lang}_eng": ("tatoeba_mt", f"{lang}-eng") for lang in _TATOEBA},
    **{f"emea_{lang}_eng": ("emea", f"{code}-en") for lang, code in _EMEA.items()},
    "europarl_spa_eng": ("europarl_bilingual", "es-en"),
    "europarl_deu_eng": ("europarl_bilingual", "de-en"),
    "openbookqa_answerable": ("openbookqa", "answerable"),
    "openbookqa_unanswerable": ("openbookqa", "unanswerable"),
    "ai2arcchallenge_answerable": ("ai2_arc", "answerable_ARC-Challenge"),
    "ai2arceasy_answerable": ("ai2_arc", "answerable_ARC-Easy"),
    "ai2arcchallenge_unanswerable": ("ai2_arc", "unanswerable_ARC-Challenge"),
    "ai2arceasy_unanswerable": ("ai2_arc", "unanswerable_ARC-Easy"),
    "sciq_answerable": ("sciq", "answerable"),
    "sciq_unanswerable": ("sciq", "unanswerable"),
    "tweetqa_answerable": ("tweetqa", "answerable"),
    "tweetqa_unanswerable": ("tweetqa", "unanswerable"),
    "triviaqa_answerable": ("trivia_qa", "open_book_answerable"),
    "triviaqa_closedbook": ("trivia_qa", "closed_book"),
    "coqa_answerable": ("coqa", "answerable"),
    "quartz_answerable": ("quartz", "answerable"),
    "quartz_unanswerable": ("quartz", "unanswerable"),
    "squad_v2_answerable": ("squad_v2", "answerable"),
    "squad_v2_unanswerable": ("squad_v2", "unanswerable"),
    "natural_instructions": ("natural_instructions", ""),
    "cuad_answerable": ("cuad", "answerable"),
    "cuad_unanswerable": ("cuad", "unanswerable"),
    "cnn_dailymail": ("cnn_dailymail", "3.0.0"),
    "xsum": ("xsum", ""),
    "billsum": ("billsum", ""),
    "multi_news": ("multi_news", ""),
}

# Split recipes.
NATIVE = [Piece("train", "train"), Piece("validation", "validation"), Piece("test", "test")]
MORE_VALIDATION = [
    Piece("train", "train"), Piece("validation", "validation"), Piece("validation", "train", None, 2000), Piece("test", "test"),
]
RECIPES: dict[str, list[Piece]] = {
    "muchocine": [Piece("train", "train", None, 2000, 3), Piece("validation", "train", 1000, 2500), Piece("test", "train", 2500)],
    "book_reviews": [Piece("train", "train", None, 5000), Piece("validation", "train", 4000, 7000), Piece("test", "train", 7000)],
    "flue_xnli": [
        Piece("train", "train", None, 50000), Piece("validation", "validation"), Piece("validation", "test", 50000, 52000), Piece("test", "test"),
    ],
    "flue_pawsx": [
        Piece("train", "train", None, 30000), Piece("validation", "validation"), Piece("validation", "test", 30000, 32000), Piece("test", "test"),
    ],
    "flue_cls": [
        Piece("train", "train"), Piece("validation", "test", None, 2000), Piece("validation", "train", None, 2000), Piece("test", "test", None, 2000),
    ],
    "b77": [Piece("train", "train"), Piece("validation", "test"), Piece("test", "test")],
    "twitterfin": [Piece("train", "train", None, 6000), Piece("validation", "train", 6000), Piece("test", "validation")],
    "mnli": [
        Piece("train", "train"), Piece("validation", "validation"), Piece("test", "test_matched"), Piece("test", "test_mismatched"),
    ],
    "allocine": [Piece("train", "train", None, 50000), Piece("validation", "validation", None, 5000), Piece("test", "test", None, 20000)],
    "train_twice": [Piece("train", "train"), Piece("validation", "train"), Piece("test", "test")],
    "go_emotions": [
        Piece("train", "train"), Piece("validation", "train"), Piece("validation", "train", None, 5000), Piece("test", "test"),
    ],
    "billsum": [Piece("train", "train", None, 10000), Piece("validation", "train", 10000), Piece("test", "test")],
    "web_questions": [Piece("train", "train"), Piece("validation", "train", None, 1000), Piece("test", "test")],
    "coqa": [Piece("train", "train", None, 3000), Piece("validation", "train", 3000), Piece("test", "validation")],
    "squad_v2": [
        Piece("train", "train", None, -5000), Piece("validation", "validation", None, 3000), Piece("validation", "train", -5000), Piece("test", "validation", 3000),
    ],
    "cuad": [
        Piece("train", "train", None, -1500), Piece("validation", "validation", None, 1500), Piece("validation", "train", -1500), Piece("test", "validation", 1500),
    ],
}


class Store:
    """Where corpora lie: reads, seed and end-of-turn text shared by the recipes."""

    def __init__(self, spark: SparkSession, root: str, seed: int = SEED, eos: str = "</s>"):
        self.spark, self.root, self.seed, self.eos = spark, root, seed, eos

    def read(self, name: str, config: str | None = None, splits: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
        return read_corpus(self.spark, self.root, name, config, splits)


def _split(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


# --- labelled text -------------------------------------------------------------------------------


def _language(name: str) -> str:
    return name.split("_")[0]


def _with_test(raw: DataFrame, train: DataFrame) -> DataFrame:
    """A rebuilt train/validation next to the published test split, which keeps its order."""
    test = _split(raw, "test").withColumn("order_key", F.col("row_id"))
    return train.unionByName(test)


def _trec(label: str) -> Callable[[Store, str], DataFrame]:
    def load(store: Store, name: str) -> DataFrame:
        raw = A.rename_fields(store.read("trec", splits=("train", "test")), text_scr="text", label=label)
        return _with_test(raw, holdout(_split(raw, "train"), 0.1, store.seed, order_key=True))

    return load


def _yelp(store: Store, name: str) -> DataFrame:
    raw = A.rename_fields(store.read("yelp_polarity", splits=("train", "test")), text="text", label="label")
    return _with_test(raw, prefix_holdout(_split(raw, "train"), 10, 0.1, store.seed, order_key=True))


def _imdb(store: Store, name: str) -> DataFrame:
    raw = A.rename_fields(store.read("imdb", splits=("train", "test", "unsupervised")), text="text", label="label")
    held = _with_test(raw, holdout(_split(raw, "train"), 0.1, store.seed, order_key=True))
    more = recompose(raw, [Piece("validation", "unsupervised", None, 8000)])
    return held.withColumn("part", F.lit(0)).unionByName(
        more.withColumns({"part": F.lit(1), "order_key": F.col("row_id")})
    )


def _news_groups(store: Store, name: str) -> DataFrame:
    subsets = [store.read("newsgroup", subset, ("train",)) for subset in NEWS_GROUPS]
    rows = A.label_by_subset([A.rename_fields(s, text_scr="text") for s in subsets])
    # Row ids are unique per subset; with the label in front they are unique over the union.
    unique = rows.withColumn("row_id", _pair_key(F.col("label"), F.col("row_id")))
    return split_stratified(unique, "label", (0.8, 0.1), store.seed, order_key=True)


def _amazon_labels(store: Store, name: str) -> DataFrame:
    raw = store.read("amazon_reviews_multi", AMAZON_LANGUAGE, ("train", "test"))
    codes = A.label_codes(_split(raw, "train"), "product_category")
    coded = A.lookup_labels(raw.select("row_id", "split", "review_body", "product_category"), codes, "product_category")
    return recompose(coded, RECIPES["train_twice"])


def _simple(
    corpus: str,
    recipe: list[Piece] = NATIVE,
    config: Callable[[str], str | None] = lambda name: None,
    adapt: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Callable[[Store, str], DataFrame]:
    def load(store: Store, name: str) -> DataFrame:
        raw = store.read(corpus, config(name), tuple(dict.fromkeys(p.source for p in recipe)))
        shaped = adapt(raw)
        return shaped if recipe is NATIVE else recompose(shaped, recipe)

    return load


def _joined(first: str, second: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: A.concat_fields(df, first, second)


def _renamed(**names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: A.rename_fields(df, **names)


CLASSIFICATION: dict[str, Callable[[Store, str], DataFrame]] = {
    "mnli": _simple("glue", RECIPES["mnli"], lambda n: "mnli"),
    "rte": _simple("glue", MORE_VALIDATION, lambda n: "rte"),
    "glue_sst2": _simple("glue", MORE_VALIDATION, lambda n: "sst2"),
    "snli": _simple("snli"),
    "tweet_eval": _simple("tweet_eval", RECIPES["train_twice"], lambda n: "emoji"),
    "amazon_reviews_multi": _amazon_labels,
    "go_emotions": _simple(
        "go_emotions", RECIPES["go_emotions"], lambda n: "simplified", lambda df: A.first_elem(df, "labels", "label")
    ),
    "sst2": _simple("glue", config=lambda n: "sst2", adapt=_renamed(text="sentence", label="label")),
    "20ng": _news_groups,
    "trec": _trec("label-coarse"),
    "trec_fine": _trec("label-fine"),
    "imdb": _imdb,
    "yelp": _yelp,
    "b77": _simple("banking77", RECIPES["b77"]),
    "massive": _simple("massive", config=lambda n: "en-US", adapt=_renamed(text="utt", label="intent")),
    "emotion": _simple("emotion"),
    "twitterfin": _simple("twitter_financial_news_sentiment", RECIPES["twitterfin"]),
    "fr_xnli": _simple("flue", RECIPES["flue_xnli"], lambda n: "XNLI", _joined("premise", "hypo")),
    "fr_pawsx": _simple("flue", RECIPES["flue_pawsx"], lambda n: "PAWS-X", _joined("sentence1", "sentence2")),
    "fr_cls": _simple("flue", RECIPES["flue_cls"], lambda n: "CLS"),
    "fr_book_reviews": _simple(
        "french_book_reviews", RECIPES["book_reviews"],
        adapt=lambda df: A.rename_fields(A.shift_label(df, "label", 1), text="reader_review", label="label"),
    ),
    "fr_allocine": _simple("allocine", RECIPES["allocine"], adapt=_renamed(text="review", label="label")),
    "de_lexarg": _simple(
        "german_argument_mining", MORE_VALIDATION,
        adapt=lambda df: A.map_labels(A.rename_fields(df, text="input_sentence", label="label"), ARGUMENT_LABELS),
    ),
    "es_tweet_inde": _simple("catalonia_independence", config=lambda n: "spanish", adapt=_renamed(text="TWEET", label="LABEL")),
    "es_cine": _simple(
        "muchocine", RECIPES["muchocine"],
        adapt=lambda df: A.rename_fields(A.shift_label(df, "star_rating"), text="review_summary", label="label"),
    ),
    "es_sst2": _simple("sst2-es-mt", adapt=_renamed(text="sentence_es", label="label")),
    **{
        f"{lang}_xstance": _simple("x-stance", MORE_VALIDATION, _language, _joined("question", "comment"))
        for lang in ("fr", "es", "de")
    },
    **{f"{lang}_swiss_judgement": _simple("swiss_judgment_prediction", config=_language) for lang in ("fr", "de")},
    **{
        f"{lang}_tweet_sentiment": _simple(
            "tweet_sentiment_multilingual", config=lambda n: TWEET_LANGUAGES[_language(n)]
        )
        for lang in ("fr", "es", "de")
    },
    **{
        f"{lang}_pawsx": _simple("paws-x", config=_language, adapt=_joined("sentence1", "sentence2"))
        for lang in ("es", "de")
    },
}


def load_classification(
    store: Store, name: str, caps: int | None | Mapping[str, int | None] = None, keys: tuple[str, str | None] | None = None
) -> DataFrame:
    """{row_id, split, text, labels} of a named corpus, capped per split."""
    if name not in CLASSIFICATION:
        raise ValueError(f"unknown corpus {name}; known: {sorted(CLASSIFICATION)}")
    first, second = keys or TEXT_FIELDS.get(name, ("text", None))
    shaped = A.to_classification(CLASSIFICATION[name](store, name), first, second)
    return shaped if caps is None else cap(shaped, caps)


# --- source/target pairs -------------------------------------------------------------------------


def _pair_key(first: Column, second: Column) -> Column:
    """One number in the order of two non-negative longs, whatever their size: both fit a 38-digit decimal side by side."""
    return first.cast("decimal(38,0)") * F.lit(2**62).cast("decimal(19,0)") + second.cast("decimal(19,0)")


def _steps(df: DataFrame, step: str) -> DataFrame:
    """Several rows per stored row: their order is (row_id, step)."""
    return df.withColumn("order_key", _pair_key(F.col("row_id"), F.col(step)))


def _is_answerable(config: str, name: str) -> bool:
    if config not in ("answerable", "unanswerable"):
        raise ValueError(f"invalid configuration for {name}: {config}, should be answerable or unanswerable")
    return config == "answerable"


def _daily_dialog(store: Store, config: str) -> DataFrame:
    return _steps(accumulate_dialog_array(store.read("daily_dialog"), "dialog", store.eos), "turn")


def _multi_woz(store: Store, config: str) -> DataFrame:
    return _steps(accumulate_dialog_array(store.read("multi_woz_v22", config or None), "turns.utterance", store.eos), "turn")


def _pairs_of(corpus: str) -> Callable[[Store, str], DataFrame]:
    return lambda store, config: read_pair(store.spark, store.root, corpus, config)


def _fractions(corpus: str, fractions: Sequence[float]) -> Callable[[Store, str], DataFrame]:
    def load(store: Store, config: str) -> DataFrame:
        rows = read_pair(store.spark, store.root, corpus, config, ("train",))
        return split_fraction(rows, fractions, ("train", "validation", "test"))

    return load


def _tatoeba(store: Store, config: str) -> DataFrame:
    raw = read_pair_corpus(store.spark, store.root, "tatoeba_mt", config, ("validation", "test"))
    pairs = A.orient_pair(raw, config.split("-")[0])
    rebuilt = split_fraction(_split(pairs, "validation"), [0.8], ("train", "validation"))
    return union_all(rebuilt, _split(pairs, "test"))


def _fields(corpus: str, source: str | Column, target: str | Column, recipe: list[Piece] = NATIVE) -> Callable[[Store, str], DataFrame]:
    def load(store: Store, config: str) -> DataFrame:
        raw = store.read(corpus, config or None, tuple(dict.fromkeys(p.source for p in recipe)))
        shaped = A.to_generation(raw, source, target)
        return shaped if recipe is NATIVE else recompose(shaped, recipe)

    return load


def _web_questions(store: Store, config: str) -> DataFrame:
    raw = A.first_elem(store.read("web_questions", splits=("train", "test")), "answers", "answer")
    return recompose(A.to_generation(raw, "question", "answer"), RECIPES["web_questions"])


def _multiple_choice(
    corpus: str, config: str | None, kind: str, store: Store, question: str | None, context: str | None, separator: str | None = None
) -> DataFrame:
    raw = store.read(corpus, config)
    if _is_answerable(kind, corpus):
        target = A.answer_of()
    else:
        good = raw.withColumn("_good", A.answer_of())
        raw = random_negative(good, answer_pool(raw, "choices.text"), "_good", store.seed)
        raw = raw.withColumn("choices", replace_answer("choices", "answerKey", "negative"))
        target = F.lit(A.NO_ANSWER)
    offered = choice_list(F.col("choices.text"), separator) if separator else choice_list(F.col("choices.text"))
    source = prompt(
        TEMPLATES[corpus],
        context=F.col(context) if context else F.lit(""),
        question=F.col(question) if question else offered,
        choices=offered,
    )
    return A.to_generation(raw, source, target)


def _openbookqa(store: Store, config: str) -> DataFrame:
    return _multiple_choice("openbookqa", "additional", config, store, "question_stem", "fact1")


def _ai2_arc(store: Store, config: str) -> DataFrame:
    kind, subset = config.split("_")
    return _multiple_choice("ai2_arc", subset, kind, store, "question", None)


def _quartz(store: Store, config: str) -> DataFrame:
    # The choices stand in the question's place.
    return _multiple_choice("quartz", None, config, store, None, "para", QUARTZ_SEPARATOR)


def _sciq(store: Store, config: str) -> DataFrame:
    raw = store.read("sciq")
    names = ["distractor1", "distractor2", "distractor3", "correct_answer"]
    target: Column = F.col("correct_answer")
    if not _is_answerable(config, "sciq"):
        pool = answer_pool(raw, F.array(*names))
        raw = random_negative(raw, pool, "correct_answer", store.seed).withColumn("correct_answer", F.col("negative"))
        target = F.lit(A.NO_ANSWER)
    offered = choice_list(A.shuffled(F.array(*names), F.col("row_id"), store.seed))
    source = prompt(TEMPLATES["sciq"], context=F.col("support"), question=F.col("question"), choices=offered)
    return A.to_generation(raw, source, target)


def _trivia_qa(store: Store, config: str) -> DataFrame:
    if config == "closed_book":
        return A.to_generation(store.read("trivia_qa", "rc.nocontext"), "question", F.col("answer.value"))
    if config != "open_book_answerable":
        raise ValueError(f"invalid configuration for trivia_qa: {config}")
    context = A.flatten_newlines(F.element_at("search_results.search_context", 1))
    source = prompt(TEMPLATES["trivia_qa"], context=context, question=F.col("question"))
    return A.to_generation(store.read("trivia_qa", "rc"), source, F.col("answer.value"))


def _coqa(store: Store, config: str) -> DataFrame:
    if config != "answerable":
        raise ValueError(f"invalid configuration for coqa: {config}")
    asked = A.zip_explode(store.read("coqa", splits=("train", "validation")), "questions", "answers.input_text", ("question", "answer"))
    source = prompt(TEMPLATES["coqa"], context=F.col("story"), question=F.col("question"))
    return recompose(A.to_generation(_steps(asked, "pos"), source, "answer"), RECIPES["coqa"], key="order_key")


def _tweetqa(store: Store, config: str) -> DataFrame:
    raw = store.read("tweetqa")
    source = prompt(TEMPLATES["tweetqa"], context=F.col("Tweet"), question=F.col("Question"))
    # The prompt never shows the answer, so an exchanged answer changes the target only.
    target = F.element_at("Answer", 1) if _is_answerable(config, "tweetqa") else F.lit(A.NO_ANSWER)
    return A.to_generation(raw, source, target)


def _natural_instructions(store: Store, config: str) -> DataFrame:
    source = prompt(TEMPLATES["natural_instructions"], context=F.col("definition"), question=F.col("inputs"))
    return A.to_generation(store.read("natural_instructions"), source, "targets")


def _extractive(corpus: str) -> Callable[[Store, str], DataFrame]:
    def load(store: Store, config: str) -> DataFrame:
        keep = _is_answerable(config, corpus)
        raw = store.read(corpus, splits=("train", "validation"))
        if corpus == "squad_v2":
            raw = answerable(raw, keep)
        source = prompt(TEMPLATES[corpus], context=F.col("context"), question=F.col("question"))
        target = F.element_at("answers.text", 1) if keep else F.lit(A.NO_ANSWER)
        return recompose(A.to_generation(raw, source, target), RECIPES[corpus])

    return load


def _titles(store: Store, config: str) -> DataFrame:
    return A.const_target(store.read("amazon_reviews_multi", config or None), "review_title", None)


GENERATION: dict[str, Callable[[Store, str], DataFrame]] = {
    "daily_dialog": _daily_dialog,
    "multi_woz_v22": _multi_woz,
    "silicone": lambda store, config: A.const_target(store.read("silicone", config), "Utterance", "a"),
    "movieqa": lambda store, config: A.parse_tsv_qa(store.read("wiki_movies")),
    "wmt16": _pairs_of("wmt16"),
    "tatoeba_mt": _tatoeba,
    "news_commentary": _fractions("news_commentary", [0.8, 0.1]),
    "emea": _fractions("emea", [0.8, 0.1]),
    "europarl_bilingual": _fractions("europarl_bilingual", [0.7, 0.2]),
    "amazon_reviews_multi": _titles,
    "web_questions": _web_questions,
    "openbookqa": _openbookqa,
    "ai2_arc": _ai2_arc,
    "sciq": _sciq,
    "trivia_qa": _trivia_qa,
    "coqa": _coqa,
    "tweetqa": _tweetqa,
    "natural_instructions": _natural_instructions,
    "quartz": _quartz,
    "squad_v2": _extractive("squad_v2"),
    "cuad": _extractive("cuad"),
    "cnn_dailymail": _fields("cnn_dailymail", "article", "highlights"),
    "xsum": _fields("xsum", "document", "summary"),
    "billsum": _fields("billsum", "text", "summary", RECIPES["billsum"]),
    "multi_news": _fields("multi_news", "document", "summary"),
}


def load_generation(
    store: Store,
    name: str,
    config: str = "",
    caps: int | None | Mapping[str, int | None] = None,
    update: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """{row_id, split, source, target} of a corpus, capped per split, then rewritten by ``update``."""
    if name not in GENERATION:
        raise ValueError(f"unknown corpus {name}; known: {sorted(GENERATION)}")
    shaped = GENERATION[name](store, config)
    capped = shaped if caps is None else cap(shaped, caps)
    return capped.transform(update) if update else capped


def load_config(store: Store, config_name: str, **options) -> DataFrame:
    """A generation corpus by its configuration name."""
    if config_name not in GENERATION_CONFIGS:
        raise ValueError(f"unknown configuration {config_name}; known: {sorted(GENERATION_CONFIGS)}")
    return load_generation(store, *GENERATION_CONFIGS[config_name], **options)
