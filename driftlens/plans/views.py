"""The given tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions.hashing import hash_hex
from driftlens.functions.text import words
from driftlens.functions.vectors import dot
from driftlens.session import spread
from driftlens.sources.corpus import read_saved

CHOICE_LABELS = ("A", "B", "C", "D", "E")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_saved(spark, f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")


def texts(spark, sf_dir) -> DataFrame:
    """Documents for work that costs much per character."""
    return spread(documents(spark, sf_dir))


def labelled(spark, sf_dir) -> DataFrame:
    """Labelled text: row_id, lang, text, label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"), "lang", "text", F.col("quality").alias("label")
    )


def pairs(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("row_id", F.col("source").alias("sentence1"), F.col("text").alias("sentence2"))


def categories(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("props").alias("review_body"), F.col("event_type").alias("product_category")
    )


def dialogs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def dialog_arrays(spark, sf_dir) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return (
        dialogs(spark, sf_dir).groupBy(F.col("conv_id").alias("row_id")).agg(turns.alias("t"))
        .select("row_id", F.transform("t", lambda s: s["text"]).alias("dialog"))
    )


def translations(spark, sf_dir) -> DataFrame:
    """A turn and the turn after it as a two-language map."""
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return (
        table(spark, sf_dir, "conversations").withColumn("nxt", after)
        .where(F.col("nxt").isNotNull())
        .select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"),
            F.create_map(F.lit("aa"), F.col("text"), F.lit("bb"), F.col("nxt")).alias("translation"),
        )
    )


def oriented(spark, sf_dir) -> DataFrame:
    """The same as two string columns with a language tag; even conversations are the test split."""
    return translations(spark, sf_dir).select(
        "row_id",
        F.when(F.floor(F.col("row_id") / 100) % 2 == 0, "test").otherwise("validation").alias("split"),
        F.lit("aa").alias("sourceLang"),
        F.col("translation")["aa"].alias("sourceString"),
        F.col("translation")["bb"].alias("targetString"),
    )


def choices(spark, sf_dir) -> DataFrame:
    """Multiple choice: the market segments, one of them right; every fifth customer is test."""
    customer = table(spark, sf_dir, "customer")
    segments = customer.agg(F.array_sort(F.collect_set("c_mktsegment"))).scalar()
    labels = F.array(*[F.lit(x) for x in CHOICE_LABELS])
    tagged = customer.withColumn("t", segments)
    return tagged.select(
        F.col("c_custkey").alias("row_id"),
        F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"),
        F.col("c_name").alias("question"),
        F.struct(F.col("t").alias("text"), labels.alias("label")).alias("choices"),
        F.element_at(labels, F.array_position("t", F.col("c_mktsegment")).cast("int")).alias("answerKey"),
    )


def extractive(spark, sf_dir) -> DataFrame:
    """Documents with a label have an answer, the others an empty answer list."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled_id"))
    known = F.col("labelled_id").isNotNull()
    first = F.substring_index("text", ".", 1)
    return docs.join(labels, docs["doc_id"] == F.col("labelled_id"), "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("context"),
        F.col("source").alias("question"),
        F.struct(
            F.when(known, F.array(first)).otherwise(F.array().cast("array<string>")).alias("text"),
            F.when(known, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("answer_start"),
        ).alias("answers"),
    )


def tsv_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.concat(F.lit("1"), "c_name", F.lit("\t"), "c_mktsegment").alias("text")
    )


def features(spark, sf_dir) -> DataFrame:
    """Detector input: labels 8 and 9 are out of distribution, even ids of the others the reference."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        "label",
        (F.col("label") >= 8).alias("is_ood"),
        ((F.col("label") < 8) & (F.col("vec_id") % 2 == 0)).alias("is_ref"),
    )


def logits(spark, sf_dir) -> DataFrame:
    """One logit per in-distribution class: dot product with the class mean of the reference part."""
    rows = features(spark, sf_dir)
    means = (
        rows.where("is_ref").select("label", F.posexplode("features").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg("v").alias("c"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    )
    centres = means.agg(F.array_sort(F.collect_list(F.struct("label", "c")))).scalar()
    return rows.withColumn("_centres", centres).select(
        "sample_id", "label", "is_ood", "is_ref",
        F.transform("_centres", lambda k: dot(F.col("features"), k["c"])).alias("logits"),
    )


def beams(spark, sf_dir) -> DataFrame:
    """Logit rows as four returned sequences per sample."""
    return logits(spark, sf_dir).select(
        F.floor(F.col("sample_id") / 4).alias("sample_id"),
        (F.col("sample_id") % 4).cast("int").alias("seq_id"),
        "label", "is_ood", "is_ref", "logits",
        F.array_max("logits").alias("likelihood"),
    )


def hypotheses(spark, sf_dir) -> DataFrame:
    """Four candidate texts per turn, words dropped by a seeded hash."""
    turns = spread(table(spark, sf_dir, "conversations"))
    split = F.split("text", r"\s+")
    kept = F.filter(
        split, lambda w, i: F.substring(hash_hex(F.col("seq_id"), F.col("conv_id"), F.col("turn"), i), 1, 8) >= "33333333"
    )
    return turns.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq_id")).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), "seq_id", F.col("text").alias("ref"),
        F.array_join(kept, " ").alias("hyp"),
    )


def token_scores(spark, sf_dir) -> DataFrame:
    """One number per token, two sequences per document."""
    sizes = F.transform(F.split("text", r"\s+"), F.length)
    docs = texts(spark, sf_dir).select(F.col("row_id").alias("sample_id"), "lang", sizes.alias("_sizes"))
    return docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("seq_id")).select(
        "sample_id", "seq_id", "lang",
        F.transform("_sizes", lambda n: (n + F.col("seq_id")).cast("double") / 10).alias("token_scores"),
    )


def token_vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as token vectors: ten per pair, even ones the hypothesis, odd ones the reference."""
    return features(spark, sf_dir).select(
        F.floor(F.col("sample_id") / 10).alias("pair_id"),
        F.when(F.col("sample_id") % 2 == 0, "hyp").otherwise("ref").alias("side"),
        F.floor(F.col("sample_id") % 10 / 2).alias("pos"),
        F.col("features").alias("vector"),
    )
