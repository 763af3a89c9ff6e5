"""The physical plans the operators are meant to have."""

import pytest
from pyspark.sql import functions as F

from driftlens.functions.text import words
from driftlens.operators import aggregates, dialog, metrics, perturb, splits
from driftlens.operators import detectors as D
from driftlens.operators.splits import Piece
from driftlens.plans.evaluation import evaluate_classification, evaluate_generation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("outputs") / "t")
    columns = [
        F.col("id").alias("sample_id"), F.lit(0).alias("seq_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.when(F.col("id") < 50, "validation").otherwise("test").alias("phase"), F.lit("in").alias("dataset_out"),
        F.array(F.col("id").cast("double"), F.sin("id")).alias("features"), F.array(F.cos("id"), F.sin("id")).alias("logits"),
        F.lit("a b c").alias("hyp"), F.lit("a b d").alias("ref"), F.sin("id").alias("likelihood"),
    ]
    spark.range(200).select(*columns).write.parquet(path)
    return spark.read.parquet(path)


def test_row_local_records_need_no_shuffle(outputs):
    flat = evaluate_classification(outputs.drop("hyp", "ref", "likelihood"), [D.Mahalanobis(), D.MSP(), D.RenyiNeg()], "in")
    assert "Exchange" not in plan(flat)
    assert flat.count() == 200 and len(flat.first()["scores"]) == 1 + 1 + 132
    texts = evaluate_generation(outputs, [D.Energy()], [metrics.sentence_bleu, metrics.rouge_n], "in")
    assert "Exchange" not in plan(texts) and texts.count() == 200


def test_scorers_of_both_kinds_meet_in_one_map(outputs):
    records = evaluate_classification(outputs, [D.MSP(), D.CosineProjection()], "in")
    assert records.count() == 200
    assert all(set(r["scores"]) == {"msp(temperature=1.0,mode=output)", "cosine"} for r in records.collect())


def test_a_recipe_reads_its_source_once(outputs):
    old = outputs.select(F.col("sample_id").alias("row_id"), F.lit("train").alias("split"))
    made = splits.recompose(old, [Piece("train", "train", None, 20, 3), Piece("validation", "train", 10, 40), Piece("test", "train", -5)])
    assert plan(made).count("FileScan") == 1 and "Exchange" not in plan(made)
    assert "PushedFilters: [Or(" in plan(made)
    assert made.count() == 60 + 30 + 5


def test_row_wise_text_work_does_not_shuffle(outputs):
    for df in (
        perturb.perturb(outputs, "hallucination", column="hyp", row_id="sample_id"),
        metrics.sentence_bleu(outputs, tokenizer=words),
        aggregates.token_stats(outputs.select("sample_id", F.col("logits").alias("token_scores"))),
    ):
        assert "Exchange" not in plan(df)


def test_only_needed_columns_are_read(outputs):
    read = plan(D.Energy().transform(outputs)).split("ReadSchema: ")[1]
    assert read.startswith("struct<sample_id:bigint,seq_id:int,logits:array<double>>")


def test_stratified_split_broadcasts_only_counted_cuts(outputs):
    made = splits.split_stratified(outputs.select(F.col("sample_id").alias("row_id"), "label"), "label")
    assert "BroadcastHashJoin" in plan(made) and "Window" not in plan(made) and "Sort" not in plan(made)


def test_dialogs_of_one_block_are_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "dialogs")
    spark.range(60).select((F.col("id") % 7).alias("conv_id"), F.expr("id div 7").alias("turn"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(path)
    turns = spark.read.parquet(path)
    short = dialog.accumulate_dialog(turns)
    assert plan(short).count("Exchange hashpartitioning") == 1 and "Join" not in plan(short)
    long = dialog.accumulate_dialog(turns, block_turns=4)
    assert sorted(short.collect()) == sorted(long.collect()) and short.count() == 60 - 7


def test_corpus_rouge_reads_its_pairs_once(outputs):
    means = metrics.corpus_rouge(outputs)
    assert plan(means).count("FileScan") == 1 and plan(means).count("Exchange hashpartitioning") == 1
    own = [
        metrics.rouge_n(outputs).agg(F.avg("rouge1_fmeasure"), F.avg("rouge2_fmeasure")).first(),
        metrics.rouge_l(outputs).agg(F.avg("rougeL_fmeasure")).first(),
        metrics.rouge_lsum(outputs).agg(F.avg("rougeLsum_fmeasure")).first(),
    ]
    assert list(means.first()) == pytest.approx([x for row in own for x in row])
