"""The pipeline: each stage's decisions against what its operator finds, on the given tables and on awkward rows."""

import re

import pytest

import corpus_pipeline
from driftlens.llm import pii, simhash, tiling, toxicity
from driftlens.llm.common import drop_rows, row_key, table

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage."""
    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
    return seen


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "source_mixing"]
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert stages[-1].columns == [*COLUMNS, "rate", "copies"]


def test_toxic_documents_go(spark, stages):
    told = toxicity.toxicity(stages[0], table(spark, SF, "labels"))
    assert ids(stages[1]) == ids(told.where("predicted = 0"))


def test_one_of_each_group_stays(stages):
    groups = simhash.near_duplicates(stages[1]).select("component_id").distinct()
    assert ids(stages[2]) == sorted(r.component_id for r in groups.collect())
    texts = [r.text for r in stages[2].select("text").collect()]
    assert len(texts) == len(set(texts))


def test_benchmark_passages_go(spark, stages):
    items = [" ".join(tiling.words_of(r.text)) for r in table(spark, SF, "benchmark").collect()]
    held = {r.doc_id for r in stages[2].collect() if any(i in " ".join(tiling.words_of(r.text)) for i in items)}
    gone = set(ids(stages[2])) - set(ids(stages[3]))
    assert held and held <= gone and len(gone) < 1.2 * len(held) + 2


def test_personal_data_goes_and_other_texts_stay(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "phone": r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}"}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not any(re.search(p, r.text) for p in plain.values()) and r.n_chars == len(r.text) or r.text == before[i]
    found = {r.doc_id for r in pii.spans_of(stages[3]).where("spans <> ''").collect()}
    assert {i for i, r in after.items() if r.text != before[i]} == found


def test_rates(stages):
    rows = stages[5].collect()
    assert all(r.rate > 0 and abs(r.copies - r.rate) < 1 for r in rows) and len(rows) == stages[4].count()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "copies").collect())) == sorted(
        map(tuple, stages[5].select("doc_id", "copies").collect())
    )
    assert corpus_pipeline.ORACLE_SQL is None


def test_awkward_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, None, None), (2, "word " * 30_000, "en", "s", 1), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, SF)
        assert some.columns == [*COLUMNS, "rate", "copies"]
        assert some.count() <= len(rows)


def test_drop_rows_tells_equal_ids_apart(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (None, "c", 0), (None, "d", 0)], "doc_id long, text string, key int")
    keys = docs.where("text IN ('b', 'c')").select("doc_id", row_key().alias("key"))
    assert sorted(r.text for r in drop_rows(docs, keys).collect()) == ["a", "d"]
