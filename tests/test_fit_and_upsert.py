"""Fits from parts, saved detectors, and merges into bucketed records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import detectors as D
from driftlens.sources.bucketed import BucketedRecords
from driftlens.streaming import upsert_stream


@pytest.fixture(scope="module")
def outputs(spark):
    rng = np.random.default_rng(0)
    rows = [
        (i, s, int(i % 3) if i % 7 else None, (rng.normal(size=4) + i % 3).tolist(), rng.normal(size=4).tolist(), rng.normal(size=(3, 4)).tolist(),
         rng.normal(size=6).tolist(), float(rng.normal()))
        for i in range(60) for s in range(2)
    ]
    schema = "sample_id long, seq_id int, label int, features array<double>, logits array<double>, token_logits array<array<double>>, token_scores array<double>, likelihood double"
    return spark.createDataFrame(rows, schema).cache()


def scores(df):
    return {(r["sample_id"], r["seq_id"], r["detector"]): r["score"] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys() and len(a) > 0
    assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(b)], atol=1e-9, equal_nan=True)


SCORERS = [
    D.MSP(temperature=2.0), D.Energy(), D.FisherRao((1.0, 2.0)), D.RenyiNeg((1.0,), (0.5, 2.0)), D.RenyiDataFitted((1.0, 0.5), (0.5, 1.0), mode="token"),
    D.Mahalanobis(), D.Mahalanobis(label=None), D.CosineProjection(small_bytes=10**6), D.DataDepth(5), D.InformationProjection(n_neighbors=3),
    D.BeamRenyiProjection((1.0,), (0.5,), (1,)), D.FunctionalIsolationForest(n_trees=4), D.BestBeam(D.Mahalanobis()),
]


@pytest.mark.parametrize("scorer", SCORERS, ids=lambda s: type(s).__name__)
def test_a_saved_detector_scores_alike(spark, outputs, tmp_path, scorer):
    fitted = scorer.fit(outputs.where("sample_id < 40 AND seq_id = 0"))
    D.save_scorer(spark, fitted, str(tmp_path / "d"))
    D.save_scorer(spark, fitted, str(tmp_path / "d"))
    loaded = D.load_scorer(spark, str(tmp_path / "d"))
    assert type(loaded) is type(fitted) and loaded.score_names == fitted.score_names
    close(scores(fitted.transform(outputs)), scores(loaded.transform(outputs)))


@pytest.mark.parametrize("scorer", [D.Mahalanobis(), D.RenyiDataFitted((1.0, 0.5), (0.5,)), D.CosineProjection()], ids=lambda s: type(s).__name__)
def test_accumulated_parts_fit_as_the_whole(spark, outputs, tmp_path, scorer):
    reference = outputs.where("seq_id = 0")
    for batch in (0, 1, 2, 3, 1):
        scorer.accumulate(reference.where(F.col("sample_id") % 4 == batch), str(tmp_path / "parts"), batch)
    parts = scores(scorer.fit_accumulated(spark, str(tmp_path / "parts")).transform(outputs))
    close(parts, scores(scorer.fit(reference).transform(outputs)))


def test_gaussian_parts_with_distant_means_and_classes_of_their_own(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, "ab"[i % 2] if i < 30 else "c", (rng.normal(size=3) + 1e4 * (i // 10)).tolist()) for i in range(50)]
    df = spark.createDataFrame(data, "sample_id long, label string, features array<double>")
    for batch in range(5):
        D.accumulate_gaussian(df.where(F.expr(f"sample_id div 10 = {batch}")), str(tmp_path), batch)
    D.accumulate_gaussian(df.limit(0), str(tmp_path), 9)
    one, two = D.fit_gaussian(df), D.merge_gaussian(spark, str(tmp_path))
    assert one.labels == two.labels and np.allclose(one.counts, two.counts) and np.allclose(one.means, two.means)
    assert np.allclose(one.covariance, two.covariance, rtol=1e-10)


def records(spark, rows, schema="id long, score double, lang string"):
    return spark.createDataFrame(rows, schema)


def told(table):
    return sorted(map(tuple, table.read().select("id", "score", "lang").collect()), key=str)


def test_merges_touch_only_their_buckets(spark, tmp_path):
    table = BucketedRecords(spark, str(tmp_path / "r"), buckets=8)
    assert table.read() is None
    assert table.merge(records(spark, [(i, float(i), "en") for i in range(200)]), ["id"])
    before = table.current()
    assert len(before) == 8
    assert table.merge(records(spark, [(5, -1.0), (5, -2.0)], "id int, score double"), ["id"])
    changed = [b for b, batch in table.current().items() if batch != before[b]]
    assert len(changed) == 1
    assert len(table.read(changed).inputFiles()) < len(table.read().inputFiles())
    assert told(table) == sorted([(i, float(i) if i != 5 else -1.0, "en") for i in range(200)], key=str)
    assert len(table.read().select("id").distinct().collect()) == 200


def test_a_merge_that_was_cut_off_leaves_no_trace_and_a_repeated_one_is_done_once(spark, tmp_path, monkeypatch):
    table = BucketedRecords(spark, str(tmp_path / "r"), buckets=4)
    table.merge(records(spark, [(1, 1.0, "en"), (2, 2.0, None)]), ["id"], 0)
    new = records(spark, [(1, 9.0, "fr"), (3, 3.0, "de")])
    monkeypatch.setattr(table.spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(new, ["id"], 1)
    monkeypatch.undo()
    assert told(table) == [(1, 1.0, "en"), (2, 2.0, None)]
    for expected in (True, False):
        assert table.merge(new, ["id"], 1) is expected
        assert told(table) == [(1, 9.0, "fr"), (2, 2.0, None), (3, 3.0, "de")]
    with pytest.raises(ValueError):
        table.merge(records(spark, [(4, 1.0, "en")]), ["id"], -1)
    assert table.merge(new.limit(0), ["id"], 2) and len(told(table)) == 3


def test_null_keys_and_rows_of_keys_alone(spark, tmp_path):
    table = BucketedRecords(spark, str(tmp_path / "r"), buckets=2)
    table.merge(records(spark, [(None, 1.0, "en"), (1, 1.0, "en")]), ["id"])
    table.merge(records(spark, [(1,), (1,)], "id long"), ["id"])
    assert told(table) == [(1, 1.0, "en"), (None, 1.0, "en")]


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    root = str(tmp_path)
    schema = "id long, score double, lang string"

    def add(rows):
        records(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        upsert_stream(stream, f"{root}/out", ["id"], f"{root}/cp", 4).awaitTermination(120)

    add([(1, 1.0, "en"), (2, 2.0, "en")])
    add([(2, 5.0, "fr")])
    run()
    table = BucketedRecords(spark, f"{root}/out")
    assert told(table) == [(1, 1.0, "en"), (2, 5.0, "fr")]
    # The last micro-batch was merged, but the stream was lost before it could note that.
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    add([(3, 3.0, "de"), (1, 0.5, "de")])
    run()
    assert told(table) == [(1, 0.5, "de"), (2, 5.0, "fr"), (3, 3.0, "de")]
    assert {r.batch for r in table._commits()} == {0, 1, 2}
