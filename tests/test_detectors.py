import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlens.operators import detectors as D
from driftlens.operators import metrics
from driftlens.operators.detectors.projection import nearest
from driftlens.operators.rejection import perf_vs_rejection
from driftlens.plans.evaluation import aggregate_token_records
from driftlens.streaming import score_stream

BLOCKS = {"small_bytes": 0, "block_rows": 7, "reference_rows": 11}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 3), (rng.normal(size=5) + 3 * (i % 3)).tolist()) for i in range(120)]
    rows.append((120, 0, [50.0] * 5))
    return spark.createDataFrame(rows, "sample_id long, label int, features array<double>").repartition(4).cache()


def scores(df):
    return {(r["sample_id"], r["seq_id"], r["detector"]): r["score"] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys() and len(a) > 0
    assert np.allclose([a[k] for k in sorted(a)], [b[k] for k in sorted(a)], atol=1e-9)


def test_mahalanobis_against_numpy(points):
    reference = points.where("sample_id < 60")
    got = scores(D.Mahalanobis().fit(reference).transform(points))
    rows = points.orderBy("sample_id").collect()
    x, labels = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    ref, mine = x[:60], labels[:60]
    means = np.array([ref[mine == c].mean(axis=0) for c in range(3)])
    centred = ref - means[mine]
    inverse = np.linalg.inv(centred.T @ centred / 60)
    want = [min(d @ inverse @ d for d in row - means) for row in x]
    assert np.allclose([got[(i, 0, "mahalanobis")] for i in range(121)], want, rtol=1e-8)
    assert max(got, key=got.get)[0] == 120


def test_mahalanobis_with_a_singular_covariance(spark):
    df = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(10)], "sample_id long, features array<double>")
    got = scores(D.Mahalanobis(label=None).fit(df).transform(df))
    assert all(np.isfinite(v) for v in got.values())


def test_blocks_give_what_a_broadcast_gives(points):
    reference = points.where("sample_id < 60")
    close(scores(D.CosineProjection().fit(reference).transform(points)), scores(D.CosineProjection(**BLOCKS).fit(reference).transform(points)))
    close(scores(D.DataDepth(9).fit(reference).transform(points)), scores(D.DataDepth(9, small_bytes=0, bucket_rows=7).fit(reference).transform(points)))
    logits = points.withColumnRenamed("features", "logits")
    base, split = D.InformationProjection(n_neighbors=3), D.InformationProjection(n_neighbors=3, **BLOCKS)
    close(scores(base.fit(logits.where("sample_id < 60")).transform(logits)), scores(split.fit(logits.where("sample_id < 60")).transform(logits)))
    one, two = (
        {r["sample_id"]: (r["partners"], np.round(r["scores"], 9).tolist()) for r in nearest(points, reference, 4, **how).collect()}
        for how in ({}, BLOCKS)
    )
    assert one == two


def test_beam_projection_in_blocks(points):
    beams = points.where("sample_id < 120").select(
        F.floor(F.col("sample_id") / 40).alias("sample_id"), (F.col("sample_id") % 40).cast("int").alias("seq_id"), F.col("features").alias("logits")
    )
    grid = ((0.5, 1.0), (0.5, 1.0, 2.0), (2, 5))
    got = scores(D.BeamRenyiProjection(*grid).transform(beams))
    assert len(got) == 120 * 2 * 3 * 2
    close(got, scores(D.BeamRenyiProjection(*grid, block_rows=8).transform(beams)))
    assert min(got.values()) >= -1e-12


def test_a_sample_with_one_sequence_has_a_null_projection(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, [0.0, 1.0]), (2, 1, [1.0, 0.0])], "sample_id long, seq_id int, logits array<double>")
    told = D.BeamRenyiProjection().transform(df).collect()
    assert {(r.sample_id, r.score is None) for r in told} == {(1, True), (2, False)}


def test_forests_by_key_are_those_of_each_key(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, key, rng.normal(size=6).tolist()) for i in range(60) for key in ("a", "b")]
    curves = spark.createDataFrame(rows, "sample_id long, seq_id int, detector string, token_scores array<double>")
    together = D.FunctionalIsolationForest(n_trees=5, by="detector").fit(curves)
    told = curves.withColumn("s", together._oddness()).collect()
    for key in ("a", "b"):
        mine = curves.where(F.col("detector") == key)
        alone = {r.sample_id: r.score for r in D.FunctionalIsolationForest(n_trees=5).fit(mine).transform(mine).collect()}
        assert {r.sample_id: r.s for r in told if r.detector == key} == alone
    other = curves.withColumn("detector", F.lit("c"))
    assert other.withColumn("s", together._oddness()).where("s IS NOT NULL").count() == 0


def test_trees_draw_from_all_curves(spark):
    curves = spark.range(5000).selectExpr("id AS sample_id", "0 AS seq_id", "transform(sequence(1, 4), k -> cast(id * k AS double)) AS token_scores")
    forest = D.FunctionalIsolationForest(n_trees=4, sample_size=16)
    drawn = forest._samples(curves.selectExpr("'' AS key", "sample_id", "token_scores AS curve"), {"": 5000})
    by_tree = {r.tree: r.n for r in drawn.groupBy("tree").agg(F.count("*").alias("n")).collect()}
    assert by_tree == {k: 16 for k in range(4)}
    from driftlens.functions.hashing import hash_key

    for tree in range(4):
        least = [r.sample_id for r in curves.orderBy(hash_key(42, F.lit(tree), F.col("sample_id"))).limit(16).collect()]
        x = {tuple(r.x) for r in drawn.where(F.col("tree") == tree).collect()}
        from driftlens.operators.detectors.forest import curve_coefficients

        same = curves.where(F.col("sample_id").isin(least)).select(F.arrow_udf(curve_coefficients, "array<double>")(F.col("token_scores")).alias("x"))
        assert x == {tuple(r.x) for r in same.collect()}


def test_divergences_from_uniform(spark):
    df = spark.createDataFrame([(1, 0, [[1.0] * 4, [1.0] * 4]), (2, 0, [[9.0, 0.0, 0.0, 0.0]])], "sample_id long, seq_id int, token_logits array<array<double>>")
    grid = D.RenyiNeg((0.05, 1.0, 5.0), (0.01, 1.0, 3.0))
    for (sample, _, _), value in scores(grid.transform(df)).items():
        assert abs(value) < 1e-12 if sample == 1 else value > 0
    uniform = scores(D.FisherRao().transform(df))
    assert abs(uniform[(1, 0, "fisher_rao(temperature=1.0,mode=output)")]) < 1e-6
    near_one, one = (scores(D.RenyiNeg((1.0,), (a,)).transform(df)) for a in (1.000001, 1.0))
    assert abs(list(near_one.values())[1] - list(one.values())[1]) < 1e-4


def test_empty_tokens_give_nan(spark):
    df = spark.createDataFrame([(1, 0, []), (2, 0, [[]]), (3, 0, [[1.0, 2.0]])], "sample_id long, seq_id int, token_logits array<array<double>>")
    got = {k[0]: v for k, v in scores(D.MSP().transform(df)).items()}
    assert np.isnan(got[1]) and np.isnan(got[2]) and abs(got[3] - 1 / (1 + np.e)) < 1e-12


def test_token_mode_keeps_one_number_per_token(spark):
    df = spark.createDataFrame([(1, 0, [[1.0, 2.0], [0.0, 0.0], [3.0, 1.0]]), (2, 1, [[1.0, 1.0]])], "sample_id long, seq_id int, token_logits array<array<double>>")
    scorer = D.RenyiNeg((1.0,), (0.5, 2.0), mode="token")
    rows = scorer.transform_tokens(df).collect()
    assert sorted(len(r["token_scores"]) for r in rows) == [1, 1, 3, 3]
    means = scores(D.RenyiNeg((1.0,), (0.5, 2.0)).transform(df))
    for r in rows:
        key = (r["sample_id"], r["seq_id"], r["detector"].replace("mode=token", "mode=output"))
        assert abs(np.mean(r["token_scores"]) - means[key]) < 1e-12


def test_fitted_divergence_of_the_mean_is_zero(spark):
    df = spark.createDataFrame([(i, 0, [1.0, 2.0, 3.0]) for i in range(5)], "sample_id long, seq_id int, logits array<double>")
    assert np.allclose(list(scores(D.RenyiDataFitted((1.0, 2.0), (0.5, 1.0, 2.0)).fit(df).transform(df)).values()), 0, atol=1e-12)


def test_best_beam_takes_the_likeliest(spark):
    rows = [(1, 0, [0.0, 0.0], -1.0), (1, 1, [5.0, 0.0], -0.5), (2, 0, [1.0, 0.0], -2.0)]
    df = spark.createDataFrame(rows, "sample_id long, seq_id int, logits array<double>, likelihood double")
    got = {(r["sample_id"], r["seq_id"]) for r in D.BestBeam(D.MSP()).transform(df).collect()}
    assert got == {(1, 1), (2, 0)}


def test_forest_is_repeatable_and_finds_the_odd_curve(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, (np.sin(np.linspace(0, 3, rng.integers(20, 40))) + rng.normal(scale=0.05)).tolist()) for i in range(100)]
    odd = [(1000, 0, (10 * np.cos(np.linspace(0, 40, 30))).tolist())]
    reference = spark.createDataFrame(rows, "sample_id long, seq_id int, token_scores array<double>")
    every = spark.createDataFrame(rows + odd, reference.schema).repartition(5)
    first, second = (scores(D.FunctionalIsolationForest().fit(reference).transform(every)) for _ in range(2))
    assert first == second
    assert max(first, key=first.get)[0] == 1000
    assert 0 < min(first.values()) and max(first.values()) <= 1


def test_bert_match_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(p, side, i, rng.normal(size=4).tolist()) for p in range(3) for side, n in (("hyp", 13), ("ref", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "pair_id long, side string, pos int, vector array<double>")
    one, two = ({r["pair_id"]: tuple(np.round(r[1:], 9)) for r in metrics.bert_greedy(df, 0.1, block_rows=b).collect()} for b in (1024, 4))
    assert one == two
    unit = {k: np.array([r[3] for r in rows if r[0] == 0 and r[1] == k]) for k in ("hyp", "ref")}
    unit = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in unit.items()}
    table = unit["hyp"] @ unit["ref"].T
    p, r = table.max(axis=1).mean(), table.max(axis=0).mean()
    assert np.allclose(one[0], [(p - 0.1) / 0.9, (r - 0.1) / 0.9, (2 * p * r / (p + r) - 0.1) / 0.9], atol=1e-8)


@pytest.mark.parametrize("sign,parity", [(1, False), (-1, False), (-1, True)])
def test_rejection_curve(spark, sign, parity):
    rng = np.random.default_rng(8)
    score = np.concatenate([rng.normal(size=150), np.zeros(75)])
    metric = rng.integers(0, 2, size=225).astype(float)
    df = spark.createDataFrame([(float(m), float(s)) for m, s in zip(metric, score)], "m double, s double")
    curve = perf_vs_rejection(df, "m", "s", sign=sign, parity=parity).orderBy("rejection").collect()
    assert len(curve) == 100
    for row in curve:
        cut = np.quantile(score if parity else score * sign, row["rejection"])
        kept = metric[score * sign > row["threshold"]]
        assert abs(cut - row["threshold"]) < 1e-12 and len(kept) == row["n"]
        assert row["perf"] is None if not len(kept) else abs(kept.mean() - row["perf"]) < 1e-12


def test_fitted_scorers_run_on_streams(spark, points, tmp_path):
    fitted = D.Mahalanobis().fit(points)
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, fitted, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    close(scores(spark.read.parquet(str(tmp_path / "out"))), scores(fitted.transform(points)))


def test_token_records_per_detector(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 0, rng.normal(size=(4 + i % 3, 6)).tolist()) for i in range(40)]
    outputs = spark.createDataFrame(rows, "sample_id long, seq_id int, token_logits array<array<double>>")
    curves = D.RenyiNeg((1.0,), (0.5, 2.0), mode="token").transform_tokens(outputs)
    records = aggregate_token_records(curves, curves, n_trees=5)
    assert records.count() == 80
    assert set(records.columns) == {"sample_id", "seq_id", "detector", "token_scores_mean", "token_scores_std", "fif_token_scores"}
    means = scores(D.RenyiNeg((1.0,), (0.5, 2.0)).transform(outputs))
    for r in records.collect():
        key = (r["sample_id"], r["seq_id"], r["detector"].replace("mode=token", "mode=output"))
        assert abs(r["token_scores_mean"] - means[key]) < 1e-12


def test_curve_coefficients_by_runs():
    """The plain formula, over several runs of values; memory is that of a run, not of several copies of the batch."""
    import tracemalloc

    from driftlens.operators.detectors.forest import FREQUENCIES, curve_coefficients

    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 70_000, 5, 0, *rng.integers(1, 900, 2_500), 0]
    curves = [rng.normal(size=n) for n in sizes]
    array = pa.array(curves, pa.list_(pa.float64()))
    tracemalloc.start()
    got = curve_coefficients(array)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * sum(sizes)
    got = got.to_pylist()
    for x, told in list(zip(curves, got))[:40] + list(zip(curves, got))[-5:]:
        n = len(x)
        angle = 2 * np.pi * np.outer(np.arange(FREQUENCIES), (np.arange(n) + 0.5) / max(n, 1))
        slope = np.concatenate([[0.0], np.diff(x) * n])[:n]
        want = [w @ y / n if n else 0.0 for y in (x, slope) for a in angle for w in (np.cos(a), np.sin(a))]
        assert np.allclose(told, want, rtol=1e-9, atol=1e-9)


def test_token_stats_are_the_expressions_numbers(spark):
    """Bit for bit, in one Python step with the forest's, and no score is made for a key that is not asked for."""
    from driftlens.functions.vectors import mean, std_population
    from driftlens.operators.aggregates import token_stats
    from driftlens.plans.score_queries import flow_aggregate_keys

    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(0, 90, n) / 10).tolist()) for i, n in enumerate([0, 1, 2, 66_000, *rng.integers(1, 700, 120)])]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "sample_id long, token_scores array<double>")
    got = token_stats(df).collect()
    want = df.select("sample_id", mean(F.col("token_scores")), std_population(F.col("token_scores"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
    plan = flow_aggregate_keys(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.executedPlan().toString().split("Initial Plan")[0].count("ArrowEvalPython [") == 1
    lines = plan.optimizedPlan().toString().splitlines()
    made = next(i for i, x in enumerate(lines) if "factor" in x and "transform" in x)
    assert any("Contains(" in x or "mode=token" in x and "Filter" in x for x in lines[made:])
