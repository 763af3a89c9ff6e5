import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import splits
from driftlens.operators.ordering import keys_at_ranks, quantiles, running_total
from driftlens.operators.splits import Piece


def frame(spark, values, kind="long"):
    return spark.createDataFrame([(v,) for v in values], f"k {kind}").repartition(4)


@pytest.mark.parametrize("leaf", [7, 10_000])
def test_ranks_with_a_value_that_fills_a_third(spark, leaf):
    rng = random.Random(1)
    values = [rng.randrange(10_000) for _ in range(400)] + [4_321] * 200
    rng.shuffle(values)
    n, found = keys_at_ranks(frame(spark, values), "k", range(600), leaf_rows=leaf, fan_out=5)
    assert n == 600
    assert [found[i] for i in range(600)] == sorted(values)


def test_ranks_of_keys_beyond_double_precision(spark):
    values = [2**62 + i for i in range(300)]
    _, found = keys_at_ranks(frame(spark, values), "k", [0, 137, 299], leaf_rows=5, fan_out=4)
    assert found == {0: values[0], 137: values[137], 299: values[299]}


def test_ranks_outside_are_left_out(spark):
    assert keys_at_ranks(frame(spark, [3, 1, 2]), "k", [-1, 1, 3]) == (3, {1: 2})
    assert keys_at_ranks(frame(spark, [1]).where("k > 5"), "k", [0]) == (0, {})


def test_quantiles_match_numpy(spark):
    values = np.random.default_rng(3).normal(size=500).tolist() + [0.0] * 100 + [-0.0] * 20
    shares = [i / 20 for i in range(20)]
    assert np.allclose(quantiles(frame(spark, values, "double"), "k", shares), np.quantile(values, shares), atol=1e-12)


def test_running_total(spark):
    rows = [("a" if i % 3 else "b", i // 10, i, i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, b long, i long, v long")
    got = {r["i"]: r["t"] for r in running_total(df, ["g"], "b", [F.col("i")], "v", "t").collect()}
    for g in "ab":
        before = 0
        for row in (r for r in rows if r[0] == g):
            assert got[row[2]] == before
            before += row[3]


@pytest.mark.parametrize("start,stop", [(None, 10), (3, 7), (5, None), (-4, None), (None, -4), (None, 0), (50, 60), (-100, 3), (7, 3)])
def test_slices_follow_list_slices(spark, start, stop):
    ids = [i * 7 for i in range(20)]
    df = spark.createDataFrame([(i,) for i in ids], "row_id long").repartition(3)
    assert sorted(r[0] for r in splits.slice_rows(df, start, stop).collect()) == ids[start:stop]


def test_slice_bound_reaches_the_scan(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "row_id").write.parquet(str(tmp_path / "t"))
    sliced = splits.slice_rows(spark.read.parquet(str(tmp_path / "t")), 100, 200)
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_id,100)" in plan and "LessThan(row_id,200)" in plan
    assert sliced.count() == 100


def test_recompose_and_cap(spark):
    rows = [(i, s) for s, n in (("train", 30), ("validation", 10), ("test", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, split string")
    train, val, test = (list(range(n)) for n in (30, 10, 8))
    recipe = [
        Piece("train", "train", None, -5, 2), Piece("validation", "validation", None, 3),
        Piece("validation", "train", -5), Piece("test", "validation", 3), Piece("test", "test"),
    ]
    expected = {"train": train[:-5] * 2, "validation": val[:3] + train[-5:], "test": val[3:] + test}

    def lists(frame):
        out = {"train": [], "validation": [], "test": []}
        for r in frame.orderBy("split", "part", "row_id").collect():
            out[r["split"]].append(r["row_id"])
        return out

    made = splits.recompose(df, recipe)
    assert lists(made) == expected
    for n in (0, 4, 27, -3, 1000):
        assert lists(splits.cap(made, n)) == {s: v[:n] for s, v in expected.items()}
    assert lists(splits.cap(made, {"train": 26, "test": None, "validation": 0})) == {
        "train": expected["train"][:26], "validation": [], "test": expected["test"],
    }


@pytest.mark.parametrize("n", [1, 9, 10, 137])
def test_holdout_sizes(spark, n):
    sizes = {r["split"]: r["count"] for r in splits.holdout(spark.range(n).withColumnRenamed("id", "row_id")).groupBy("split").count().collect()}
    assert sizes.get("validation", 0) == n // 10 and sizes.get("train", 0) == n - n // 10


def test_stratified_sizes_with_a_hot_and_a_null_group(spark):
    df = spark.range(1000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 10)).alias("g"),
    )
    counts = {(r["g"], r["split"]): r["count"] for r in splits.split_stratified(df, "g").groupBy("g", "split").count().collect()}
    totals = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    for g, n in totals.items():
        train, val = int(0.8 * n), int(0.1 * n)
        assert (counts.get((g, "train"), 0), counts.get((g, "validation"), 0), counts.get((g, "test"), 0)) == (train, val, n - train - val)


def test_a_row_without_a_key_raises(spark):
    rows = spark.createDataFrame([(i,) for i in range(8)] + [(None,), (None,)], "row_id long")
    for start, stop in ((0, 9), (2, 5), (None, -1)):
        with pytest.raises(ValueError, match="2 rows have no row_id"):
            splits.slice_rows(rows, start, stop)
