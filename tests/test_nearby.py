"""Large references: searched in stored blocks, ranked along directions; both against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.operators import detectors as D
from driftlens.operators import nearby
from driftlens.operators.detectors import projection
from driftlens.operators.detectors.projection import nearest

STREAMED = {"small_bytes": 0, "reference_rows": 40}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def clusters(seed, rows, width=6, centres=12, noise=0.05):
    """Unit-scale clusters around the same few directions, some equal and zero rows among them."""
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(centres, width))
    out = middle[rng.integers(0, centres, rows)] + noise * rng.normal(size=(rows, width))
    out[::50] = out[0]
    out[7::100] = 0
    return out


@pytest.fixture(scope="module")
def sides(spark):
    def build(seed, rows):
        data = [(i, v.tolist()) for i, v in enumerate(clusters(seed, rows))]
        return spark.createDataFrame(data, "sample_id long, features array<double>").repartition(5).cache()

    return build(1, 300), build(2, 900)


def logs(df):
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + F.exp(x))
    return df.withColumn("features", F.transform("features", lambda x: x - F.log(total)))


def told(df):
    return {r["sample_id"]: (r["partners"], np.round(r["scores"], 9).tolist()) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 5])
def test_streamed_blocks_give_all_pairs_cosines(sides, k):
    left, right = sides
    assert told(nearest(left, right, k, **STREAMED)) == told(nearest(left, right, k))


@pytest.mark.parametrize("alpha", [0.3, 0.5, 1, 2.5])
def test_streamed_blocks_give_all_pairs_divergences(sides, alpha):
    left, right = map(logs, sides)
    one, two = (told(nearest(left, right, 3, "renyi", alpha=alpha, **how)) for how in ({}, STREAMED))
    assert one.keys() == two.keys()
    for key in one:
        assert np.allclose(one[key][1], two[key][1], atol=1e-8)


def test_more_partners_than_rows_and_few_rows(sides):
    left, right = sides
    some = right.where("sample_id < 3")
    assert told(nearest(left, some, 5, **STREAMED)) == told(nearest(left, some, 5))
    assert nearest(left.limit(0), right, 2, **STREAMED).count() == 0


def test_rows_of_the_left_side_are_not_moved(spark, sides, tmp_path):
    left, right = sides
    left.write.parquet(str(tmp_path / "left"))
    found = nearest(spark.read.parquet(str(tmp_path / "left")), right, 2, **STREAMED)
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
    assert found.count() == 300


def test_most_blocks_are_skipped(spark):
    data = clusters(3, 4_000, centres=40, noise=0.01)[[i for i in range(4_000) if i % 100 != 7]]
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "partner long, vector array<double>")
    measure = projection._measure("cosine", 0.5)
    layout = nearby.lay_out(right, "partner", "vector", measure, 50)
    read = []

    def load(block):
        read.append(block)
        rows = right.sparkSession.read.parquet(f"{layout.path}/block={block}").orderBy("partner").toArrow()
        return rows["partner"].to_numpy(), np.array(rows["vector"].to_pylist())

    rows = data[100:103]
    partners, signed = nearby.search(rows, layout, measure, 2, load)
    cosines = projection.cosine(rows, data)
    assert np.allclose(-signed, np.sort(cosines, axis=1)[:, :-3:-1])
    assert len(layout.block) >= 70 and len(read) < len(layout.block) / 3


def test_bounds_hold():
    rng = np.random.default_rng(5)
    p, q = (np.log(x / x.sum(axis=1, keepdims=True)) for x in rng.gamma(0.3, size=(2, 200, 5)) + 1e-9)
    for metric, alphas, a, b in (("renyi", (0.1, 0.5, 0.9, 1, 3), p, q), ("cosine", (0.5,), p - p.mean(), q - q.mean())):
        for alpha in alphas:
            measure = projection._measure(metric, alpha)
            angle = np.arccos(np.clip(measure.units(a) @ measure.units(b).T, -1, 1))
            assert (measure.signed(a, b) >= measure.least(angle) - 1e-6).all()


def test_depth_by_ranks_is_that_of_sorted_projections(spark):
    rng = np.random.default_rng(6)
    data = np.round(rng.normal(size=(400, 3)), 1)
    data[::3] = data[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "sample_id long, features array<double>").repartition(6)
    reference = rows.where("sample_id % 2 = 0")
    one, two = (
        {r["sample_id"]: r["score"] for r in D.DataDepth(11, **how).fit(reference).transform(rows).collect()}
        for how in ({}, {"small_bytes": 0, "bucket_rows": 9})
    )
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-12 for i in one)
    made = plan(D.DataDepth(11, small_bytes=0).fit(reference).transform(rows))
    assert "Cartesian" not in made and "NestedLoop" not in made


def test_depth_beyond_the_reference(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(10)] + [(10, [-5.0]), (11, [50.0])], "sample_id long, features array<double>")
    depths = D.DataDepth(3, small_bytes=0).fit(rows.where("sample_id < 10")).transform(rows)
    found = {r["sample_id"]: r["score"] for r in depths.collect()}
    assert len(found) == 12 and found[10] == found[11] == 0
