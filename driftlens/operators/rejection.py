"""Performance when the rows with the lowest scores are rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.operators.ordering import quantiles
from driftlens.session import materialize

# Rejection rates 0, 0.01, ..., 0.99.
RATES = tuple(i / 100 for i in range(100))


def perf_vs_rejection(
    df: DataFrame,
    metric: str,
    score: str,
    sign: int = 1,
    rates: Sequence[float] = RATES,
    parity: bool = False,
    stored: bool = False,
) -> DataFrame:
    """(rejection, threshold, n, perf): mean metric of the rows with sign * score strictly above the quantile.

    One exact multi-quantile search, then one pass that counts rows between neighbouring thresholds. The
    two columns are written out first, so that scores are not computed once per pass; ``stored`` tells
    that ``df`` is a plain scan, which is read again instead.
    For sign -1, ``parity`` takes the quantile of the unsigned score. Without a row left, perf is NULL.
    """
    spark = df.sparkSession
    signed = df.select(
        F.col(metric).cast("double").alias("m"),
        F.col(score).cast("double").alias("raw"),
        (F.col(score).cast("double") * sign).alias("s"),
    ).where(F.col("s").isNotNull() & ~F.isnan("s"))
    signed = signed if stored else materialize(signed)
    cuts = quantiles(signed, "raw" if parity else "s", rates)
    levels = sorted({c for c in cuts if c is not None})
    rung = {c: i for i, c in enumerate(levels)}
    grid = spark.createDataFrame(
        [(float(r), c, rung.get(c)) for r, c in zip(rates, cuts)], "rejection double, threshold double, rung int"
    )
    # Negated, a bucket's number counts the thresholds at or above the score.
    edges = [-float("inf"), *[0.0 - c for c in reversed(levels)], float("inf")]
    bucketizer = Bucketizer(splits=edges, inputCol="neg", outputCol="b")
    rungs = (
        bucketizer.transform(signed.withColumn("neg", F.lit(0.0) - F.col("s")))
        .groupBy((F.lit(len(levels) - 1) - F.col("b")).cast("int").alias("top"))
        .agg(F.count("*").alias("n"), F.sum("m").alias("total"), F.count("m").alias("scored"))
    )
    ladder = spark.createDataFrame([(i,) for i in range(len(levels))], "top int").join(rungs, "top", "left")
    # At most one row per rate from here on.
    above = W.orderBy(F.desc("top")).rowsBetween(W.unboundedPreceding, 0)
    sums = ladder.select(
        F.col("top").alias("rung"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"),
        F.sum("total").over(above).alias("total"),
        F.sum("scored").over(above).alias("scored"),
    )
    return grid.join(F.broadcast(sums), "rung", "left").select(
        "rejection",
        "threshold",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when(F.col("scored") > 0, F.col("total") / F.col("scored")).alias("perf"),
    )
