"""The scorer protocol."""

from __future__ import annotations

import inspect
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("sample_id", "seq_id")


def key_columns(df: DataFrame) -> list[Column]:
    """sample_id and seq_id; outputs without sequences count as sequence 0."""
    seq = F.col("seq_id").cast("int") if "seq_id" in df.columns else F.lit(0)
    return [F.col("sample_id").cast("long").alias("sample_id"), seq.alias("seq_id")]


def label(name: str, **params) -> str:
    """'name(a=1,b=2)': the detector key of one parameter choice."""
    return f"{name}({','.join(f'{k}={v}' for k, v in params.items())})" if params else name


class Scorer:
    """``fit`` reads in-distribution outputs, ``transform`` gives (sample_id, seq_id, detector, score)."""

    score_names: Sequence[str] = ()

    def fit(self, reference: DataFrame) -> Scorer:
        return self

    def transform(self, outputs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def accumulate(self, reference: DataFrame, path: str, batch: int) -> None:
        """Add rows to what `fit_accumulated` fits on. The same batch number again replaces what it added."""
        reference.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    def fit_accumulated(self, spark: SparkSession, path: str) -> Scorer:
        """`fit` on all accumulated rows; scorers with statistics that add up keep only these."""
        return self.fit(spark.read.parquet(path).drop("batch"))

    def state(self, spark: SparkSession) -> dict[str, DataFrame]:
        """What `fit` found, as named tables."""
        return {}

    def restore(self, spark: SparkSession, tables: dict[str, DataFrame]) -> Scorer:
        return self

    def score_map(self, outputs: DataFrame) -> Column | None:
        """{detector: score} of each row, for scorers that need no other row; None for the others."""
        return None


def save_scorer(spark: SparkSession, scorer: Scorer, path: str) -> None:
    """A fitted scorer as a folder: its class and arguments, and its tables. Replaces what was there."""
    named = inspect.signature(type(scorer).__init__).parameters.values()
    kept: dict = {}
    for parameter in list(named)[1:]:
        value = getattr(scorer, parameter.name)
        if isinstance(value, Scorer):
            save_scorer(spark, value, f"{path}/{parameter.name}")
            value = {"scorer": f"{parameter.name}"}
        if parameter.kind is parameter.VAR_KEYWORD:
            kept |= value
        else:
            kept[parameter.name] = value
    tables = scorer.state(spark)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    described = json.dumps({"class": type(scorer).__name__, "arguments": kept, "tables": sorted(tables)})
    spark.createDataFrame([(described,)], "scorer string").write.mode("overwrite").parquet(f"{path}/description")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    """The scorer as it was saved, ready to score."""
    described = json.loads(spark.read.parquet(f"{path}/description").first()[0])
    arguments = {
        name: load_scorer(spark, f"{path}/{value['scorer']}") if isinstance(value, dict) and "scorer" in value else value
        for name, value in described["arguments"].items()
    }
    kinds = {kind.__name__: kind for kind in _kinds(Scorer)}
    scorer = kinds[described["class"]](**arguments)
    return scorer.restore(spark, {name: spark.read.parquet(f"{path}/{name}") for name in described["tables"]})


def _kinds(kind: type) -> list[type]:
    return [kind, *(found for below in kind.__subclasses__() for found in _kinds(below))]


def score_all(scorers: Sequence[Scorer], outputs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [s.transform(outputs) for s in scorers])


class BestBeam(Scorer):
    """The wrapped detector's score of the most likely sequence of each sample."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer

    def fit(self, reference: DataFrame) -> BestBeam:
        self.scorer = self.scorer.fit(reference)
        return self

    def transform(self, outputs: DataFrame) -> DataFrame:
        likely = outputs.select(*key_columns(outputs), "likelihood")
        # Equal likelihoods: the first sequence wins.
        rank = F.struct("likelihood", -F.col("seq_id"))
        best = (
            self.scorer.transform(outputs)
            .join(likely, list(KEYS))
            .groupBy("sample_id", "detector")
            .agg(F.max_by(F.struct("seq_id", "score"), rank).alias("best"))
        )
        return best.select(
            "sample_id", "best.seq_id", F.concat(F.lit("best_beam+"), "detector").alias("detector"), "best.score"
        )
