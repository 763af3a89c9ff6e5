"""Corpora on storage: {root}/{name}[/{config}]/{split}.parquet, or any layout given by a function."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.contracts import SPLITS
from driftlens.operators.adapters import pick_pair

Layout = Callable[[str], str]


def _layout(root: str, name: str, config: str | None) -> Layout:
    folder = "/".join(p for p in (root, name, config) if p)
    return lambda split: f"{folder}/{split}.parquet"


def read_corpus(
    spark: SparkSession,
    root: str,
    name: str,
    config: str | None = None,
    splits: Sequence[str] = SPLITS,
    layout: Layout | None = None,
    optional: Sequence[str] = (),
) -> DataFrame:
    """All splits of a corpus in one frame with a ``split`` column.

    A split that is not there raises, unless it is ``optional``; then it has no rows.
    """
    locate = layout or _layout(root, name, config)
    found, missing = [], []
    for split in splits:
        try:
            found.append(read_saved(spark, locate(split)).withColumn("split", F.lit(split)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(split)
    if not found:
        raise ValueError(f"corpus {name} has none of the splits {list(splits)} at {locate('*')}")
    if lost := [split for split in missing if split not in optional]:
        raise FileNotFoundError(f"corpus {name} lacks the splits {lost} at {locate('*')}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_pair_corpus(
    spark: SparkSession, root: str, name: str, pair: str, splits: Sequence[str] = SPLITS
) -> DataFrame:
    """The corpus of language pair 'a-b', stored under 'a-b' or 'b-a'."""
    first, second = pair.split("-")
    for config in (pair, f"{second}-{first}"):
        try:
            return read_corpus(spark, root, name, config, splits)
        except ValueError:
            continue
    raise ValueError(f"invalid pair for {name}: neither {pair} nor {second}-{first} is stored")


def read_pair(
    spark: SparkSession, root: str, name: str, pair: str, splits: Sequence[str] = SPLITS, column: str = "translation"
) -> DataFrame:
    """Source/target of pair 'a-b'; the source is language a, whichever way round the pair is stored."""
    return pick_pair(read_pair_corpus(spark, root, name, pair, splits), *pair.split("-"), column)


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus(df: DataFrame, root: str, name: str, config: str | None = None, splits: Sequence[str] = SPLITS) -> None:
    """Store a frame with a ``split`` column in the default layout."""
    locate = _layout(root, name, config)
    for split in splits:
        df.where(F.col("split") == split).drop("split").write.mode("overwrite").parquet(locate(split))


def ingest_all(
    spark: SparkSession, registry: Mapping[str, Callable[[SparkSession], DataFrame]], out: str
) -> DataFrame:
    """Load and store every registered corpus; a failure is reported and does not stop the others."""
    report = []
    for name, load in registry.items():
        path = f"{out}/{name}"
        try:
            load(spark).write.mode("overwrite").parquet(path)
            report.append((name, "ok", spark.read.parquet(path).count(), None))
        except Exception as error:  # noqa: BLE001 - the report is the point
            report.append((name, "failed", 0, str(error).splitlines()[0]))
    return spark.createDataFrame(report, "name string, status string, rows long, error string")
