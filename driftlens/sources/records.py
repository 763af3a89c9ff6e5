"""Score records: one partitioned table instead of a file per (phase, model, in, out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("phase", "model", "dataset_in", "dataset_out")


def sanitize(model: str) -> str:
    return model.replace("/", "_")


def record_name(model: str, dataset_in: str, dataset_out: str) -> str:
    """The name a record file would have."""
    return f"{sanitize(model)}_{dataset_in}_{dataset_out}.json"


def with_metadata(df: DataFrame, **meta) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in meta.items()})


def write_records(df: DataFrame, root: str, mode: str = "append") -> None:
    """``df`` carries phase, model, dataset_in and dataset_out; tasks write where they are, nothing is shuffled."""
    clean = df.withColumn("model", F.replace(F.col("model"), F.lit("/"), F.lit("_")))
    clean.write.mode(mode).partitionBy(*PARTITIONS).parquet(root)


def read_records(spark: SparkSession, root: str, **partition: str) -> DataFrame:
    """Records, pruned to the given partition values."""
    df = spark.read.parquet(root)
    for name, value in partition.items():
        df = df.where(F.col(name) == (sanitize(value) if name == "model" else value))
    return df


def round_scores(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Floating-point columns, also inside arrays, rounded for output."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            columns.append(F.round(field.name, decimals).alias(field.name))
        elif kind in ("array<double>", "array<float>"):
            columns.append(F.transform(field.name, lambda x: F.round(x, decimals)).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def write_json(df: DataFrame, path: str, decimals: int = 3) -> None:
    round_scores(df, decimals).write.mode("errorifexists").json(path)


def merge_records(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Union of two record tables by key; where both have a key, the new row wins as a whole."""
    fresh = new.withColumn("_new", F.lit(True))
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    joined = old.alias("o").join(fresh.alias("n"), list(keys), "full")

    def pick(name: str):
        if name not in new.columns:
            return F.col(f"o.{name}").alias(name)
        if name not in old.columns:
            return F.col(f"n.{name}").alias(name)
        return F.when(F.col("_new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return joined.select(*keys, *[pick(c) for c in columns])
