"""What the corpus operators share: reading, train/held-out split, bounded text blocks in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.session import scratch_path, text_batches

# A filter of keys has this many bits, whatever the data.
FILTER_BITS = 1 << 26

# Tasks work on blocks of texts of about this many bytes, whatever the rows are like.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """A derived table that several jobs read, as Parquet in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % 3


def is_held_out(doc_id: Column) -> Column:
    """Fold 1; a NULL id is not held out (and not learnt from, see `is_training`)."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def is_training(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) != 1, F.lit(False))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str) -> DataFrame:
    """mapInArrow with one output batch per input batch; `step` gives its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(step(batch))

    text_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; NULL counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list, size: int = BLOCK_BYTES) -> Iterator[tuple[int, list]]:
    """(first index, texts) in runs of about `size` units; a longer text is a run of its own."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, texts[start:at]
            start, held = at, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, texts[start:]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _with_guess(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """`name`: whether the key may be in the one column of `keys`, by a bit set of fixed size that Spark puts together."""
    text_batches(df.sparkSession)
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    told = keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(FILTER_BITS)).alias("bit"))
    told = told.selectExpr("bit div 64 AS word", "shiftleft(1L, cast(bit % 64 AS int)) AS one")
    told = told.groupBy("word").agg(F.bit_or("one").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[told["word"].to_numpy(np.int64)] = told["bits"].to_numpy(np.int64)
    shipped = df.sparkSession.sparkContext.broadcast(bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            bit = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            on = pa.array(((bits[bit >> 6] >> (bit & 63)) & 1).astype(bool))
            columns = [*batch.columns[:-1], on]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], name])

    marked = df.withColumn(name, bit)
    return marked.mapInArrow(look, T.StructType([*marked.schema.fields[:-1], T.StructField(name, T.BooleanType())]))


def keep_likely(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key may be in the one column of `keys`: all that are, and the few (or, with very many keys, most) that share a bit.

    Put before a join, it keeps long rows without a partner from being shuffled.
    """
    return _with_guess(df, key, keys, "_likely").where("_likely").drop("_likely")


def row_key() -> Column:
    """A hash of a document's id and text; it tells documents with the same id (or none) apart."""
    return F.xxhash64("doc_id", "text")


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents without those whose id and `row_key` are in `keys` (doc_id, key); rows are not moved, but for the few that share a bit with one."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), row_key().alias("_key"))
    guessed = _with_guess(packed, "_key", keys.select("key"), "_likely")
    sure = guessed.where(~F.col("_likely")).select("row.*")
    other = keys.select("doc_id", "key")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("key"))
    return sure.unionAll(guessed.where("_likely").join(other, same, "left_anti").select("row.*"))
