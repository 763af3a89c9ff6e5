"""Seeded text perturbations, row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.arrow import text_bytes, texts_of
from driftlens.functions.hashing import hits
from driftlens.functions.text import words
from driftlens.operators.adapters import add_instruction

BLOCK_BYTES = 1 << 20


def upper_words(text: Column, row_id: Column, p: float = 0.1, seed: int = 42) -> Column:
    """Upper-case each word with probability p; white space collapses to single spaces."""

    def chosen(sizes: pa.Array, keys: pa.Array) -> pa.Array:
        counts = np.maximum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.array(hits(counts, keys.to_pylist(), f"{seed}w", p)))

    tokens = words(text)
    dice = F.arrow_udf(chosen, "array<boolean>")(F.size(tokens), row_id.cast("string"))
    return F.array_join(F.zip_with(tokens, dice, lambda w, hit: F.when(hit, F.upper(w)).otherwise(w)), " ")


def _thinned(texts: pa.Array, keys: pa.Array, name: str, p: float) -> pa.Array:
    data, places = text_bytes(texts)
    heads = (data & 0xC0) != 0x80  # the first byte of every code point
    at = np.concatenate([[0], np.cumsum(heads)])
    kept = ~hits(np.diff(at[places]), keys.to_pylist(), name, p)[at[1:] - 1]
    return texts_of(data[kept], np.concatenate([[0], np.cumsum(kept)])[places], texts)


def delete_chars(text: Column, row_id: Column, p: float = 0.1, seed: int = 42) -> Column:
    """Drop each character with probability p. A task holds the draws of BLOCK_BYTES of text, or of one longer text."""

    def thin(texts: pa.Array, keys: pa.Array) -> pa.Array:
        if not len(texts):
            return texts
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        parts = [_thinned(texts[i:j], keys[i:j], f"{seed}c", p) for i, j in zip(cuts, cuts[1:])]
        return pa.concat_arrays(parts)

    return F.arrow_udf(thin, "string")(text, row_id.cast("string"))


def perturb(
    df: DataFrame,
    kind: str | None,
    instruction: str = "",
    column: str = "source",
    row_id: str = "row_id",
    p: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """'hallucination' drops characters, then upper-cases words; otherwise the instruction is prefixed."""
    if kind != "hallucination":
        return add_instruction(df, instruction, column)
    # The thinned text is named first, so the word step does not expand it twice.
    thinned = df.withColumn(column, delete_chars(F.col(column), F.col(row_id), p, seed))
    return thinned.withColumn(column, upper_words(F.col(column), F.col(row_id), p, seed))
