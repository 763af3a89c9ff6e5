"""Tokens and n-grams as array expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.arrow import lengths, lists_of, numbers_of

# White space as Python's str.split() sees it.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# The published mteval-v13a rules, as (pattern, replacement) in order of use.
MTEVAL_13A = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)


def words(text: Column) -> Column:
    """White-space tokens; an empty text has none."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def mteval_words(text: Column) -> Column:
    """Tokens after the 13a rules used for BLEU."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in MTEVAL_13A:
        padded = F.regexp_replace(padded, pattern, replacement)
    return words(padded)


def rouge_words(text: Column) -> Column:
    """Lower-case ASCII letter/digit runs, the usual ROUGE tokens (unstemmed)."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _ngram_numbers(tokens: np.ndarray, sizes: np.ndarray, n_max: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 ... n_max: (row, number) of every n-gram; equal n-grams have equal numbers, whatever their row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))  # tokens from here to the row's end
    kinds = int(tokens.max()) + 1 if len(tokens) else 1
    at, number = np.arange(len(tokens)), tokens
    out = [(row, number)]
    for n in range(2, n_max + 1):
        still = left[at] >= n
        at, number = at[still], number[still]
        _, number = np.unique(number * kinds + tokens[at + n - 1], return_inverse=True)
        out.append((row[at], number))
    return out


def shared_ngrams(first: Column, second: Column, n_max: int) -> Column:
    """Sizes of the multiset intersections of two token arrays' n-grams, n = 1 ... n_max, all rows of a batch at once."""

    def count(one: pa.Array, other: pa.Array) -> pa.Array:
        sizes = np.concatenate([lengths(one), lengths(other)])
        tokens = pa.concat_arrays([one.flatten(), other.flatten()])
        codes = numbers_of(tokens)
        rows = len(one)
        out = np.zeros((rows, n_max), np.int64)
        for n, (row, number) in enumerate(_ngram_numbers(codes, sizes, n_max)):
            kinds = int(number.max()) + 1 if len(number) else 1
            mine = row < rows
            a, in_a = np.unique(row[mine] * kinds + number[mine], return_counts=True)
            b, in_b = np.unique((row[~mine] - rows) * kinds + number[~mine], return_counts=True)
            both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            out[:, n] = np.bincount(both // kinds, np.minimum(in_a[at_a], in_b[at_b]), rows)
        return lists_of(out)

    return F.arrow_udf(count, "array<long>")(first, second)


def joined_stems(lists: pa.Array, names: pa.Array, stems: pa.Array) -> pa.Array:
    """Every token list as one text, each token that is among `names` as its stem."""
    flat = pc.cast(lists.flatten(), pa.large_string())
    found = pc.index_in(flat, value_set=pc.cast(names, pa.large_string()))
    told = pc.coalesce(pc.cast(stems, pa.large_string()).take(found), flat)
    places = np.concatenate([[0], np.cumsum(lengths(lists))])
    return pc.cast(pc.binary_join(pa.LargeListArray.from_arrays(pa.array(places, pa.int64()), told), pa.scalar(" ", pa.large_string())), pa.string())
