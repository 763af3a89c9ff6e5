"""Longest common subsequences with big-integer bit rows: n steps on m-bit numbers instead of n * m cells."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa

ROWS = 32


def _positions(tokens: Sequence[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for place, token in enumerate(tokens):
        masks[token] = masks.get(token, 0) | (1 << place)
    return masks


def _rows(first: Sequence[str], masks: dict[str, int], size: int) -> Iterable[int]:
    """After each token of ``first``: a number whose zero bits mark where the LCS grows along the other text."""
    full = (1 << size) - 1
    row = full
    for token in first:
        hits = row & masks.get(token, 0)
        row = ((row + hits) | (row - hits)) & full
        yield row


def lcs_length(first: Sequence[str], second: Sequence[str]) -> int:
    row = (1 << len(second)) - 1
    for row in _rows(first, _positions(second), len(second)):
        pass
    return len(second) - row.bit_count()


def lcs_places(ref: Sequence[str], hyp: Sequence[str], masks: dict[str, int] | None = None) -> set[int]:
    """Places of one LCS in ``ref``, walking back from the ends; a tie drops a ref token first."""
    size = len(hyp)
    rows = [(1 << size) - 1, *_rows(ref, _positions(hyp) if masks is None else masks, size)]

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    places, i, j = set(), len(ref), size
    left = length(i, j)  # LCS length of what is still to be walked
    while left:
        if ref[i - 1] == hyp[j - 1]:
            places.add(i - 1)
            i, j, left = i - 1, j - 1, left - 1
        elif rows[i] >> (j - 1) & 1 and length(i - 1, j) < left:
            j -= 1
        else:
            i -= 1
    return places


def prf(hits: int, hyp_size: int, ref_size: int) -> tuple[float, float, float]:
    precision = hits / hyp_size if hyp_size else 0.0
    recall = hits / ref_size if ref_size else 0.0
    return precision, recall, 2 * precision * recall / (precision + recall) if hits else 0.0


def summary_hits(refs: Sequence[Sequence[str]], hyps: Sequence[Sequence[str]]) -> int:
    """Union-LCS hits of all reference sentences, each token used no more often than both sides have it."""
    left_ref = Counter(t for s in refs for t in s)
    left_hyp = Counter(t for s in hyps for t in s)
    # A sentence that occurs twice adds nothing to a union; one that shares no token adds nothing either.
    different = [(hyp, _positions(hyp)) for hyp in {tuple(h): None for h in hyps}]
    hits = 0
    for ref in refs:
        words, places = set(ref), set()
        for hyp, masks in different:
            if not words.isdisjoint(masks) and len(places) < len(ref):
                places |= lcs_places(ref, hyp, masks)
        for place in sorted(places):
            token = ref[place]
            if left_ref[token] > 0 and left_hyp[token] > 0:
                hits += 1
                left_ref[token] -= 1
                left_hyp[token] -= 1
    return hits


def _scores(score: Callable[[list, list], tuple[float, float, float]], hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Rows become Python objects a few at a time, whatever the batch holds; NULL counts as empty."""
    out = np.zeros((len(hyp), 3))
    for start in range(0, len(hyp), ROWS):
        rows = zip(hyp.slice(start, ROWS).to_pylist(), ref.slice(start, ROWS).to_pylist())
        for at, (h, r) in enumerate(rows, start):
            out[at] = score(h or [], r or [])
    return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], names=["precision", "recall", "fmeasure"])


def rouge_l(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return _scores(lambda h, r: prf(lcs_length(r, h), len(h), len(r)), hyp, ref)


def rouge_lsum(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return _scores(lambda h, r: prf(summary_hits(r, h), sum(map(len, h)), sum(map(len, r))), hyp, ref)
