"""Arrow arrays to numpy and back, without a Python object per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def numbers_of(values: pa.Array) -> np.ndarray:
    """Equal values get equal numbers from 0 on."""
    return pc.dictionary_encode(values).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(lists: pa.Array) -> np.ndarray:
    """Equally long vectors as rows of one matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = numbers(lists.flatten())
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def lists_of(rows: np.ndarray) -> pa.Array:
    """A matrix as an array of equally long lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * width, pa.int32()), pa.array(rows.ravel())
    )


def segment_starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes


def runs(sizes: np.ndarray, values: int = 1 << 16) -> Iterator[tuple[slice, slice]]:
    """(rows, their values) of consecutive segments, of about so many values each."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        first = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, first + values, side="right")))
        yield slice(start, stop), slice(first, ends[stop - 1])
        start = stop


def mean_and_deviation(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Mean and population deviation of every list, summed in its order; NULL for empty lists and such as hold a NULL."""
    sizes, flat = lengths(lists), lists.flatten()
    values, known = numbers(flat), pc.is_valid(flat).to_numpy(zero_copy_only=False)
    mean, deviation, whole = np.zeros(len(sizes)), np.zeros(len(sizes)), sizes > 0
    for rows, at in runs(sizes):
        count, x = sizes[rows], values[at]
        row = np.repeat(np.arange(len(count)), count)
        room = np.maximum(count, 1)
        mean[rows] = np.bincount(row, x, len(count)) / room
        apart = x - mean[rows][row]
        deviation[rows] = np.sqrt(np.bincount(row, apart * apart, len(count)) / room)
        if not known[at].all():
            whole[rows] &= np.bincount(row, ~known[at], len(count)) == 0
    return pa.array(mean, mask=~whole), pa.array(deviation, mask=~whole)


def segment_mean(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean over consecutive segments along the last axis; NaN for empty ones."""
    out = np.full((*values.shape[:-1], len(sizes)), np.nan, np.result_type(values, float))
    full = sizes > 0
    if full.any():
        sums = np.add.reduceat(values, segment_starts(sizes)[full], axis=-1)
        out[..., full] = sums / sizes[full]
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each one starts and the last one ends); NULL counts as empty."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    places = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[places[0] : places[-1]], places - places[0]


def texts_of(data: np.ndarray, places: np.ndarray, like: pa.Array) -> pa.Array:
    """The reverse of `text_bytes`, of the type of `like` and NULL where that is."""
    whole = pa.Array.from_buffers(pa.large_string(), len(like), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])
    return pc.if_else(like.is_valid(), whole, None).cast(like.type)
