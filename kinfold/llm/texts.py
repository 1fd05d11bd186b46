"""Helpers for Arrow batches of texts inside tasks.

Texts are handled in slices of a few megabytes. A slice is split at single
spaces and its pieces are dictionary-encoded, so that work on a piece is done
once for all its occurrences, and results are gathered by position.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20  # text handled at once; a longer text is handled alone


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """What a worker keeps between tasks under this key; what other operators have
    left in it goes, so that a worker holds the tables of one operator at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


def strings(column: pa.Array) -> pa.Array:
    """The column as strings with 64-bit offsets, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.cast(column, pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about `size` bytes of text each."""
    if not batch.num_rows:
        return
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(length, dtype=np.int64) // size
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, stop - start)


def pieces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces between single spaces: the distinct ones, the number of each
    piece in order, and where each text's pieces begin (one more at the end)."""
    split = pc.split_pattern(texts, " ")
    begins = np.asarray(split.offsets, dtype=np.int64)
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), begins - begins[0]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given spans, one span after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of `values` in each [begins[i], begins[i + 1])."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[begins[1:]] - total[begins[:-1]]
