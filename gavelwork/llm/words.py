"""Words of many texts at once: word codes and the distinct words they stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split in one step; a longer text is a step of its own.
STEP_BYTES = 6_000_000


def steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Slices (begin, end) of about ``size`` bytes of text each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + size, "right")))
        yield begin, end
        begin = end


def as_array(column) -> pa.Array:
    """One string array with 64-bit offsets and empty texts for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: bounds of each text, word codes, distinct words.

    Words of text i are codes[bounds[i]:bounds[i + 1]].
    """
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.dictionary_encode()
    codes = np.asarray(coded.indices)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    words = coded.dictionary.to_pylist()
    if "" in words:  # leading and trailing space leaves empty words
        empty = words.index("")
        full = codes != empty
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        codes = codes[full]
    return bounds, codes, words


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for every i, zero where empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Cache(dict):
    """Values by key, computed when missing; starts anew when full."""

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.compute(key)
        return value
