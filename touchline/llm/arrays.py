"""Arrow string columns as flat byte arrays, cut into pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of array work takes at once; a longer single text is taken alone.
CHUNK_BYTES = 2 << 20


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for consecutive row ranges of about ``limit`` bytes; nulls count as empty."""
    col = batch.column(column)
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        col, kind = col.cast(pa.large_binary()), np.int64
    else:
        col, kind = col.cast(pa.binary()), np.int32
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def binary_column(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values ``flat[offsets[i]:offsets[i + 1]]`` without a copy per value (``offsets`` in bytes, under 2 GB in all)."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
