"""Simple-8b: as many unsigned ids per 64-bit word as their widths allow, coded and decoded with array operations."""

from __future__ import annotations

import numpy as np

#: Fixed values: (ids per word, bits per id) by selector, which stands in a word's lowest four bits.
#: Selector 0 is the escape: the other 60 bits are an index into the wide ids, kept apart in full.
PACKINGS = [(1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([c for c, _ in PACKINGS] + [0], np.int64)
#: Ids from one entry point to the next: a reader may start at any entry point.
STRIDE = 1024


def _widest(bits: np.ndarray, count: int) -> np.ndarray:
    """Largest of ``bits[i:i + count]``, for every i that has so many."""
    out, have = bits, 1
    while have < count:
        step = min(have, count - have)
        out = np.maximum(out[: len(out) - step], out[step:])
        have += step
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of every stride of ids, wide ids)."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    room = np.minimum(STRIDE - np.arange(n) % STRIDE, n - np.arange(n))
    selector = np.zeros(n, np.uint8)
    for s in range(len(PACKINGS) - 1, 0, -1):  # ends with the densest
        count, width = PACKINGS[s]
        if count <= n:
            fits = _widest(bits, count) <= width
            selector[: len(fits)][fits & (room[: len(fits)] >= count)] = s
    step = COUNTS[selector]
    lanes = np.arange(0, n, STRIDE)  # all strides are walked side by side
    ends = np.minimum(lanes + STRIDE, n)
    visited = []
    while len(lanes):
        visited.append(lanes)
        lanes = lanes + step[lanes]
        go = lanes < ends
        lanes, ends = lanes[go], ends[go]
    at = np.sort(np.concatenate(visited))
    chosen = selector[at]
    words = chosen.astype(np.uint64)
    for s in range(1, len(PACKINGS)):
        count, width = PACKINGS[s]
        here = np.flatnonzero(chosen == s)
        for k in range(count if len(here) else 0):
            words[here] |= ids[at[here] + k] << np.uint64(4 + k * width)
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64) << np.uint64(4)
    return words, np.searchsorted(at, np.arange(0, n, STRIDE)).astype(np.uint32), ids[at[escaped]]


def unpack(words: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The ids of consecutive words, as unsigned 64-bit integers."""
    selector = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[selector]
    if (counts == 0).any():
        raise ValueError("not a Simple-8b word")
    base = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        count, width = PACKINGS[s]
        here = np.flatnonzero(selector == s)
        if s == 0:
            out[base[here]] = wide[(words[here] >> np.uint64(4)).astype(np.int64)]
            continue
        for k in range(count):
            out[base[here] + k] = (words[here] >> np.uint64(4 + k * width)) & np.uint64((1 << width) - 1)
    return out
