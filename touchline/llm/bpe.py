"""Byte-level BPE by a rank file, without regular expressions.

Text becomes code points, code points become classes, and a small automaton over the classes gives the start of every
slice. Most classes send every state to one state, so a state is known without looking further back; only apostrophes
that may open a contraction, and the letters after them, depend on it. Their transition functions are composed by a
doubling scan. Slices are merged once per distinct slice; offsets place every token's bytes when decoding.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrays import binary_column, concat_ranges, text_chunks
from touchline.llm.slices import SliceMemory

# --- classes of code points ---------------------------------------------------------------------------------------
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE1, QUOTE2 = range(7)
#: Code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction.
SHORT_TAILS, LONG_TAILS = ("s", "t", "m", "d"), ("re", "ve", "ll")

# --- states: the kind of slice the last code point stands in --------------------------------------------------------
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, ONE_LEFT, TWO_LEFT, CLOSED = range(8)


@functools.lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            table[c] = LETTER
        elif major == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


@functools.lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice starts), each by [class, state]; blanks need one more look, see ``slice_starts``."""
    after = np.zeros((7, 8), np.uint8)
    opens = np.zeros((7, 8), bool)
    for cls, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (BLANK, AFTER_BLANK), (SPACE, AFTER_SPACE)):
        after[cls] = state
        opens[cls] = True
        opens[cls, [state, AFTER_SPACE]] = False
    after[LETTER, TWO_LEFT], after[LETTER, ONE_LEFT] = ONE_LEFT, CLOSED
    opens[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    for cls, state in ((QUOTE1, ONE_LEFT), (QUOTE2, TWO_LEFT)):
        after[cls], opens[cls] = state, True
        after[cls, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        opens[cls, [IN_OTHER, AFTER_SPACE]] = False
    return after, opens


def slice_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """True where a slice starts. ``points``: code points of consecutive texts that start at ``doc_starts``."""
    n = len(points)
    after, opens = automaton()
    cls = class_table()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    quotes = np.flatnonzero(points == 0x27)
    depends = np.zeros(0, np.int64)
    if len(quotes):
        last = np.empty(n, bool)
        last[:-1], last[-1] = first[1:n], True
        nxt = np.where(last[quotes], 0, points[np.minimum(quotes + 1, n - 1)])
        ends = last[quotes] | last[np.minimum(quotes + 1, n - 1)]
        nxt2 = np.where(ends, 0, points[np.minimum(quotes + 2, n - 1)])
        one = np.isin(nxt, [ord(t) for t in SHORT_TAILS])
        two = np.zeros(len(quotes), bool)
        for a, b in LONG_TAILS:
            two |= (nxt == ord(a)) & (nxt2 == ord(b))
        cls[quotes[one]], cls[quotes[two]] = QUOTE1, QUOTE2
        depends = np.unique(np.concatenate([quotes[one], quotes[one] + 1, *(quotes[two] + k for k in range(3))]))
        depends = depends[depends < n]
    state = after[cls, CLOSED]
    if len(depends):
        # functions of a run of such positions, composed so that each maps the state before the run
        fn = after[cls[depends]].copy()
        fn[first[depends]] = fn[first[depends], CLOSED][:, None]
        run_start = np.flatnonzero(np.diff(depends, prepend=-2) != 1)
        within = np.arange(len(depends)) - np.repeat(run_start, np.diff(np.append(run_start, len(depends))))
        step = 1
        while step <= within.max():
            later = np.flatnonzero(within >= step)
            fn[later] = np.take_along_axis(fn[later], fn[later - step], axis=1)
            step *= 2
        before = depends - within - 1
        entry = np.where(before < 0, CLOSED, state[np.maximum(before, 0)])
        state[depends] = fn[np.arange(len(depends)), entry]
    prior = np.empty(n, np.uint8)
    prior[1:], prior[:1] = state[:-1], CLOSED
    start = opens[cls, prior]
    # a run of blanks keeps its last one for what follows, unless the text ends there
    blank = (cls == BLANK) | (cls == SPACE)
    more = np.zeros(n, bool)
    more[:-1] = ~blank[1:] & ~first[1:n]
    start = np.where(blank, np.where((prior == AFTER_BLANK) | (prior == AFTER_SPACE), more, True), start)
    start[doc_starts[doc_starts < n]] = True
    return start


# --- merging --------------------------------------------------------------------------------------------------------
@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes after one another by id, their starts and lengths."""
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    by_id = [b""] * size
    for token, rank in ranks.items():
        by_id[rank] = token
    lengths = np.array([len(t) for t in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(lengths) - lengths, lengths


def merge_slice(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of the lowest rank merges first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 40:
        get, none = ranks.get, len(ranks) + 1
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
        while pairs and (lowest := min(pairs)) < none:
            i = pairs.index(lowest)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    # long slices: linked parts and a heap of pairs
    end = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, -1
        if stop < n:
            left[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if left[i] >= 0:
            r = ranks.get(piece[left[i] : stop])
            if r is not None:
                heapq.heappush(heap, (r, left[i], i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Ids of many texts at once."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.lengths = token_bytes(path)[2]
        self.memory = SliceMemory(lambda pieces: [merge_slice(p, ranks) for p in pieces])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their end within the ids per text); ``raw`` is UTF-8, ``offsets`` bounds the texts."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        buffer = raw.tobytes()
        points = np.frombuffer(buffer.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at_byte = np.flatnonzero((raw & 0xC0) != 0x80)  # byte position of every code point
        doc_starts = np.searchsorted(at_byte, offsets[:-1][offsets[:-1] < offsets[1:]])
        starts = at_byte[np.flatnonzero(slice_starts(points, doc_starts))]
        bounds = np.append(starts, len(raw)).tolist()
        memory = self.memory
        which = memory.numbers([buffer[a:b] for a, b in zip(bounds, bounds[1:])])
        counts = memory.counts[which]
        ids = memory.flat[concat_ranges(memory.begins[which], counts)]
        ends = np.append(0, np.cumsum(counts))
        return ids, ends[np.searchsorted(starts, offsets[1:])]


@functools.lru_cache(2)
def shared_encoder(path: str) -> Encoder:
    """One per Python worker, so that slices stay known from task to task."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids, ends)`` per row of ``docs``: ids as little-endian unsigned 32-bit integers, and where
    each token's bytes end in the text (same format).

    A null or empty text has no ids. Ids of rows are not asked to be distinct or set; other columns are ignored.
    ``path`` is the rank file, readable on every executor. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            keys = batch.column("key")
            for first, end, raw, offsets in text_chunks(batch, "text"):
                ids, stops = encoder.encode(raw, offsets)
                bounds = np.append(0, stops)
                ends = np.cumsum(encoder.lengths[ids]) - np.repeat(offsets[:-1], np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, end - first), pa.array(np.diff(bounds)), binary_column(ids.astype("<u4").view(np.uint8), bounds * 4), binary_column(ends.astype("<u4").view(np.uint8), bounds * 4)],
                    names=[id_col, "n_tokens", "ids", "ends"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, ends binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, n_tokens, ids, decoded)``: the bytes of the ids, each token placed by its offset. Null ids decode to none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, begins, lengths = token_bytes(path)
        for batch in batches:
            kept = [batch.column(c) for c in (id_col, "n_tokens", "ids")]
            stops = batch.column("ends")
            for first, end, raw, offsets in text_chunks(batch, "ids"):
                ids = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
                ends = np.frombuffer(b"".join(x.as_py() or b"" for x in stops.slice(first, end - first)), "<u4").astype(np.int64)
                rows = offsets // 4
                size = lengths[ids]
                before = np.append(0, ends[:-1])[: len(ids)]
                before[rows[:-1][rows[:-1] < len(ids)]] = 0  # a text's first token
                if len(ends) != len(ids) or not np.array_equal(ends - before, size):
                    raise ValueError("offsets do not belong to these ids")
                out = flat[concat_ranges(begins[ids], size)]
                bounds = np.append(0, np.cumsum(size))[rows]
                yield pa.RecordBatch.from_arrays([*(k.slice(first, end - first) for k in kept), binary_column(out, bounds)], names=[id_col, "n_tokens", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "n_tokens", "ids", "ends").mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded binary")
