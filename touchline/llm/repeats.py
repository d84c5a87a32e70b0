"""Long byte strings that occur more than once: an enhanced suffix array, sharded by anchors.

Every window of ``LENGTH`` bytes has an anchor, its least hashed gram; equal windows have equal anchors at equal places, so
only suffixes that start at equal anchors need to be sorted together. Windows in a row with one anchor form a context.
Contexts that occur twice as a whole are settled by counting. The others go, one per distinct context, to their anchor's
shard: suffixes from the anchor on are sorted, a stack scan over common prefixes walks the interval tree, and in each
interval the occurrences are told apart by what stands left of the anchor; those that agree on both sides over
``LENGTH`` bytes are a repeat, with all its occurrences. Shards that are too large are split by longer strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrays import text_chunks
from touchline.llm.hashing import RangeHasher, mixed
from touchline.llm.tables import written

LENGTH = 200
GRAM = 32
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: Contexts of one anchor that a task sorts at once; above, they are dealt out by ``BAND`` places of the anchor in the window.
SHARD = 4096
BAND = 13
BANDS = SPAN // BAND
assert BANDS * BAND == SPAN

_DOC = "key bigint, dig int"


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """``(id, carried, key, dig, text)``: a row is known by its id and a hash of its text, one without an id by 96 bits of hashes.

    Rows of one repeated id are told apart by 32 bits: unequal texts of one id that agree in them count as one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = F.struct(F.lit(0).alias("_"), *carry).alias("carried")
    return docs.select(F.col(id_col).alias("id"), carried, F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("key"), F.hash(F.col(id_col).isNull(), text).alias("dig"), text.alias("text"))


def contexts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor's hash, context's hash, anchor, first window, last window) of every context, places within ``raw``."""
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    hasher = RangeHasher(raw, seed=3)
    at = np.arange(n - GRAM + 1)
    grams = hasher.of(at, at + GRAM)
    low = np.uint64(31)  # the same for every batch, so that equal windows choose equally; a text has under 2 GB
    least = ((grams >> low) << low) | at.astype(np.uint64)  # the leftmost of equal grams
    have = 1
    while have * 2 <= SPAN:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < SPAN:
        step = SPAN - have
        least = np.minimum(least[: len(least) - step], least[step:])
    sizes = np.diff(offsets)
    doc_of = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    windows = np.arange(len(doc_of)) - np.repeat(np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0), np.maximum(sizes - LENGTH + 1, 0)) + offsets[:-1][doc_of]
    if not len(windows):
        return contexts(raw[:0], offsets[:1])
    anchor = (least[windows] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    change = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc_of[1:] != doc_of[:-1])))
    first, last = windows[change], windows[np.append(change[1:], len(windows)) - 1]
    anchor = anchor[change]
    return doc_of[change], grams[anchor], RangeHasher(raw, seed=4).of(first, last + LENGTH), anchor, first, last


def _occurrences(keyed: DataFrame) -> DataFrame:
    """``(key, dig, anchor, context, at)``; ``at`` packs the first window, the anchor's and the last window's distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in text_chunks(batch, "text", 1 << 19):
                doc, gram, context, anchor, first, last = contexts(raw, offsets)
                at = ((first - offsets[doc]) << 16) | ((anchor - first) << 8) | (last - first)
                rows = pa.array(doc + start)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("dig").take(rows), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(at)], names=["key", "dig", "anchor", "context", "at"])

    return keyed.where(F.octet_length("text") >= LENGTH).select("key", "dig", "text").mapInArrow(run, f"{_DOC}, anchor bigint, context bigint, at bigint")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def repeats_at_anchor(lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left of the anchor, bytes from the anchor on, occurrences) of every repeat of ``LENGTH`` bytes or more.

    ``lefts`` are reversed. Occurrences of an interval of the tree that agree to the left come as one group each.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    place = [0] * len(lefts)
    for k, i in enumerate(by_left):
        place[i] = k

    def groups(lo: int, hi: int, right: int) -> Iterator[tuple[int, int, list[int]]]:
        """The interval's occurrences in order of what stands left, cut where they agree on too little."""
        inside = sorted(order[lo : hi + 1], key=place.__getitem__)
        need = LENGTH - right
        group, shared = [inside[0]], LENGTH
        for a, b in zip(inside, inside[1:]):
            agree = common_prefix(lefts[a], lefts[b])
            if agree >= need:
                group.append(b)
                shared = min(shared, agree)
                continue
            if len(group) > 1:
                yield shared, right, group
            group, shared = [b], LENGTH
        if len(group) > 1:
            yield shared, right, group

    stack: list[tuple[int, int]] = []  # (common prefix, first) of open intervals
    for k in range(1, len(order) + 1):
        common = common_prefix(rights[order[k - 1]], rights[order[k]]) if k < len(order) else -1
        first = k - 1
        while stack and stack[-1][0] > common:
            right, first = stack.pop()
            if right + SPAN - 1 >= LENGTH:
                yield from groups(first, k - 1, right)
        if common > 0 and (not stack or stack[-1][0] < common):
            stack.append((common, first))


def widest(lefts: list[bytes], rights: list[bytes]) -> tuple[list[int], list[int]]:
    """How far repeats reach to the left and to the right of each occurrence's anchor; 0, 0 if none holds it.

    Repeats of one occurrence all hold its anchor, so their union is one range.
    """
    left, right = [0] * len(lefts), [0] * len(lefts)
    for _, r, group in repeats_at_anchor(lefts, rights):
        near = [common_prefix(lefts[a], lefts[b]) for a, b in zip(group, group[1:])]
        for k, i in enumerate(group):
            own = max(near[max(0, k - 1) : k + 1])
            left[i], right[i] = max(left[i], own), max(right[i], r)
    return left, right


def _wanted_contexts(docs: DataFrame) -> DataFrame:
    """Bytes of the contexts listed in ``wanted``; those of crowded anchors with a key per band of the anchor's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, dig, text, wanted in zip(batch.column("key").to_pylist(), batch.column("dig").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                hasher = None
                for w in wanted:
                    first, before, run_ = w["at"] >> 16, (w["at"] >> 8) & 255, w["at"] & 255
                    anchor = first + before
                    bands: list[int] = []
                    if w["crowded"]:
                        hasher = hasher or RangeHasher(np.frombuffer(raw, np.uint8), seed=6)
                        band = np.arange((before - run_) // BAND, before // BAND + 1)
                        keys = hasher.of(anchor - band * BAND, anchor + LENGTH - band * BAND - BAND + 1)
                        bands = mixed(keys + band.astype(np.uint64) + np.uint64(w["anchor"] % 2**64)).view(np.int64).tolist()
                    out.append((key, dig, w["at"], w["anchor"], w["many"], raw[first : first + run_ + LENGTH], bands))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["key", "dig", "at", "shard", "many", "bytes", "bands"])

    return docs.select("key", "dig", "text", "wanted").mapInArrow(run, f"{_DOC}, at bigint, shard bigint, many boolean, bytes binary, bands array<bigint>")


def _sorted_shards(rows: DataFrame) -> DataFrame:
    """``(key, dig, start, end)`` of the repeats that each shard's suffix array shows; rows ``(shard, band, ...)``, band -1: all places."""

    def settle(shard: list[tuple]) -> Iterator[tuple]:
        lefts, rights = [], []
        for _, _, at, _, band, data in shard:
            before = (at >> 8) & 255
            left, right = data[:before][::-1], data[before:]
            if band >= 0:
                left, right = left[: band * BAND + BAND - 1], right[: LENGTH - band * BAND]
            lefts.append(left)
            rights.append(right)
        for (key, dig, at, many, _, _), left, right in zip(shard, *widest(lefts, rights)):
            if right and not many:
                anchor = (at >> 16) + ((at >> 8) & 255)
                yield key, dig, anchor - left, anchor + right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["key", "dig", "start", "end"])

        shard, name, out = [], None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "dig", "at", "many", "band", "bytes")]
            for s, row in zip(batch.column("shard").to_pylist(), zip(*cols)):
                if s != name:
                    if len(shard) > 1:
                        out.extend(settle(shard))
                    shard, name = [], s
                shard.append(row)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if len(shard) > 1:
            out.extend(settle(shard))
        if out:
            yield batch_of(out)

    return rows.repartition("shard").sortWithinPartitions("shard").select("shard", "key", "dig", "at", "many", "band", "bytes").mapInArrow(run, f"{_DOC}, start bigint, end bigint")


def _single_windows(rows: DataFrame) -> DataFrame:
    """Repeated windows of shards that are crowded even within a band: counted one by one, nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "dig", "at", "many", "band", "bytes")]
            for key, dig, at, many, band, data in zip(*cols):
                first, before, run_ = at >> 16, (at >> 8) & 255, at & 255
                raw = np.frombuffer(data, np.uint8)
                start = np.arange(max(0, before - band * BAND - BAND + 1), min(run_, before - band * BAND) + 1)
                hi, lo = (RangeHasher(raw, seed=s).of(start, start + LENGTH).view(np.int64) for s in (8, 9))
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([dig] * n, pa.int32()), pa.array(start + first), pa.array([many] * n, pa.bool_()), pa.array(hi), pa.array(lo)], names=["key", "dig", "start", "many", "hi", "lo"])

    windows = rows.select("key", "dig", "at", "many", "band", "bytes").mapInArrow(run, f"{_DOC}, start bigint, many boolean, hi bigint, lo bigint")
    twice = windows.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo")
    return windows.where(~F.col("many")).join(twice, ["hi", "lo"]).select("key", "dig", "start", (F.col("start") + LENGTH).alias("end"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``(id, carried, text, spans)`` per row: the ranges ``(start, end)`` of UTF-8 bytes that strings of ``LENGTH`` bytes cover
    which also start anywhere else in ``docs``, the same text included; sorted, merged, never touching.

    Overlaps count. A null or empty text has no spans and comes back empty. Null and repeated ids are allowed: rows are
    told apart by id and text, and equal rows repeat each other. Equality is that of 128-bit hashes where contexts are
    counted, and of bytes in the shards. ``carried`` is a struct of the columns named in ``carry``.
    """
    keyed = _keyed(docs, id_col, text_col, carry)
    seen = _occurrences(keyed)
    anchors = seen.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1")
    anchors = written(anchors.select("anchor", (F.col("a") != F.col("b")).alias("varied")), "anchors")
    shared = written(seen.join(anchors, "anchor"), "anchors")  # both sides come from shuffles, so Spark can split a hot anchor
    kinds = shared.where("varied").groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "dig", "at")).alias("one"))
    kinds = written(kinds, "contexts")
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > SHARD).select("anchor", F.lit(True).alias("crowded"))
    # what is repeated as a whole, and one occurrence of each context that may be repeated in part
    whole = shared.where("NOT varied").select("key", "dig", "at").union(shared.where("varied").join(kinds.where("n > 1").select("anchor", "context"), ["anchor", "context"]).select("key", "dig", "at"))
    first = F.shiftright("at", 16)
    whole = whole.select("key", "dig", F.struct(first.alias("start"), (first + F.col("at").bitwiseAND(255) + LENGTH).alias("end")).alias("span"), F.lit(None).cast("struct<at:bigint,anchor:bigint,many:boolean,crowded:boolean>").alias("want"))
    want = kinds.join(crowd, "anchor", "left").select(
        F.col("one.key").alias("key"), F.col("one.dig").alias("dig"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"),
        F.struct(F.col("one.at").alias("at"), "anchor", (F.col("n") > 1).alias("many"), F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("want"),
    )
    notes = whole.union(want).groupBy("key", "dig").agg(F.collect_list("span").alias("spans"), F.collect_list("want").alias("wanted"))
    noted = keyed.join(notes, ["key", "dig"], "left")

    # documents with contexts in question are kept as they are; the others need their text once more only
    texts = written(noted, "noted-texts")
    asked = texts.where(F.size("wanted") > 0)
    pieces = written(_wanted_contexts(asked.dropDuplicates(["key", "dig"])), "pieces")
    plain = pieces.where(F.size("bands") == 0).select("shard", "key", "dig", "at", "many", F.lit(-1).alias("band"), "bytes")
    banded = pieces.where(F.size("bands") > 0).select("key", "dig", "at", F.posexplode("bands").alias("nth", "shard"))
    sizes = banded.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
    lowest = F.floor((F.shiftright("at", 8).bitwiseAND(255) - F.col("at").bitwiseAND(255)) / BAND)
    banded = banded.join(sizes, "shard").join(pieces.select("key", "dig", "at", "many", "bytes"), ["key", "dig", "at"]).withColumn("band", (lowest + F.col("nth")).cast("int"))
    banded = written(banded.select("shard", "key", "dig", "at", "many", "band", "bytes", "size"), "crowded")
    found = _sorted_shards(plain.union(banded.where(F.col("size") <= SHARD).drop("size"))).union(_single_windows(banded.where(F.col("size") > SHARD)))
    more = found.groupBy("key", "dig").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    settled = texts.where(F.coalesce(F.size("wanted"), F.lit(0)) <= 0).select("id", "carried", "text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))
    rest = asked.join(more, ["key", "dig"], "left").select("id", "carried", "text", F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"))
    return settled.union(rest)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``(id_col, carry..., n_bytes, n_removed, n_spans, kept)`` per row: ``kept`` is what is left of the text, as bytes.

    A cut may fall inside a character; ``kept`` need not be valid UTF-8. See ``repeated_spans`` for nulls and ties.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                spans = _merged(spans)
                parts, at = [], 0
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in spans))
                counts.append(len(spans))
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("carried"), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary())], names=["id", "carried", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = repeated_spans(docs, id_col, text_col, carry)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "carried")}
    cut = rows.mapInArrow(run, f"id {kinds['id']}, carried {kinds['carried']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return cut.select(F.col("id").alias(id_col), *(F.col("carried")[c].alias(c) for c in carry), "n_bytes", "n_removed", "n_spans", "kept")
