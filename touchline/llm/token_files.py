"""Token ids of documents in compact binary files, written and read by Spark.

A file is a row of blocks. Block: the head ``HEAD``, then document ids, whether each is set, ids per document, the first
word of every stride, wide ids and words (see ``simple8b``), then one line feed. Files follow one another in ascending
order of document id.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.llm import simple8b
from touchline.llm.arrays import binary_column, concat_ranges, text_chunks
from touchline.llm.slices import SliceMemory
from touchline.llm.tables import written

#: Mark, documents, ids, words, wide ids.
HEAD = struct.Struct("<4sIIII")
MARK = b"S8B1"
#: Bytes of text per block, about, and blocks per file: a file is read by one task, whole.
BLOCK_BYTES = 1 << 20
BLOCKS_PER_FILE = 32
#: Bytes that separate words in every tokenizer used here.
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


#: Printable ASCII and Latin letters with a case of their own: normal forms and lower case of such strings are those of
#: their characters, so the model can be asked for their parts directly.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]+")
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"
#: The tokenizer's own parts of a string, for such strings.
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes; an odd one keeps its string whole: controls, the apostrophe, and whatever leads no plain Latin letter.
_OTHER, _LETTER, _DIGIT, _ODD = range(4)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3, 0xC4, 0xC5]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _ODD
#: The signs between these letters (times, divided by) and letters whose lower case is not plain.
_ODD_PAIRS = np.array([int.from_bytes(c.encode(), "big") for c in "\u00d7\u00f7\u0130\u0131\u017f"], np.uint16)


def byte_letters() -> dict[int, str]:
    """What stands for a character in a byte-level vocabulary: its UTF-8 bytes, unprintable ones moved past U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    letter = {b: chr(b) for b in shown} | moved
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 0x180)}


@functools.lru_cache(2)
def word_memory(path: str) -> SliceMemory:
    """Ids by the tokenizers library; special tokens' names are ordinary text.

    The library's normaliser costs many times its merges. Strings of ``_PLAIN`` characters are put into lower case and
    parts here, and each part goes to the library's model once; all others go through the whole library. A tokenizer of
    another make goes through the whole library always.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    plain = _PLAIN.fullmatch if _known_make(made) else lambda text: None
    tokenize, letters = tokenizer.model.tokenize, byte_letters()

    def encode_many(pieces: list[bytes]) -> list[list[int]]:
        out: list = []
        hard: list[tuple[int, str]] = []
        for k, piece in enumerate(pieces):
            text = piece.decode()
            if not plain(text):
                hard.append((k, text))
                out.append(None)
            elif text.isascii() and text.isalpha():
                out.append([t.id for t in tokenize(text.lower())])
            else:
                out.append([t.id for part in _PARTS.findall(text.lower()) for t in tokenize(part.translate(letters))])
        for (k, _), e in zip(hard, tokenizer.encode_batch_fast([t for _, t in hard], add_special_tokens=False)):
            out[k] = e.ids
        return out

    memory = SliceMemory(encode_many)
    memory.cuts = _known_make(made)
    return memory


def _known_make(made: dict) -> bool:
    """True for the normaliser and parts that ``_PARTS`` restates: NFC, blanks, lower case; one pattern, then bytes."""
    steps = [n["type"] for n in (made.get("normalizer") or {}).get("normalizers", [])]
    first, *rest = (made.get("pre_tokenizer") or {}).get("pretokenizers", []) or [{}]
    pattern = first.get("pattern", {}).get("Regex")
    return steps == ["NFC", "Replace", "Lowercase"] and [r["type"] for r in rest] == ["ByteLevel"] and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def ids_of_texts(raw: np.ndarray, offsets: np.ndarray, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each closed by ``end_id``; their number per text).

    Texts are cut at ASCII white space, which the tokenizer drops and across which neither its normalisation nor its
    merges reach, so a cut does not change ids. Between white space, strings of ASCII and plain Latin letters without an
    apostrophe are cut further, where the tokenizer's own parts end: between letters and others, and around digits.
    """
    n = len(offsets) - 1
    memory = word_memory(path)
    raw = _LOWER[raw] if memory.cuts else raw
    solid = ~_GAP[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    opens, closes = edge[:-1] == 1, edge[1:] == -1
    bound = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    both = bound[solid[bound] & solid[bound - 1]] if len(bound) else bound  # words that meet where two texts do
    opens[both] = True
    closes[both - 1] = True
    if memory.cuts and len(raw):
        kind = _KIND[raw]
        odd = kind == _ODD
        pair = (raw[:-1].astype(np.uint16) << 8) | raw[1:]
        odd[1:] |= np.isin(pair, _ODD_PAIRS) & (raw[1:] >= 128)
        word = np.cumsum(opens)
        whole = np.zeros(int(word[-1]) + 1, bool)
        whole[word[odd & solid]] = True
        inner = np.flatnonzero(solid[1:] & solid[:-1] & ~opens[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~whole[word[1:]])
        opens[inner + 1] = True
        closes[inner] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    buffer = raw.tobytes()
    which = memory.numbers([buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    sizes = memory.counts[which]
    words_before = np.searchsorted(starts, offsets)
    ids_before = np.append(0, np.cumsum(sizes))[words_before]
    out = np.empty(int(ids_before[-1]) + n, np.uint32)
    close_at = ids_before[1:] + np.arange(n)
    inner = np.ones(len(out), bool)
    inner[close_at] = False
    out[close_at] = end_id
    out[inner] = memory.flat[concat_ranges(memory.begins[which], sizes)]
    return out, np.diff(ids_before) + 1


def to_block(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> bytes:
    words, entries, wide = simple8b.pack(ids)
    present = np.asarray(doc_ids.is_valid()).astype(np.uint8)
    numbers = np.asarray(doc_ids.fill_null(0)).astype("<i8")
    return b"".join(
        (HEAD.pack(MARK, len(doc_ids), len(ids), len(words), len(wide)), numbers.tobytes(), present.tobytes(), counts.astype("<u4").tobytes(), entries.astype("<u4").tobytes(), wide.astype("<u8").tobytes(), words.astype("<u8").tobytes())
    )


def from_blocks(content: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, whether each is set, ids, ids per document) of every block of a file."""
    at = 0
    while at < len(content):
        mark, docs, n, n_words, n_wide = HEAD.unpack_from(content, at)
        if mark != MARK:
            raise ValueError("not a block of token ids")
        at += HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(content, kind, count, at)
            at += part.nbytes
            return part

        numbers, present, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
        take("<u4", -(-n // simple8b.STRIDE))
        wide = take("<u8", n_wide)
        yield numbers, present.astype(bool), simple8b.unpack(take("<u8", n_words), wide), counts
        at += 1  # the line feed


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all rows to ``folder``, ascending in ``id_col`` (bigint; nulls first, equal ids by text).

    A null or empty text has ``end_id`` only. Other columns are ignored. The text goes through one range shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in text_chunks(batch, "text", BLOCK_BYTES):
                ids, counts = ids_of_texts(raw, offsets, path, end_id)
                block = to_block(batch.column("key").slice(first, end - first), ids, counts)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    blocks = ordered.mapInArrow(run, "block binary")
    # the text writer copies a value's bytes as they are and ends it with a line feed
    blocks.select(F.col("block").cast("string").alias("value")).write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(folder)


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``(file, place, id_col, n_tokens, ids)`` per document of the files: ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                place = itertools.count()
                for numbers, present, ids, counts in from_blocks(memoryview(content.as_buffer())):
                    docs = len(numbers)
                    bounds = np.append(0, np.cumsum(counts, dtype=np.int64)) * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()] * docs), pa.array([next(place) for _ in range(docs)], pa.int64()), pa.array(numbers, pa.int64(), mask=~present),
                            pa.array(counts.astype(np.int64)), binary_column(ids.astype("<u4").view(np.uint8), bounds),
                        ],
                        names=["file", "place", id_col, "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, f"file string, place bigint, `{id_col}` bigint, n_tokens bigint, ids binary")


def checksums(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``read``'s rows with the unsigned CRC-32 of the ids in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "place", id_col, "n_tokens")), crc], names=["file", "place", id_col, "n_tokens", "ids_crc32"])

    return docs.mapInArrow(run, f"file string, place bigint, `{id_col}` bigint, n_tokens bigint, ids_crc32 bigint")


def with_starts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds ``start``, the ids of all documents before: within a file by a running sum, over files by their totals (one row a file)."""
    kept = written(docs, "token-files")
    totals = kept.groupBy("file").agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"), F.sum("n_tokens").alias("n"))
    files = totals.select("file", (F.sum("n").over(Window.orderBy(F.col("lo").asc_nulls_first(), F.col("hi").asc_nulls_first(), "file")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return kept.withColumn("inside", inside).join(files, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")
