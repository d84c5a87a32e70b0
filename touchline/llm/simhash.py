"""SimHash near-duplicates by meeting in the middle.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the radius have a variant in
common, one that lies half way between them, so one shuffle on variants brings together all that link and no pair of
fingerprints is compared that does not meet. A variant gathers at most as many fingerprints as a ball has points (65 for a
radius of 2), whatever the size of a group of copies.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.tables import written

WORDS, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Parts of the rows of one fingerprint, so that no task gets them all.
PARTS = 64
#: Bytes of a text that are cut into words at once, and hashes that are counted at once.
PIECE_BYTES, COUNTED = 1 << 20, 1 << 16

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _shingles(raw: bytes) -> Iterator[list[int]]:
    """Hashes of the shingles of a text, in lists of bounded size."""
    at, tail, whole = 0, [], True
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE_BYTES)
        end = gap.start() if gap else len(raw)
        words = tail + raw[at:end].lower().split()
        at = end
        if len(words) >= WORDS:
            whole = False
            joined = b" ".join(words)
            ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
            begins = [0, *(e + 1 for e in ends[:-WORDS])]
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[WORDS - 1 :])]
            yield from (hashes[k : k + COUNTED] for k in range(0, len(hashes), COUNTED))
            tail = words[1 - WORDS :]
        else:
            tail = words
    if whole and tail:
        yield [xxhash.xxh64_intdigest(b" ".join(tail), SEED)]


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a text in UTF-8, unsigned: a bit is set where over half the shingles' hashes have it."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _shingles(raw):
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row, both bigint. No shuffle.

    A-Z count as a-z; a text of under three words is one shingle; one without words, an empty and a null text have the
    fingerprint zero. A text is cut into words piece by piece, so that a very long one takes little memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column("raw")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fingerprint"])

    raw = F.col(text_col).cast("string").cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), raw.alias("raw")).mapInArrow(run, "id bigint, fingerprint bigint")


def _masks(distance: int) -> list[int]:
    """All words of 64 bits with at most ``distance`` bits set, signed."""
    sets = itertools.chain.from_iterable(itertools.combinations(range(BITS), k) for k in range(distance + 1))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (sum(1 << b for b in bits) for bits in sets)]


def variants(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(variant, fingerprint)`` for every variant within half of ``radius``, an even number."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: a variant lies half way between two fingerprints")
    masks = F.explode(F.array(*[F.lit(m) for m in _masks(radius // 2)])).alias("mask")
    return distinct.select("fingerprint", masks).select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), "fingerprint")


def _near(radius: int):
    return F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius


def pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``, u < v, for all pairs of distinct fingerprints at most ``radius`` bits apart, each once."""
    met = written(variants(distinct, radius), "variants")
    left, right = met.select("variant", F.col("fingerprint").alias("u")), met.select("variant", F.col("fingerprint").alias("v"))
    return left.join(right, "variant").where("u < v").select("u", "v").distinct().where(_near(radius))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``, enough of ``pairs`` to join what they join: of the members of a variant, all of which are within the
    radius of one another, each is paired with the least."""
    least = F.min("fingerprint").over(Window.partitionBy("variant"))
    met = variants(distinct, radius).select(least.alias("u"), F.col("fingerprint").alias("v")).where("u < v")
    return met.distinct().where(_near(radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` per row: fingerprint in 16 hexadecimal digits, the smallest id reachable.

    Rows link if their fingerprints differ in at most ``radius`` bits; those of empty texts, zero, link like any other.
    Rows without an id link too and may connect others, but name no component: it is null where all rows lack an id.
    Repeated rows stay, each with the same result. Other columns are ignored.
    """
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    rows = written(fingerprints(docs, id_col, text_col).withColumn("part", part), "fingerprints")
    classes = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "fingerprint-classes")
    label = written(components(links(classes.select("fingerprint"), radius)), "labels")
    linked = classes.join(label.withColumnRenamed("node", "fingerprint"), "fingerprint")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    label = label.join(named, "component").select(F.col("node").alias("fingerprint"), "component_id")
    every = classes.join(label, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    every = written(rows.select("fingerprint", "part").distinct().join(every, "fingerprint"), "labels")
    return rows.join(every, ["fingerprint", "part"]).select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")
