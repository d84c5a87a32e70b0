"""Near-duplicate documents: one-permutation MinHash with densification, banded buckets, star-shaped candidates.

A document's shingles are dealt to bins by their hash and each bin keeps its least one; an empty bin copies a full one in
an order of its own. Bands of bins are bucket keys. Documents with equal sets count once. In a bucket only links to its
hub are tried, so candidates grow with the bucket; the hub is the member that meets most others. What a star cannot
settle, members of a bucket that are still in different components, is tried afterwards where the sets allow a link.
Every candidate is confirmed on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.arrays import binary_column, concat_ranges, text_chunks
from touchline.llm.components import components
from touchline.llm.hashing import RangeHasher, mixed
from touchline.llm.tables import written

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: At a similarity of 0.75 a pair shares no band of three bins with a chance of about 1e-10.
BAND = 3
BANDS = BINS // BAND
#: Sets of up to SMALL shingles are looked up by prefixes instead, which is exact; sets from SMALL * 0.75 on by bands too.
SMALL = 64
PER_CENT = 75
#: Bits of a sieve of ids: 8 MB, whatever the number of ids. When it is full, more rows pass than were asked for.
SIEVE_BITS = 1 << 26

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = np.random.default_rng(11).integers(0, 2**63, WORDS + 1, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(1)
def _donors() -> np.ndarray:
    """For every bin, the order in which it looks for a full bin."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the places where texts begin and the last ends."""
    solid = ~_GAP.take(raw)
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    bound = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    touching = bound[solid[bound] & solid[bound - 1]]
    opens[touching] = True
    closes[touching - 1] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = RangeHasher(raw, seed=7, fold_case=True).of(starts, ends)
    shingles = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        shingles += words[k : k + len(shingles)] * _PLACE[k]
    shingles = mixed(shingles)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    counts = np.where(n_words < WORDS, n_words > 0, n_words - WORDS + 1)
    at = np.append(0, np.cumsum(counts))
    flat = np.empty(at[-1], np.uint64)
    for text in np.flatnonzero(n_words):
        a, b, own = first[text], first[text + 1], flat[at[text] : at[text + 1]]
        if b - a >= WORDS:
            own[:] = shingles[a : b - WORDS + 1]
            own.sort()
        else:
            own[:] = mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[WORDS : WORDS + 1] * np.array([b - a], np.uint64))
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[at[:-1][counts > 0]] = True
    return flat[new], np.append(0, np.cumsum(new))[at]


def _least_of_bins(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set, none of them empty, the least hash of each bin; an empty bin has that of the first full one in its order."""
    bins = (flat >> np.uint64(64 - BIN_BITS)).astype(np.int64) + np.repeat(np.arange(len(at) - 1) * BINS, np.diff(at))
    lead = np.flatnonzero(np.diff(bins, prepend=-1))
    least, full = np.zeros((len(at) - 1) * BINS, np.uint64), np.zeros((len(at) - 1) * BINS, bool)
    least[bins[lead]], full[bins[lead]] = flat[lead], True
    empty = np.flatnonzero(~full)
    for donors in _donors().T:
        donor = empty // BINS * BINS + donors[empty % BINS]
        found = full[donor]
        least[empty[found]] = least[donor[found]]
        empty = empty[~found]
        if not len(empty):
            break
    return least.reshape(-1, BINS)


def bucket_keys(flat: np.ndarray) -> np.ndarray:
    """The keys under which a set is looked for; none for the empty set."""
    return keys_of_sets(flat, np.array([0, len(flat)]))[0]


def keys_of_sets(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of each set, one set after the other, and the places where sets begin and the last ends."""
    n = np.diff(at)
    small, large = np.flatnonzero((n > 0) & (n <= SMALL)), np.flatnonzero(n * 100 > SMALL * PER_CENT)
    prefix = n[small] - -(-n[small] * PER_CENT // 100) + 1
    looked = mixed(flat[concat_ranges(at[small], prefix)] ^ np.uint64(0x5851F42D4C957F2D))
    least = _least_of_bins(flat[concat_ranges(at[large], n[large])], np.append(0, np.cumsum(n[large])))
    bands = least[:, : BANDS * BAND].reshape(-1, BANDS, BAND)
    banded = mixed((bands * _PLACE[:BAND]).sum(2) + np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[WORDS])
    owner = np.concatenate([np.repeat(small, prefix), np.repeat(large, BANDS)])
    keys = np.concatenate([looked, banded.ravel()])[np.argsort(owner, kind="stable")]
    return keys, np.append(0, np.cumsum(np.bincount(owner, minlength=len(n))))


def _digests(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two signed numbers of 64 bits per set."""
    sums = np.zeros((2, len(flat) + 1), np.uint64)
    for k, total in enumerate(sums):
        np.cumsum(mixed(flat ^ np.uint64((k + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)), out=total[1:])
    return (sums[:, at[1:]] - sums[:, at[:-1]]).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, hi, lo, keys)`` per row: size, 128-bit digest and bucket keys of its set. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offsets in text_chunks(batch, "text", 1 << 19):
                flat, at = shingle_sets(raw, offsets)
                keys, begins = keys_of_sets(flat, at)
                hi, lo = _digests(flat, at)
                lists = pa.ListArray.from_arrays(begins.astype(np.int32), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), pa.array(np.diff(at)), pa.array(hi), pa.array(lo), lists], names=["id", "n_shingles", "hi", "lo", "keys"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, n_shingles bigint, hi bigint, lo bigint, keys array<bigint>")


def _sieved(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows whose ``id`` is among ``asked (id)``, and few others: what need not be shuffled is left where it is.

    The ids are marked in a table of bits of fixed size, so what reaches the driver and the tasks does not grow with them.
    """
    place = F.xxhash64("id").bitwiseAND(F.lit(SIEVE_BITS - 1))
    marks = asked.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
    marks = marks.agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(SIEVE_BITS >> 6, np.int64)
    words[np.asarray(marks["word"])] = np.asarray(marks["bits"])
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def marked(places: pa.Array) -> pa.Array:
        at = np.asarray(places)
        return pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return rows.where(marked(place))


def _full_sets(docs: DataFrame) -> DataFrame:
    """``(hi, lo, shingles)``: the set's digest and its sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in text_chunks(batch, "text", 1 << 19):
                flat, at = shingle_sets(raw, offsets)
                hi, lo = _digests(flat, at)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), binary_column(flat.view(np.uint8), at * 8)], names=["hi", "lo", "shingles"])

    return docs.mapInArrow(run, "hi bigint, lo bigint, shingles binary")


def _links_of_ids(some: DataFrame, classes: DataFrame) -> DataFrame:
    """``(u, v)``: the classes ``rep`` of each id that stands at different sets, linked to one of them."""
    ranges = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("hi", "lo")]
    apart = written(some.groupBy("id").agg(*ranges).where("min_hi <> max_hi OR min_lo <> max_lo").select("id"), "repeated-ids")
    held = written(some.join(apart, "id").select("id", "hi", "lo").distinct(), "repeated-ids")
    one = held.groupBy("id").agg(F.min(F.struct("hi", "lo")).alias("a"))
    pairs = written(held.join(one, "id").select("hi", "lo", F.col("a.hi").alias("a_hi"), F.col("a.lo").alias("a_lo")).distinct(), "repeated-ids")
    ends = classes.select("hi", "lo", F.col("rep").alias("v")), classes.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), F.col("rep").alias("u"))
    return written(pairs.join(ends[0], ["hi", "lo"]).join(ends[1], ["a_hi", "a_lo"]).where("u <> v").select("u", "v"), "repeated-ids")


def _compared(pairs: DataFrame, sets: DataFrame, apart: bool = False) -> DataFrame:
    """``(u, v, linked)`` of the pairs ``(u, v)``, by their full sets; with ``apart`` also ``only_u`` and ``only_v``, what one has alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, alone, sizes = [], ([], []), ([], [])
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = x[at] == y
                common = int(both.sum())
                linked.append(100 * common >= PER_CENT * (len(x) + len(y) - common))
                if apart:
                    mine = np.ones(len(x), bool)
                    mine[at[both]] = False
                    for k, part in enumerate((x[mine], y[~both])):
                        alone[k].append(part)
                        sizes[k].append(len(part))
            flags = [batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())]
            if not apart:
                yield pa.RecordBatch.from_arrays(flags, names=["u", "v", "linked"])
                continue
            lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes[k])).astype(np.int32), pa.array(np.concatenate([*alone[k], np.zeros(0, np.uint64)]).view(np.int64))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*flags, *lists], names=["u", "v", "linked", "only_u", "only_v"])

    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint, linked boolean" + ", only_u array<bigint>, only_v array<bigint>" * apart)


def _unsettled(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``(u, v, linked)`` for members ``(key, rep, n, c, hub, hub_n)`` of a bucket in different components ``c``; pairs that
    are not linked are left out, ``linked`` is null where the full sets must tell.

    Shingles that no other member of any such bucket holds can be in no intersection. With x others of n in each set, a
    link needs min(x, x') >= 3/7 (n + n'), so one of the two has x >= 6/7 n; edited copies that miss the similarity by
    their edits so meet nobody. Where both are near the hub in size, their intersection follows from what sets them
    apart from it, within the join: no pair is made that is no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("shingles")), np.int64)
            counts = np.array([len(x.as_buffer()) // 8 for x in batch.column("shingles")])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("id")), counts)), pa.array(flat)], names=["id", "shingle"])

    held = sets.join(rest.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "shingles").mapInArrow(run, "id bigint, shingle bigint")
    alone = held.groupBy("shingle").agg(F.count("*").alias("times"), F.min("id").alias("rep")).where("times = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    rows = rest.join(alone, "rep", "left").withColumn("x", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("x") * 100 >= F.col("n") * PER_CENT).drop("alone")
    # one row per member and hub instead of one per bucket, so a pair that meets in many buckets is looked at once
    rows = written(rows.groupBy("hub", "hub_n", "rep", "n", "c", "x").agg(F.collect_list("key").alias("keys")), "members-of-hubs")
    strong = F.col("x") * 7 >= F.col("n") * 6
    kinds = rows.where(strong).groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    rows = written(rows.join(kinds, "hub").where(strong | (F.col("lo") != F.col("c")) | (F.col("hi") != F.col("c"))), "members-of-hubs")
    near = rows.where(_near_in_size("n", "hub_n")).select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    apart = written(_compared(near, sets, apart=True), "apart").select(F.col("u").alias("rep"), F.col("v").alias("hub"), F.size("only_v").alias("n_lacks"), F.concat("only_u", "only_v").alias("differs"))
    rows = rows.join(apart, ["hub", "rep"], "left")
    looking = rows.where("lo <> c OR hi <> c").alias("l")
    firm = rows.where(strong).alias("f")
    sizes = F.col("l.n") + F.col("f.n")
    # what only the hub has and what only the member has cannot be equal, so one intersection tells what they share of both
    common = F.col("l.hub_n") - F.col("l.n_lacks") - F.col("f.n_lacks") + F.size(F.array_intersect("l.differs", "f.differs"))
    linked = F.when(F.col("l.differs").isNotNull() & F.col("f.differs").isNotNull(), common * 7 >= sizes * 3)
    possible = (F.least("l.x", "f.x") * 7 >= sizes * 3) & (F.greatest("l.n", "f.n") * PER_CENT <= F.least("l.n", "f.n") * 100) & F.arrays_overlap("l.keys", "f.keys")
    met = looking.join(firm, (F.col("l.hub") == F.col("f.hub")) & (F.col("l.c") != F.col("f.c")) & possible & F.coalesce(linked, F.lit(True)))
    return met.select(F.least("l.rep", "f.rep").alias("u"), F.greatest("l.rep", "f.rep").alias("v"), linked.alias("linked")).groupBy("u", "v").agg(F.max("linked").alias("linked"))


def _stars(members: DataFrame) -> DataFrame:
    """``(key, rep, n, hub, hub_n)`` of the members ``(key, rep, n)`` of buckets with company.

    The hub of a bucket meets most others over all its buckets, the least one of those that meet as many. The members
    are shuffled by bucket, those with company by set and by bucket again; nothing is joined.
    """
    shared = members.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1")
    meets = shared.withColumn("meets", F.sum("size").over(Window.partitionBy("rep")))
    first = Window.partitionBy("key").orderBy(F.desc("meets"), "rep")
    return meets.select("key", "rep", "n", F.first("rep").over(first).alias("hub"), F.first("n").over(first).alias("hub_n"))


def _near_in_size(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * PER_CENT) & (F.col(b) * 100 >= F.col(a) * PER_CENT)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` per row: the smallest id reachable over links, itself included.

    Two documents are linked if their sets of five-word shingles have a similarity of 0.75 or more. ``id_col`` is
    bigint. Rows with equal ids are copies of one document for this purpose if their sets are equal, else linked
    through that id. A null id joins nothing: its component is null and it is kept. Null, empty and blank texts have no
    shingles and no links. Other columns are ignored.
    """
    rows = written(signatures(docs, id_col, text_col), "signatures")
    some = rows.where("n_shingles > 0 AND id IS NOT NULL")
    # a class of equal sets has a number of its own, rep: its least id may have other sets too
    classes = some.groupBy("hi", "lo").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "set-classes")
    same_id = _links_of_ids(some, classes)
    star = written(_stars(classes.select("rep", "n", F.explode("keys").alias("key"))), "stars")
    wanted = written(classes.select("hi", "lo", "rep", "least_id").join(star.select("rep").distinct(), "rep", "left_semi"), "wanted")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = _full_sets(_sieved(texts, wanted.select(F.col("least_id").alias("id"))))
    # one text of each class is read, more where ids are repeated
    sets = written(held.join(wanted, ["hi", "lo"]).dropDuplicates(["hi", "lo"]).select(F.col("rep").alias("id"), "shingles"), "full-sets")

    star = star.where("rep <> hub")
    pairs = star.where(_near_in_size("n", "hub_n")).select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v"))
    tried = written(_compared(pairs.distinct(), sets), "compared")
    links = tried.where("linked").select("u", "v").union(same_id)
    label = written(components(links), "labels")
    # a hub has met its whole bucket; what is left is settled if it is one component
    rest = star.join(label.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    bucket = Window.partitionBy("key")
    rest = written(rest.withColumns({"lo": F.min("c").over(bucket), "hi": F.max("c").over(bucket)}).where("lo <> hi").drop("lo", "hi"), "open-buckets")
    some_sets = written(_sieved(sets, rest.select(F.col("rep").alias("id")).union(rest.select("hub"))), "full-sets")
    more = written(_unsettled(rest, some_sets), "candidates")
    asked = written(more.where("linked IS NULL").select("u", "v").join(tried.select("u", "v"), ["u", "v"], "left_anti"), "candidates")
    asked = written(_compared(asked, _sieved(some_sets, asked.select(F.col("u").alias("id")).union(asked.select("v")))), "compared")
    # the labels stand for the links that they were found from
    links = label.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more.where("linked").select("u", "v")).union(asked.where("linked").select("u", "v"))
    label = written(components(links), "labels")

    label = written(label.withColumnRenamed("node", "rep").join(classes.select("rep", "hi", "lo", "least_id"), "rep"), "labels")
    ids = label.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # only rows of linked classes and of several copies may have another component than their id; a linked class has its least
    named = label.join(ids, "component").select("hi", "lo", "component_id").union(classes.where("copies > 1").select("hi", "lo", "least_id"))
    out = rows.join(named.groupBy("hi", "lo").agg(F.min("component_id").alias("component_id")), ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
