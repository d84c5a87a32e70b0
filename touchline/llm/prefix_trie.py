"""Tries of conversations by halving the depth.

A trie of height 2^k is cut at half its depth: the upper half is a trie of height 2^(k-1), and below every cut prefix hangs
a forest of that height. All tries of one height are handled in the same round, so a trie of any depth takes as many
rounds as its depth has binary digits:

* going up in size, the turns of a block of 2^k places get one name from the names of its halves;
* going down, a cut prefix is named by the root of its trie and the block between, and is the root of what hangs below;
* going up again, what a cut prefix has below it in its forest is grafted onto its ancestors in the upper half.

Names are 128 bits of SHA-256. No round gathers a conversation or a node's members: rows are (conversation, place).
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.mixing import word_count
from touchline.llm.ordered import digests, with_places
from touchline.llm.tables import written

#: Places of a conversation that stay together in a join, and parts of a node's children.
SPAN, PARTS = 4096, 64
ROOT = hashlib.sha256(b"root").digest()[:16]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _name(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, name, words)`` by turn (null first), role and text; null roles and texts are empty, rows without a
    ``conv_id`` are left out. Equal rows are turns of their own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role, text)
    coarse = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 16)]
    placed = with_places(rows, "conv_id", coarse, [F.col("role"), F.col("text")])
    name = _name(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    return placed.select("conv_id", "place", name.alias("name"), word_count(F.col("text")).cast("bigint").alias("words"))


def _spans(convs: DataFrame, length: str) -> DataFrame:
    """A row per ``SPAN`` places of each conversation, for joins that no long conversation may pile up in."""
    return convs.withColumn("span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"{length} DIV {SPAN}"))))


def share_heads(turns: DataFrame, base: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``shared`` turns are those of conversation ``base`` instead of their own.

    ``turns`` is as ``numbered_turns`` gives it. Returns ``(conv_id, place, name, words)`` and ``(conv_id, length)``, the latter
    also of conversations that are left without a turn. A base with fewer turns gives all it has, an absent one none.
    """
    lengths = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    plan = lengths.select("conv_id", "n", base.alias("base"), shared.cast("bigint").alias("shared"))
    plan = plan.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("had")), "base", "left")
    plan = written(plan.withColumn("taken", F.least("shared", F.coalesce("had", F.lit(0)))), "plan")
    own = turns.withColumn("span", F.expr(f"place DIV {SPAN}")).join(_spans(plan, "n"), ["conv_id", "span"]).where("place >= shared")
    own = own.select("conv_id", (F.col("place") - F.col("shared") + F.col("taken")).alias("place"), "name", "words")
    heads = turns.withColumn("span", F.expr(f"place DIV {SPAN}")).withColumnRenamed("conv_id", "base")
    heads = heads.join(_spans(plan.select("conv_id", "base", "taken"), "taken"), ["base", "span"]).where("place < taken").select("conv_id", "place", "name", "words")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))
    return written(own.union(heads), "turns"), plan.select("conv_id", length.alias("length"))


def _prefixes(turns: DataFrame, rounds: int) -> DataFrame:
    """``(conv_id, depth, node)``: the name of every prefix of one turn or more."""
    blocks = [turns.select("conv_id", F.col("place").alias("block"), "name")]
    for _ in range(rounds):
        halves = [F.max(F.when(F.col("block") % 2 == k, F.col("name"))).alias(f"half{k}") for k in (0, 1)]
        both = blocks[-1].groupBy("conv_id", F.expr("block DIV 2").alias("block")).agg(*halves).where("half0 IS NOT NULL AND half1 IS NOT NULL")
        blocks.append(written(both.select("conv_id", "block", _name(F.concat("half0", "half1")).alias("name")), "blocks"))
    named: list[DataFrame] = []
    for level in reversed(range(rounds + 1)):
        size = 1 << level
        cut = blocks[level].where("block % 2 = 0").select("conv_id", (F.col("block") * size).alias("above"), (F.col("block") * size + size).alias("depth"), "name")
        tops = cut.where("above = 0").select("conv_id", "depth", _name(F.concat(F.lit(ROOT), "name")).alias("node"))
        if named:
            roots = functools.reduce(DataFrame.union, named).select("conv_id", F.col("depth").alias("above"), F.col("node").alias("root"))
            lower = cut.where("above > 0").join(roots, ["conv_id", "above"]).select("conv_id", "depth", _name(F.concat("root", "name")).alias("node"))
            tops = tops.union(lower)
        named.append(written(tops, "prefixes"))
    return functools.reduce(DataFrame.union, named)


def _grafted(sums: DataFrame, paths: DataFrame, level: int) -> DataFrame:
    """``sums`` with what hangs below the cut prefixes of tries of height 2^level added to their ancestors in the upper half."""
    half = 1 << (level - 1)
    width = min(2 * half, SPAN)
    cut = sums.where((F.col("depth") > 0) & (F.col("depth") % (2 * half) == half))
    cut = cut.select("conv_id", F.col("depth").alias("upto"), (F.col("leaves") - F.col("own_leaves")).alias("more_leaves"), (F.col("saved") - F.col("own_saved")).alias("more_saved"))
    cut = cut.where("more_leaves > 0 OR more_saved > 0")
    cut = cut.withColumn("span", F.explode(F.sequence(F.expr(f"(upto - {half}) DIV {width}"), F.expr(f"(upto - 1) DIV {width}"))))
    above = paths.select("conv_id", "depth", "node", F.expr(f"depth DIV {width}").alias("span"))
    met = cut.join(above, ["conv_id", "span"]).where(f"depth BETWEEN upto - {half} AND upto - 1")
    more = met.groupBy("node").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    out = sums.join(more, "node", "left")
    added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
    return written(out.select("node", "conv_id", "depth", "own_leaves", "own_saved", *added), "sums")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per node of the trie of conversations: every distinct sequence of first turns, the empty one included.

    Takes ``(conv_id, place, name, words)`` and ``(conv_id, length)`` as ``share_heads`` gives them. ``conv_id`` is the smallest
    member, a conversation that begins so; ``n_convs`` counts members, ``n_children`` children, ``n_leaves`` the childless
    nodes from the node on down; ``saved_tokens`` sums (members - 1) x words of the last turn from the node on down;
    ``ends_sha256`` is the digest of the ids, ascending and joined by commas, of members that end at the node. No
    conversation: no row.
    """
    deepest = lengths.agg(F.max("length")).first()[0] or 0
    rounds = max(0, deepest - 1).bit_length()
    prefixes = _prefixes(turns, rounds)
    # equal conversations count once from here on
    ends = prefixes.join(lengths.where("length > 0").withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("node", "conv_id", "depth")
    ends = written(ends.union(lengths.where("length = 0").select(F.lit(ROOT), "conv_id", "length")), "ends")
    classes = written(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("depth").alias("length")), "classes")
    spans = _spans(classes.select("conv_id", "n", "length"), "length")
    paths = prefixes.withColumn("span", F.expr(f"depth DIV {SPAN}")).join(spans, ["conv_id", "span"]).select("conv_id", "depth", "node", "n")
    paths = written(paths.union(classes.select("conv_id", F.lit(0).cast("bigint"), F.lit(ROOT), "n")), "paths")

    nodes = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("depth").alias("depth"))
    last = turns.select("conv_id", (F.col("place") + 1).alias("depth"), "words")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).alias("part")
    nodes = written(nodes.join(last, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left").select("*", part), "nodes")
    # many children of one node look their parent up part by part
    asked = nodes.where("parent IS NOT NULL").select("parent", "part").distinct()
    parents = written(asked.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent"), "parents")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(parents, ["parent", "part"], "left").join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own_leaves = (F.col("n_children") == 0).cast("bigint")
    own_saved = (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))
    nodes = written(nodes.withColumn("own_leaves", own_leaves).withColumn("own_saved", own_saved), "nodes")

    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("own_leaves").alias("l"), F.sum("own_saved").alias("s"))
    sums = nodes.join(below, "node", "left").select(
        "node", "conv_id", "depth", "own_leaves", "own_saved",
        (F.col("own_leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("own_saved") + F.coalesce("s", F.lit(0))).alias("saved"),
    )
    sums = written(sums, "sums")
    for level in range(1, rounds + 1):
        sums = _grafted(sums, paths, level)

    ids = digests(ends.select("node", "conv_id", F.col("conv_id").cast("string").cast("binary").alias("id")), "node", "conv_id", "id", b",")
    out = nodes.join(sums.select("node", "leaves", "saved"), "node").join(ids, "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, family: int = 20, most_shared: int = 4) -> DataFrame:
    """The trie of ``conversations (conv_id, turn, role, text)`` whose first turns are those of the family's first.

    Conversation c takes its first h turns from c - c % ``family``, where h = crc32(c in decimal) % ``most_shared``. Nulls, ties
    and repeated rows: see ``numbered_turns``. Texts of any length are hashed in place and travel no further; a conversation
    of any length is spread over tasks. Other columns are ignored.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared
    turns, lengths = share_heads(written(numbered_turns(conversations), "turns"), F.expr(f"conv_id - conv_id % {family}"), shared)
    return trie(turns, lengths)
