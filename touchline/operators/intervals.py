"""Points and the intervals that cover them, without pairing the two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dyadic(start: Column, end: Column, levels: int) -> Column:
    """Array of ``(level, slot)``: the fewest aligned blocks of 2**level ticks that fill [start, end], at most two a level.

    At each level the borders are rounded inwards; an odd border is one that the next level cannot keep, so its block is taken.
    """

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        lo = F.call_function("shiftright", start + size - 1, level)
        hi = F.call_function("shiftright", end + 1, level)
        block = lambda odd, slot: F.when((lo < hi) & (odd.bitwiseAND(F.lit(1)) == 1), F.struct(level.alias("level"), slot.alias("slot")))
        return F.array(block(lo, lo), block(hi, hi - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda b: b.isNotNull())


def least_covering(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: Column, end: Column, value: Column, name: str) -> DataFrame:
    """Add ``name``: the least ``value`` among the spans of the same key with ``start`` <= ``at`` <= ``end`` (whole numbers), or null.

    Both sides meet in a binary tree over time that is never built: a span stands in the blocks that fill it, a point in the
    one block per level that holds it.  A block keeps only its least value, found before the shuffle, so neither long
    spans nor many that overlap make more work than a few rows per span and per distinct point.  Spans that end before
    they start cover nothing; a point without key or time is covered by none.
    """
    keys = list(keys)
    s = spans.select(*keys, start.cast("bigint").alias("__s"), end.cast("bigint").alias("__e"), value.alias(name)).where(F.col("__s") <= F.col("__e"))
    longest = s.agg(F.max(F.col("__e") - F.col("__s") + 1)).first()[0] or 1
    levels = int(longest).bit_length()
    blocks = (
        s.select(*keys, name, F.explode(dyadic(F.col("__s"), F.col("__e"), levels)).alias("__b"))
        .groupBy(*keys, F.col("__b.level").alias("__level"), F.col("__b.slot").alias("__slot"))
        .agg(F.min(name).alias(name))
    )
    asked = points.select(*keys, at).distinct().withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    asked = asked.withColumn("__slot", F.call_function("shiftright", F.col(at).cast("bigint"), F.col("__level")))
    found = asked.join(blocks, [*keys, "__level", "__slot"]).groupBy(*keys, at).agg(F.min(name).alias(name))
    return points.join(found, [*keys, at], "left").select(*points.columns, name)
