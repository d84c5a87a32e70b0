"""Match-play operators on an event timeline: live ball, losses, press-zone counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators.timeline import Timeline, highest, nxt, prev, scan

SECOND = 1_000_000


def live_flags(df: DataFrame, tl: Timeline, end: Column, gap: int, tail: int) -> DataFrame:
    """Add ``live``: play runs from one on-ball event to the next, or for ``tail`` after the touch ends.

    The next on-ball event must start within ``gap`` of this one ending, with no ball-out
    strictly between.  Overlapping stretches are covered by a running maximum of their ends.
    """
    on_ball = F.col("kind") == "OTB"
    d = scan(df, tl, __out=prev(F.col(tl.time), when=F.col("kind") == "OUT"))
    d = scan(d, tl, __n=nxt(F.struct(F.col(tl.time).alias("t"), F.col("__out").alias("o")), when=on_ball))
    joined = (F.col("__n.t") - end <= gap) & (F.col("__n.o").isNull() | (F.col("__n.o") <= end))
    until = F.when(on_ball, F.when(F.col("__n.t").isNotNull() & joined, F.col("__n.t")).otherwise(end + tail))
    d = scan(d.withColumn("live_to", until), tl, __reach=highest(F.col("live_to")))
    return d.withColumn("live", F.coalesce(F.col("__reach") > F.col(tl.time), F.lit(False))).drop("__out", "__n", "__reach")


def near_marks(df: DataFrame, tl: Timeline, mark: Column, before: int, after: int) -> Column | DataFrame:
    """Add ``masked``: within [mark - before, mark + after] of some marked row, both ends included."""
    t = F.col(tl.time)
    d = scan(df, tl, __p=prev(t, when=mark, inclusive=True), __n=nxt(t, when=mark))
    hit = F.coalesce(t - F.col("__p") <= after, F.lit(False)) | F.coalesce(F.col("__n") - t <= before, F.lit(False))
    return d.withColumn("masked", hit).drop("__p", "__n")


def in_press_zone(x: Column, defending: Column) -> Column:
    return F.abs(P.own_goal_x(defending) - x) >= P.PRESS_ZONE_DEPTH


def press_counts(df: DataFrame, zone: bool = True) -> DataFrame:
    """Rows that count for passes-per-defensive-action: ``dteam``, is_pass, is_action."""
    act = F.col("kind") == "CH"
    d = df.where(F.col("kind").isin("PA", "CH")).withColumn(
        "dteam", F.when(act, F.col("team")).otherwise(1 - F.col("team"))
    )
    if zone:
        d = d.where(in_press_zone(F.col("x"), F.col("dteam")))
    return d.withColumn("is_pass", (~act).cast("int")).withColumn("is_action", act.cast("int"))


def ppda(df: DataFrame, *keys) -> DataFrame:
    n = df.groupBy(*keys).agg(F.sum("is_pass").alias("passes"), F.sum("is_action").alias("actions"))
    return n.withColumn("ppda", F.try_divide(F.col("passes").cast("double"), F.col("actions").cast("double")))
