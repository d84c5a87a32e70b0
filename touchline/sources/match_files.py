"""From a provider's match files to a feed, and back: event arrays and match metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.feed import Feed
from touchline.sources import feeds, sinks

# Possession-event codes that are kinds of their own, and the tag of a pressed touch.
KINDS = ("PA", "CH", "SH")
PRESSED = "P"


def toward(period: Column) -> Column:
    """-1 in periods in which the home side defends the right end, so that it always attacks towards +x; 1 if unknown."""
    return F.when(feeds.home_defends_right(period), -1).otherwise(1)


def read_feed(spark: SparkSession, events: str, metadata: str) -> Feed:
    """Feed of all matches whose event arrays and metadata lie in two folders.

    The home side is told by the event, or else by the metadata's team id; an event with neither, or without a clock, is
    left out.  Coordinates are turned so that the home side attacks towards +x in every period; a match without metadata
    keeps its own.  The first of several balls counts.  A metadata line that repeats a match is used once.
    """
    m = feeds.read_metadata(spark, metadata).withColumn("gameId", F.col("id").cast("bigint")).dropDuplicates(["gameId"])
    d = feeds.read_events(spark, events).join(m, "gameId", "left")
    game, ball = F.col("gameEvents"), F.get("ball", F.lit(0))
    home = F.coalesce(game["homeTeam"], game["teamId"].cast("string") == F.col("home_id"))
    code = F.col("possessionEvents.possessionEventType")
    kind = F.when(game["gameEventType"] == "OUT", "OUT").when(code.isin(*KINDS), code).otherwise("OTB")
    end = F.coalesce("endTime", F.col("startTime") + F.col("duration"), "startTime")
    micros = lambda c: F.round(c * 1e6).cast("bigint")
    rows = d.where(home.isNotNull() & F.col("startTime").isNotNull()).select(
        F.col("gameId").alias("match_id"), F.col("gameEventId").alias("event_id"), game["playerId"].alias("user_id"), F.when(home, 0).otherwise(1).alias("team"),
        kind.alias("kind"), game["period"].alias("period"), micros(F.col("startTime")).alias("clock_us"), micros(end).alias("end_us"),
        (ball["x"] * toward(game["period"])).alias("x"), (ball["y"] * toward(game["period"])).alias("y"),
        F.coalesce(F.col("initialTouch.initialPressureType") == PRESSED, F.lit(False)).alias("pressed"),
    )
    return Feed(rows)


def write_feed(feed: Feed, sides: DataFrame, events: str, metadata: str) -> None:
    """Files that ``read_feed`` reads back.

    ``sides`` has one row per match: ``match_id``, and whether the home side starts on the left in regular and in extra
    time (``homeTeamStartLeft``, ``startLeftExtra``).  Coordinates are written as on the pitch, so teams change ends.
    """
    d = feed.rows.join(sides.select("match_id", "homeTeamStartLeft", "startLeftExtra"), "match_id", "left")
    turn = toward(F.col("period"))
    out = F.col("kind") == "OUT"
    sinks.write_json_arrays(
        d.select(
            F.col("match_id").alias("gameId"), F.col("event_id").alias("gameEventId"), (F.col("clock_us") / 1e6).alias("startTime"), (F.col("end_us") / 1e6).alias("endTime"),
            F.struct(
                F.when(out, "OUT").otherwise("OTB").alias("gameEventType"), "period", F.col("team").cast("bigint").alias("teamId"), (F.col("team") == 0).alias("homeTeam"),
                F.col("user_id").alias("playerId"),
            ).alias("gameEvents"),
            F.struct(F.when(F.col("pressed"), PRESSED).otherwise("N").alias("initialPressureType")).alias("initialTouch"),
            F.when(F.col("kind").isin(*KINDS), F.struct(F.col("kind").alias("possessionEventType"))).alias("possessionEvents"),
            F.array(F.struct((F.col("x") * turn).alias("x"), (F.col("y") * turn).alias("y"), F.lit(0.0).alias("z"))).alias("ball"),
        ), events,
    )
    sinks.write_json_lines(
        sides.select(
            F.col("match_id").cast("string").alias("id"), F.struct(F.lit("0").alias("id")).alias("homeTeam"), F.struct(F.lit("1").alias("id")).alias("awayTeam"),
            "homeTeamStartLeft", F.col("startLeftExtra").alias("homeTeamStartLeftExtraTime"),
        ), metadata,
    )
