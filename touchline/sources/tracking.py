"""Tracking files: one JSON object per frame, usually bzip2-compressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.schema import BALL, TRACKING


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with ``line``, a struct that orders lines as they lie in the files.

    A row's place in its split grows with the generated id, and splits are told apart by file
    and offset, so the order needs no global numbering pass.
    """
    raw = spark.read.schema(TRACKING).json(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("row")
    )
    return raw.select("*", place.alias("line"))


def ball(df: DataFrame) -> DataFrame:
    """Add ``ball``: smoothed if it has a position, else the first raw one; height never below the ground.

    The smoothed ball is an object in some files and a one-item list in others.
    """
    b = F.from_json(F.when(F.col("ballsSmoothed").startswith("["), F.expr("substring(ballsSmoothed, 2)")).otherwise(F.col("ballsSmoothed")), BALL)
    raw = F.get("balls", F.lit(0))
    pick = F.when(b["x"].isNotNull(), b).when(raw["x"].isNotNull(), raw)
    return df.withColumn("ball", pick).withColumn(
        "ball", F.when(F.col("ball").isNotNull(), F.struct("ball.x", "ball.y", F.greatest(F.coalesce("ball.z", F.lit(0.0)), F.lit(0.0)).alias("z")))
    )


def unique_frames(df: DataFrame, *keys: str) -> DataFrame:
    """First line of every frame number."""
    keys = keys or ("frameNum",)
    rest = [c for c in df.columns if c not in (*keys, "line")]
    first = F.min_by(F.struct(*rest), F.col("line")).alias("f")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])


def positions(df: DataFrame) -> DataFrame:
    """frameNum, side, jersey, x, y: smoothed players where there are any, first mention of a jersey wins."""

    def side(name: str) -> Column:
        sm, raw = F.col(f"{name}PlayersSmoothed"), F.col(f"{name}Players")
        slim = lambda a: F.transform(a, lambda p: F.struct(p["jerseyNum"].alias("jersey"), p["x"].alias("x"), p["y"].alias("y")))
        chosen = F.coalesce(F.when(F.size(sm) > 0, slim(sm)), slim(raw), F.array().cast("array<struct<jersey:string,x:double,y:double>>"))
        known = F.filter(chosen, lambda p: p["x"].isNotNull() & p["jersey"].isNotNull())
        first = F.filter(known, lambda p, i: F.array_position(F.transform(known, lambda q: q["jersey"]), p["jersey"]) == i + 1)
        return F.transform(first, lambda p: F.struct(F.lit(name).alias("side"), p["jersey"].alias("jersey"), p["x"].alias("x"), p["y"].alias("y")))

    return df.select("frameNum", F.inline(F.concat(side("home"), side("away"))))


def embedded_events(df: DataFrame) -> DataFrame:
    """First occurrence of every game event carried on the frame lines."""
    d = df.where(F.col("game_event_id").isNotNull())
    first = F.min_by(F.struct("frameNum", "game_event"), F.col("line")).alias("e")
    d = d.groupBy(F.col("game_event_id").cast("bigint").alias("id")).agg(first)
    return d.select("id", F.col("e.frameNum").alias("first_frame"), F.col("e.game_event.game_event_type").alias("kind"), F.col("e.game_event.team_id").alias("team_id"))


def _first_mention(df: DataFrame, key: str, *fields: str) -> DataFrame:
    d = df.where(F.col("period").isNotNull() & F.col(key).isNotNull() & F.col(key.removesuffix("_id")).isNotNull())
    return d.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.min_by(F.struct(*fields), F.col("line")).alias("e"))


def game_events(df: DataFrame) -> DataFrame:
    """All fields of every game event, as on the first line with a period that mentions it; team ids lose a decimal part."""
    e = F.col("e.game_event")
    return _first_mention(df, "game_event_id", "period", "game_event").select(
        "id", e["game_event_type"].alias("kind"), e["team_id"].cast("double").cast("bigint").cast("string").alias("team_id"), e["player_name"].alias("player"),
        e["shirt_number"].alias("shirt"), e["position_group_type"].alias("position"), e["home_ball"].alias("home_ball"), e["start_frame"].alias("start_frame"),
        e["end_frame"].alias("end_frame"), F.col("e.period").alias("period"),
    )


def possession_events(df: DataFrame) -> DataFrame:
    """Every possession event as first mentioned, with its game event; the frame is its own, else the line's."""
    e = F.col("e.possession_event")
    return _first_mention(df, "possession_event_id", "frameNum", "possession_event").select(
        "id", e["possession_event_type"].alias("kind"), e["game_event_id"].alias("game_event_id"), F.coalesce(e["start_frame"], "e.frameNum").alias("frame")
    )


def strided(spark: SparkSession, path: str, every: int) -> DataFrame:
    """Every Nth frame plus every frame with a shot, decided on the raw text before any JSON is parsed."""
    lines = spark.read.text(path)
    frame = F.regexp_extract("value", r'"frameNum":\s*(\d+)', 1).cast("bigint")
    shot = F.col("value").contains('"possession_event_type":"SH"')
    kept = lines.where((frame % every == 0) | shot)
    return kept.select(F.from_json("value", TRACKING).alias("j"), shot.alias("is_shot")).select("j.*", "is_shot")
