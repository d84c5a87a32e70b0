"""Event feeds, rosters, metadata, match registry, and the second provider's XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.schema import EVENTS, FRAME_SET, METADATA, PROVIDER_EVENT, REGISTRY, ROSTER, TEAM

# The second provider's codes.
POSITION_CODES = {
    "TW": "GK", "IVL": "LCB", "IVR": "RCB", "IVZ": "MCB", "LV": "LB", "RV": "RB", "DLM": "LWB", "DRM": "RWB",
    "DML": "DM", "DMR": "DM", "DMZ": "DM", "ZD": "DM", "ZM": "CM", "LM": "LW", "RM": "RW", "OLM": "LW", "ORM": "RW",
    "ZO": "AM", "HL": "CF", "HR": "CF", "LA": "LW", "RA": "RW", "STZ": "CF", "STL": "CF", "STR": "CF", "ST": "CF",
}
SECTION_PERIOD = {"firstHalf": 1, "secondHalf": 2, "firstHalfExtra": 3, "secondHalfExtra": 4}
CLOCK_START = {1: 0, 2: 2700, 3: 5400, 4: 6300}
FRAME_SECONDS = 0.04


def code_map(codes: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event feed as JSON arrays, one file per match."""
    return spark.read.schema(EVENTS).option("multiLine", True).json(path)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(ROSTER).json(path)
    return r.select(
        F.col("team.id").alias("team_id"), "shirtNumber", F.col("player.id").alias("player_id"), F.col("player.nickname").alias("name"),
        (F.col("positionGroupType") == "GK").alias("gk"), "started",
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per match; frame rate and pitch size fall back to the usual values."""
    m = spark.read.schema(METADATA).json(path)
    pitch = F.get("stadium.pitches", F.lit(0))
    return m.select(
        "id", F.col("homeTeam.id").alias("home_id"), F.col("awayTeam.id").alias("away_id"), F.coalesce("fps", F.lit(29.97)).alias("fps"),
        F.coalesce(pitch["length"], F.lit(105.0)).alias("length"), F.coalesce(pitch["width"], F.lit(68.0)).alias("width"), "homeTeamStartLeft",
        F.coalesce("homeTeamStartLeftExtraTime", "homeTeamStartLeft").alias("startLeftExtra"),
    )


def home_defends_right(period: Column) -> Column:
    """+x end defended by the home side in a period, from the start sides of the regular and extra halves."""
    left = F.when(period <= 2, F.col("homeTeamStartLeft")).otherwise(F.col("startLeftExtra"))
    return F.when(period.isin(1, 3), ~left).otherwise(left)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(REGISTRY).json(path)
    return r.select(F.explode("matches").alias("m")).select("m.*")


def registry_goals(registry: DataFrame) -> DataFrame:
    g = registry.select("id", F.posexplode("goals").alias("no", "g"))
    return g.select("id", "no", F.get("g", F.lit(0)).alias("team"), F.get("g", F.lit(1)).cast("int").alias("minute"), F.get("g", F.lit(2)).alias("kind"))


def registry_matches(registry: DataFrame, found: DataFrame) -> DataFrame:
    """Match dimension.  ``found`` has ``id, keeper_swap, threshold``, worked out per match; the registry's own entries come first."""
    d = registry.join(found.withColumnRenamed("keeper_swap", "swap"), "id", "left")
    own = F.when(F.length(F.col("quirks")["keeper_swap"]) > 0, F.col("quirks")["keeper_swap"])
    return d.select(
        "id", F.col("home.name").alias("home"), F.col("away.name").alias("away"), F.coalesce(own, "swap").alias("keeper_swap"),
        F.coalesce("press_threshold_override", "threshold").alias("press_threshold"),
    )


def registry_teams(registry: DataFrame) -> DataFrame:
    """Two rows per match: side, the team's id and name."""
    two = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.id").alias("team_id"), F.col(f"{s}.name").alias("name")) for s in ("home", "away")])
    return registry.select("id", F.inline(two))


def resolve_teams(asked: DataFrame, teams: DataFrame) -> DataFrame:
    """Add side, team_id and name for every ``(id, mention)``: a side's name, else a team's name or id, the home side first."""
    names = F.array(
        F.struct(F.col("side").alias("mention"), F.lit(0).alias("order")), F.struct(F.col("name").alias("mention"), F.lit(1).alias("order")),
        F.struct(F.col("team_id").alias("mention"), F.lit(1).alias("order")),
    )
    known = teams.select("id", "side", "team_id", "name", F.inline(names)).where(F.col("mention").isNotNull())
    best = F.min(F.struct("order", (F.col("side") != "home").alias("away"), "side", "team_id", "name")).alias("t")
    known = known.groupBy("id", "mention").agg(best).select("id", "mention", "t.side", "t.team_id", "t.name")
    return asked.join(known, ["id", "mention"], "left")


def read_position_sets(spark: SparkSession, path: str) -> DataFrame:
    """Second provider's positions: one row per person and frame; speed in m/s."""
    fs = spark.read.format("xml").option("rowTag", "FrameSet").schema(FRAME_SET).load(path)
    f = fs.select(F.col("_GameSection").alias("section"), F.col("_TeamId").alias("team"), F.col("_PersonId").alias("person"), F.explode("Frame").alias("f"))
    return f.select(
        "section", code_map(SECTION_PERIOD)[F.col("section")].alias("period"), "team", "person", F.col("f._N").alias("n"),
        F.unix_micros(F.to_timestamp("f._T")).alias("t_us"), F.col("f._X").alias("x"), F.col("f._Y").alias("y"), (F.col("f._S") / 3.6).alias("speed"),
    )


def grid_error(p: DataFrame) -> DataFrame:
    """Largest deviation in seconds from the regular frame grid per person and section."""
    start = F.min(F.struct("n", "t_us"))
    k = ["section", "person"]
    s = p.groupBy(*k).agg(start.alias("s"))
    off = (F.col("t_us") - F.col("s.t_us")) / 1e6 - (F.col("n") - F.col("s.n")) * FRAME_SECONDS
    return p.join(s, k).groupBy(*k).agg(F.max(F.abs(off)).alias("max_error"), F.count(F.lit(1)).alias("frames"))


def short_id(text: Column) -> Column:
    """Stable number from the base-36 suffix of a provider id."""
    return F.conv(F.element_at(F.split(text, "-"), -1), 36, 10).cast("bigint")


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.format("xml").option("rowTag", "Team").schema(TEAM).load(path)
    p = t.select(F.col("_Role").alias("role"), F.col("_TeamId").alias("team"), F.explode("Player").alias("p"))
    pos = F.coalesce(code_map(POSITION_CODES)[F.col("p._PlayingPosition")], F.lit("CM"))
    return p.select(
        "role", "team", short_id(F.col("p._PersonId")).alias("player_id"), F.col("p._ShirtNumber").alias("shirt"), F.col("p._Shortname").alias("name"),
        pos.alias("position"), (F.col("p._Starting") == "true").alias("started"),
    )


def read_provider_events(spark: SparkSession, path: str) -> DataFrame:
    """One row per event: the first matching action element decides kind and player; tackles give a challenger."""
    e = spark.read.format("xml").option("rowTag", "Event").schema(PROVIDER_EVENT).load(path)
    tackle = F.col("TacklingGame")
    challenger = F.when(tackle["_WinnerRole"] == "withoutBallControl", tackle["_Winner"]).when(tackle["_LoserRole"] == "withoutBallControl", tackle["_Loser"])
    act = lambda kind, player, outcome: F.struct(F.lit(kind).alias("kind"), player.alias("player"), outcome.alias("outcome"))
    none = F.lit(None).cast("string")
    play_ok = F.when(F.col("Play._Evaluation").isin("successfullyCompleted", "successful"), "C").otherwise("D")
    chosen = F.coalesce(
        F.when(F.col("ShotAtGoal").isNotNull(), act("SH", F.col("ShotAtGoal._Player"), none)),
        F.when(F.col("Play").isNotNull(), act("PA", F.col("Play._Player"), play_ok)),
        F.when(F.col("OtherBallAction").isNotNull(), act("BC", F.col("OtherBallAction._Player"), none)),
        F.when(F.col("BallClaiming").isNotNull(), act("CLAIM", F.col("BallClaiming._Player"), none)),
        F.when(tackle.isNotNull(), act("CH", challenger, none)),
    )
    return e.select(F.col("_EventId").alias("event_id"), F.unix_micros(F.to_timestamp("_EventTime")).alias("t_us"), chosen.alias("a")).select("event_id", "t_us", "a.*")
