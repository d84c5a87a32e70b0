"""Rules that a match's metadata, rosters and directions of play must meet, as rows of faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Expected pitch in metres, how far it may differ, starters of a side.
PITCH, PITCH_SLACK, STARTERS = (105.0, 68.0), 0.5, 11


def direction(by_meta: Column, by_shots: Column, by_keepers: Column) -> Column:
    """Where the home side attacks: as its shots tell, else the metadata, else the keepers; null if nothing tells."""
    return F.coalesce(by_shots, by_meta, by_keepers)


def match_faults(matches: DataFrame, roster: DataFrame, directions: DataFrame, keeper: str = "GK") -> DataFrame:
    """``match_id, part, rule, severity`` of every rule that is broken.

    ``matches``: match_id, home_id, away_id, meta_home_id, length, width; ``roster``: match_id, team_id, player, started,
    position; ``directions``: match_id, period, by_meta, by_shots, by_keepers (1, -1 or null). ``part`` is match, home, away or
    the period. A null id of the metadata counts as a wrong one; a player listed twice counts once. Rosters of unknown matches
    or teams break no rule. One aggregate over the roster, one join per side; every other rule is an expression on its row.
    """

    def broken(df: DataFrame, part: Column, *rules: tuple[Column, str, str]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for c, n, s in rules]))
        return df.select("match_id", part.alias("part"), F.inline(found))

    size = [F.col(c) for c in ("length", "width")]
    absent = size[0].isNull() | size[1].isNull()
    off = (F.abs(size[0] - PITCH[0]) > PITCH_SLACK) | (F.abs(size[1] - PITCH[1]) > PITCH_SLACK)
    heads = broken(
        matches, F.lit("match"),
        (~F.col("meta_home_id").eqNullSafe(F.col("home_id")), "home team of the metadata differs", "problem"),
        (absent, "pitch size missing", "warning"), (~absent & off, "pitch of other size", "warning"),
    )
    sides = matches.select("match_id", F.inline(F.array(*[F.struct(F.lit(s).alias("part"), F.col(f"{s}_id").alias("team_id")) for s in ("home", "away")])))
    players = roster.groupBy("match_id", "team_id").agg(
        F.count_distinct("player").alias("players"),
        F.count_distinct(F.when(F.col("position") == keeper, F.col("player"))).alias("keepers"),
        F.count_distinct(F.when(F.col("started"), F.col("player"))).alias("starters"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    teams = broken(
        sides.join(players, ["match_id", "team_id"], "left"), F.col("part"),
        (n("players") == 0, "no roster", "problem"), (n("keepers") == 0, "no keeper in the roster", "problem"),
        (n("starters") != STARTERS, "not eleven starters", "warning"),
    )
    votes = [F.col(c) for c in ("by_meta", "by_shots", "by_keepers")]
    periods = broken(
        directions, F.col("period").cast("string"),
        (direction(*votes).isNull(), "no direction of play", "problem"),
        (votes[0] != votes[1], "start sides disagree with shots", "warning"), (votes[2] != votes[1], "keepers at the other goal", "warning"),
    )
    return heads.unionByName(teams).unionByName(periods)
