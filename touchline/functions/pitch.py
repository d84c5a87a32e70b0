"""Pitch geometry labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch size, thresholds and edges in metres and seconds.
LENGTH, WIDTH = 105.0, 68.0
THIRD_X = LENGTH / 6
LANE3_Y = WIDTH / 6
LANE_EDGES = (-20.16, -9.16, 9.16, 20.16)
LANES = ("right wing", "right half-space", "centre", "left half-space", "left wing")
HIGH_DEPTH, MID_DEPTH, LOW_LENGTH = 40.0, 32.0, 20.0
TIGHT_SPAN = 23.0
WIDE_Y = 20.4
PRESS_ZONE_DEPTH = 35.0
BAND = 8
ORGANISED = ("High Press", "Mid Block", "Low Block")


def flip(team: Column) -> Column:
    """Multiplier into a team's own frame: team 0 defends -x, team 1 defends +x."""
    return F.when(team == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def own_goal_x(team: Column) -> Column:
    return F.when(team == 0, F.lit(-LENGTH / 2)).otherwise(F.lit(LENGTH / 2))


def third(x: Column) -> Column:
    return F.when(x < -THIRD_X, "own").when(x > THIRD_X, "final").otherwise("middle")


def lane3(y: Column) -> Column:
    """Attacker's view: +y is the left side."""
    return F.when(y > LANE3_Y, "left").when(y < -LANE3_Y, "right").otherwise("middle")


def lane5_index(y: Column) -> Column:
    """0..4 from -y to +y; a point on an edge belongs to the lower lane."""
    return sum(((y > e).cast("int") for e in LANE_EDGES), F.lit(0))


def lane5(y: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in LANES]), lane5_index(y) + 1)


def depth_band(x: Column) -> Column:
    return F.floor(x / BAND).cast("int")


def cell(v: Column, low: int, size: int) -> Column:
    """Grid index of a coordinate, -1 outside the grid."""
    i = F.floor(v - low)
    return F.when((i >= 0) & (i < size), i).otherwise(F.lit(-1)).cast("int")


def block_label(depth: Column, length: Column) -> Column:
    """Block height from back-line depth, with the length gate for a low block."""
    return (
        F.when(depth.isNull(), None)
        .when(depth >= HIGH_DEPTH, "High Press")
        .when(depth >= MID_DEPTH, "Mid Block")
        .when(length <= LOW_LENGTH, "Low Block")
        .otherwise("Mid Block")
    )


def structure_label(phase: Column, depth: Column, length: Column) -> Column:
    """Only organised defence gets a block label; other phases pass through."""
    return F.when(phase == "Organized Defense", block_label(depth, length)).otherwise(phase)


def engaged_label(structure: Column, pressure: Column, threshold: float) -> Column:
    return F.when(
        structure.isin(*ORGANISED) & pressure.isNotNull(),
        F.when(pressure >= threshold, "Engaged").otherwise("Passive"),
    )


def marking_label(structure: Column, span: Column) -> Column:
    return F.when(
        structure.isin(*ORGANISED) & span.isNotNull(),
        F.when(span <= TIGHT_SPAN, "Tight").otherwise("Loose"),
    )


def game_state(goal_diff: Column) -> Column:
    return F.when(goal_diff > 0, "leading").when(goal_diff < 0, "trailing").otherwise("level")
