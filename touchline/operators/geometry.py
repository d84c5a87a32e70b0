"""Per-moment geometry over a fixed-size array of players.

A moment is one row with at most 22 players, so all of this is array expressions
inside a narrow stage: no explode, no shuffle, no pairwise join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Logistic time-to-intercept model (seconds, metres per second).
REACTION_S, DEFAULT_SPEED, MIDPOINT_S, SCALE_S = 0.7, 8.0, 1.5, 0.5
# Hole and free radii (metres), grid relative to the back line.
HOLE_R, FREE_R = 8.0, 5.0
GRID_X0, GRID_X1, GRID_Y0, GRID_Y1 = -20, 70, -34, 34
EDGE_EPS = 1e-9


def outfield(players: Column, team: Column) -> Column:
    return F.filter(players, lambda p: (p["team"] == team) & ~p["gk"])


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def intercept_chance(distance: Column, vmax: Column | float = DEFAULT_SPEED) -> Column:
    """Chance that a defender at ``distance`` gets to the ball in time."""
    ttc = F.lit(REACTION_S) + distance / vmax
    return F.lit(1.0) / (F.lit(1.0) + F.exp((ttc - MIDPOINT_S) / SCALE_S))


def pressure(defenders: Column, bx: Column, by: Column) -> Column:
    """Array of struct(c, order, entity): one contribution per defender, standing, at the default speed."""
    return F.transform(
        defenders,
        lambda p: F.struct(
            intercept_chance(dist(p["x"], p["y"], bx, by)).alias("c"),
            (-p["entity"]).alias("order"),
            p["entity"].alias("entity"),
        ),
    )


def any_of(chances: Column) -> Column:
    return F.lit(1.0) - F.aggregate(chances, F.lit(1.0), lambda a, c: a * (F.lit(1.0) - c["c"]))


def sorted_by_depth(players: Column, goal_x: Column) -> Column:
    """struct(d, y, x) ordered from the deepest player outwards."""
    return F.array_sort(
        F.transform(players, lambda p: F.struct(F.abs(goal_x - p["x"]).alias("d"), p["y"].alias("y"), p["x"].alias("x")))
    )


def field(a: Column, name: str) -> Column:
    return F.transform(a, lambda p: p[name])


def spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def widest_step(values: Column) -> Column:
    """Largest difference between neighbours of the sorted values."""
    s = F.array_sort(values)
    n = F.size(s)
    steps = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: b - a)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.array_max(steps))


def nearest_k(players: Column, bx: Column, by: Column, k: int) -> Column:
    tagged = F.transform(
        players,
        lambda p: F.struct(dist(p["x"], p["y"], bx, by).alias("d"), p["entity"].alias("entity"), p["x"].alias("x"), p["y"].alias("y")),
    )
    return F.slice(F.array_sort(tagged), 1, k)


def diameter(points: Column) -> Column:
    """Largest pairwise distance of a small fixed-size group (k <= 11)."""
    return F.array_max(
        F.transform(points, lambda a: F.array_max(F.transform(points, lambda b: dist(a["x"], a["y"], b["x"], b["y"]))))
    )


def hull_edges(points: Column) -> Column:
    """Directed hull edges: pairs with every other point on the left (points <= 11)."""

    def edges_from(a):
        def is_edge(b):
            return ((a["x"] != b["x"]) | (a["y"] != b["y"])) & F.forall(
                points,
                lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]) >= -EDGE_EPS,
            )

        return F.transform(
            F.filter(points, is_edge),
            lambda b: F.struct(
                a["x"].alias("ax"), a["y"].alias("ay"), (b["x"] - a["x"]).alias("ex"), (b["y"] - a["y"]).alias("ey")
            ),
        )

    return F.flatten(F.transform(points, edges_from))


def in_hull(edges: Column, x: Column, y: Column) -> Column:
    return F.forall(edges, lambda e: e["ex"] * (y - e["ay"]) - e["ey"] * (x - e["ax"]) >= -EDGE_EPS)


def block_moments(m: DataFrame, min_players: int = 3) -> DataFrame:
    """Defending block relative to its back line: defenders ``d``, opponents ``o``, hull ``edges``."""
    team = F.lit(1) - F.col("poss")
    sign = F.when(team == 0, F.lit(1.0)).otherwise(F.lit(-1.0))

    def own(side: Column) -> Column:
        return F.transform(
            outfield(F.col("players"), side),
            lambda p: F.struct(p["entity"].alias("entity"), (p["x"] * sign).alias("x"), (p["y"] * sign).alias("y")),
        )

    rel = lambda a: F.transform(
        a, lambda p: F.struct(p["entity"].alias("entity"), (p["x"] - F.col("back_x")).alias("x"), p["y"].alias("y"))
    )
    return (
        m.select("frame", "label", team.alias("team"), own(team).alias("d0"), own(F.col("poss")).alias("o0"))
        .where(F.size("d0") >= min_players)
        .withColumn("back_x", mean(F.slice(F.array_sort(field(F.col("d0"), "x")), 1, 4)))
        .select("frame", "label", "team", "back_x", rel(F.col("d0")).alias("d"), rel(F.col("o0")).alias("o"))
        .withColumn("edges", hull_edges(F.col("d")))
    )


def free_players(opponents: Column, defenders: Column, edges: Column) -> Column:
    """Opponents inside the block with no defender within the free radius."""
    r2 = FREE_R * FREE_R
    return F.filter(
        opponents,
        lambda o: in_hull(edges, o["x"], o["y"])
        & F.forall(
            defenders,
            lambda p: (p["x"] - o["x"]) * (p["x"] - o["x"]) + (p["y"] - o["y"]) * (p["y"] - o["y"]) > r2,
        ),
    )


def spread_out(df: DataFrame, key: str = "frame") -> DataFrame:
    """Spread rows that are small to read but costly to evaluate over all cores.

    A scan split holds far too many such rows for one task; later grouping by the same
    key reuses this partitioning.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key)


def block_columns(b: DataFrame) -> DataFrame:
    """One row per grid column crossed by the block: cells ``inside`` it and the ``holes`` among them.

    Clipping the hull column by column replaces a test per grid cell by a test per
    column and edge, and each defender covers one interval of a column, so holes are
    what the intervals leave.  A column outside the hull keeps an empty list.
    """
    lo = F.greatest(F.floor(F.array_min(field(F.col("d"), "x"))), F.lit(GRID_X0)).cast("int")
    hi = F.least(F.floor(F.array_max(field(F.col("d"), "x"))), F.lit(GRID_X1 - 1)).cast("int")
    xc = F.col("ix") + F.lit(0.5)

    def cut(e):
        return e["ay"] + (e["ey"] * (xc - e["ax"]) - EDGE_EPS) / e["ex"]

    up = F.filter(F.col("edges"), lambda e: e["ex"] > 0)
    down = F.filter(F.col("edges"), lambda e: e["ex"] < 0)
    flat = F.filter(F.col("edges"), lambda e: e["ex"] == 0)
    low = F.ceil(F.array_max(F.transform(up, cut)) - 0.5)
    high = F.floor(F.array_min(F.transform(down, cut)) - 0.5)
    ok = F.forall(flat, lambda e: -e["ey"] * (xc - e["ax"]) >= -EDGE_EPS)
    none = F.array().cast("array<int>")

    def cells(a, z):
        a, z = F.greatest(a, F.lit(GRID_Y0)).cast("int"), F.least(z, F.lit(GRID_Y1 - 1)).cast("int")
        return F.when(a <= z, F.sequence(a, z)).otherwise(none)

    def reach(p):
        return F.sqrt(F.lit(HOLE_R * HOLE_R) - (p["x"] - xc) * (p["x"] - xc))

    near = F.filter(F.col("d"), lambda p: F.abs(p["x"] - xc) <= HOLE_R)
    covered = F.transform(near, lambda p: cells(F.ceil(p["y"] - reach(p) - 0.5), F.floor(p["y"] + reach(p) - 0.5)))
    return (
        b.withColumn("ix", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array(lo))))
        .withColumn("inside", F.when(ok, cells(low, high)).otherwise(none))
        .withColumn("holes", F.array_except("inside", F.flatten(covered)))
        .drop("d", "o", "edges")
    )


def block_areas(b: DataFrame, *carry: str) -> DataFrame:
    """Cells inside the block and holes per moment; the grouping stays on the moment's partition."""
    return block_columns(b).groupBy("frame", "label", "team", *carry).agg(
        F.sum(F.size("inside")).alias("inside"), F.sum(F.size("holes")).alias("holes")
    )


def block_grid(b: DataFrame, keys: list[str]) -> DataFrame:
    """Times each grid cell was inside the block, and a hole, per key."""
    seen = lambda a, hole: F.transform(F.col(a), lambda iy: F.struct(iy.alias("iy"), F.lit(hole).alias("hole")))
    return (
        block_columns(b)
        .select(*keys, "ix", F.explode(F.concat(seen("inside", 0), seen("holes", 1))).alias("c"))
        .groupBy(*keys, "ix", F.col("c.iy").alias("iy"))
        .agg(F.sum(F.lit(1) - F.col("c.hole")).alias("inside"), F.sum("c.hole").alias("holes"))
    )
