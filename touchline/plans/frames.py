"""Per-frame geometry: pressure, shape, labels, rasters, holes.  Input: one row per frame."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators import geometry as G
from touchline.operators import raster as R
from touchline.operators.assignment import matched_distances
from touchline.operators.timeline import fit_timeline, grouped_percentile, merge_gaps, prev, runs, scan
from touchline.plans.registry import big, query, r6
from touchline.sources.driver_tables import moments, per_session

PRESSURE_SQL = """pr AS (SELECT frame, label, entity, team, qx, qy, x, y,
 1.0e0/(1.0e0+exp(((0.7e0 + sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy))/8.0e0) - 1.5e0)/0.5e0)) AS c FROM def_v),
score AS (SELECT frame, label, any_value(team) AS team, any_value(qy) AS qy, 1 - product(1-c) AS score, count(*) AS n,
 arg_max(entity, c) AS presser, max(c) AS top FROM pr GROUP BY frame, label)"""


@per_session
def pressured(spark: SparkSession, sf: str) -> DataFrame:
    """Score, strongest presser (lowest number on a tie) and defender count per frame."""
    m = moments(spark, sf).withColumn("team", F.lit(1) - F.col("poss"))
    c = m.withColumn("c", G.pressure(G.outfield(F.col("players"), F.col("team")), F.col("ball_x"), F.col("ball_y")))
    top = F.array_max("c")
    return c.where(F.size("c") > 0).select(
        "frame",
        "label",
        "team",
        "ball_y",
        G.any_of(F.col("c")).alias("score"),
        F.size("c").alias("n"),
        top["entity"].alias("presser"),
        top["c"].alias("top"),
    )


# Frame rate, oldest previous sample (seconds), quantile and least value of a player's top speed.
FRAME_RATE, LOOKBACK_S, TOP_QUANTILE, LEAST_TOP = 29.97, 0.5, 0.99, 4.0

MOVING_SQL = f"""mv AS (SELECT *, frame/{FRAME_RATE}e0 AS t, lag(frame) OVER w/{FRAME_RATE}e0 AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM def_v WINDOW w AS (PARTITION BY label, entity ORDER BY frame)),
vl AS (SELECT *, t - pt > 0 AND t - pt <= {LOOKBACK_S}e0 AS ok, (x-px)/(t-pt) AS vx, (y-py)/(t-pt) AS vy FROM mv),
tp AS (SELECT label, entity, greatest({LEAST_TOP}e0, quantile_cont(sqrt(vx*vx+vy*vy), {TOP_QUANTILE})) AS top FROM vl WHERE ok GROUP BY 1, 2),
rp AS (SELECT vl.*, x + CASE WHEN ok THEN {G.REACTION_S}e0*vx ELSE 0 END AS rx, y + CASE WHEN ok THEN {G.REACTION_S}e0*vy ELSE 0 END AS ry, coalesce(top, {G.DEFAULT_SPEED}e0) AS vmax FROM vl LEFT JOIN tp USING (label, entity)),
rc AS (SELECT frame, label, team, entity, 1.0e0/(1.0e0+exp((({G.REACTION_S}e0 + sqrt((rx-qx)*(rx-qx)+(ry-qy)*(ry-qy))/vmax) - {G.MIDPOINT_S}e0)/{G.SCALE_S}e0)) AS c FROM rp)"""


def moving_pressure(frames: DataFrame, match: str = "label", lookback: float = LOOKBACK_S) -> DataFrame:
    """Pressure per frame ``(frame, match, poss, players, ball_x, ball_y)`` from where defenders get to within the reaction time.

    A defender moves on with the velocity since the previous frame in which the team defended, if that is at most
    ``lookback`` seconds old, and reaches the ball at the own top speed: a high quantile of those velocities, at least
    ``LEAST_TOP``, or the default for a player without any. On equal chances the lowest number presses.
    """
    t = F.col("frame") / FRAME_RATE
    d = frames.select("frame", match, t.alias("t"), "ball_x", "ball_y", (1 - F.col("poss")).alias("team"), F.explode("players").alias("p"))
    d = d.where((F.col("p.team") == F.col("team")) & ~F.col("p.gk")).select("frame", match, "t", "ball_x", "ball_y", "team", "p.entity", "p.x", "p.y")
    key = [match, "team", "entity"]
    d = scan(d, fit_timeline(d, key, "frame"), was=prev(F.struct("t", "x", "y")))
    dt = F.col("t") - F.col("was.t")
    fresh = (dt > 0) & (dt <= lookback)
    for c in ("x", "y"):
        d = d.withColumn(f"v{c}", F.when(fresh, (F.col(c) - F.col(f"was.{c}")) / dt))
    speeds = d.where(F.col("vx").isNotNull()).select(*key, F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("speed"))
    top = grouped_percentile(speeds, key, "speed", {"top": TOP_QUANTILE})
    d = d.join(top, key, "left").withColumn("vmax", F.coalesce(F.greatest(F.lit(LEAST_TOP), "top"), F.lit(G.DEFAULT_SPEED)))
    reach = lambda c: F.col(c) + G.REACTION_S * F.coalesce(f"v{c}", F.lit(0.0))
    d = d.withColumn("c", G.intercept_chance(G.dist(reach("x"), reach("y"), F.col("ball_x"), F.col("ball_y")), F.col("vmax")))
    best = F.max(F.struct("c", (-F.col("entity")).alias("order"))).alias("best")
    out = d.groupBy("frame", match, "team").agg((1 - F.product(1 - F.col("c"))).alias("score"), F.count(F.lit(1)).alias("n"), best)
    return out.select("frame", match, "team", "score", "n", (-F.col("best.order")).alias("presser"), F.col("best.c").alias("contribution"))


@query("pressure_moving", f"""{MOVING_SQL} SELECT frame, label, CAST(any_value(team) AS INTEGER) AS team, round(1 - product(1-c),6) AS score, count(*) AS n, CAST(arg_max(entity, c) AS INTEGER) AS presser, round(max(c),6) AS contribution FROM rc GROUP BY frame, label""", "positions")
def pressure_moving(spark, sf):
    """The whole pressure model: reaction-time positions and each player's own top speed."""
    d = moving_pressure(moments(spark, sf))
    return d.select("frame", "label", F.col("team").cast("int").alias("team"), r6("score").alias("score"), "n", F.col("presser").cast("int").alias("presser"), r6("contribution").alias("contribution"))


MOVING_SCORE_SQL = f"{MOVING_SQL}, score AS (SELECT rc.frame, rc.label, any_value(rc.team) AS team, any_value(qy) AS qy, 1 - product(1-c) AS score, arg_max(entity, c) AS presser FROM rc JOIN ball_v ON rc.frame = ball_v.frame GROUP BY rc.frame, rc.label)"


@per_session
def moving(spark, sf):
    """Moving pressure of every frame with the ball's side position."""
    return moving_pressure(moments(spark, sf)).join(moments(spark, sf).select("frame", "ball_y"), "frame")


@query("pressure_by_label_moving", f"{MOVING_SCORE_SQL} SELECT label, count(*) AS frames, round(avg(score),6) AS mean_score, round(max(score),6) AS max_score FROM score GROUP BY label", "positions")
def pressure_by_label_moving(spark, sf):
    return moving(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("frames"), r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("max_score"))


@query("wide_pressure_moving", f"{MOVING_SCORE_SQL} SELECT frame, CASE WHEN abs(qy) > 20.4e0 THEN round(score,6) END AS wide_pressure FROM score", "positions")
def wide_pressure_moving(spark, sf):
    return moving(spark, sf).select("frame", F.when(F.abs("ball_y") > P.WIDE_Y, r6("score")).alias("wide_pressure"))


def press_spells(scores: DataFrame, match: str, threshold: float, gap: int, least: int) -> DataFrame:
    """Presses of one match's team: runs of frames at or over ``threshold``, joined over gaps under ``gap`` frames, ``least`` frames long or more.

    ``scores`` has (match, team, frame, score, presser); frames of the same team only are neighbours.  The peak is the
    highest score of a press, the earliest of equal ones, and ``presser`` who pressed then.
    """
    tl = fit_timeline(scores, [match, "team"], "frame")
    top = F.max(F.struct("score", (-F.col("frame")).alias("order"), "presser")).alias("top")
    on = F.when(F.col("score") >= threshold, 1)
    rs = runs(scores.select(match, "team", "frame", "score", "presser"), tl, on, top, name="on").where(F.col("on").isNotNull()).drop("on")
    m = merge_gaps(rs, tl, gap, True, F.max("top").alias("top")).where(F.col("end") - F.col("start") >= least)
    return m.select(match, "team", "start", "end", F.col("top.score").alias("peak"), F.col("top.presser").alias("presser"), (-F.col("top.order")).alias("peak_frame"))


PRESS_AT, PRESS_GAP, PRESS_LEAST = 0.4, 30, 10  # score, frames, frames
SPELLS_SQL = f"""{MOVING_SCORE_SQL}, sc AS (SELECT *, score >= {PRESS_AT}e0 AS on_, lag(score >= {PRESS_AT}e0) OVER w AS was FROM score WINDOW w AS (PARTITION BY label, team ORDER BY frame)),
si AS (SELECT *, sum(CASE WHEN on_ IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY label, team ORDER BY frame) AS rid FROM sc),
sr AS (SELECT label, team, rid, min(frame) AS s, max(frame) AS e FROM si WHERE on_ GROUP BY ALL),
sg AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY label, team ORDER BY s) < {PRESS_GAP} THEN 0 ELSE 1 END AS fresh FROM sr),
sk AS (SELECT *, sum(fresh) OVER (PARTITION BY label, team ORDER BY s) AS g FROM sg),
sz AS (SELECT label, team, g, min(s) AS s, max(e) AS e FROM sk GROUP BY ALL HAVING max(e) - min(s) >= {PRESS_LEAST}),
sp AS (SELECT sz.label, sz.team, s, e, max(score) AS peak, arg_max(struct_pack(p := presser, f := frame), struct_pack(a := score, b := -frame)) AS best FROM sz JOIN score c ON c.label = sz.label AND c.team = sz.team AND frame BETWEEN s AND e WHERE score >= {PRESS_AT}e0 GROUP BY ALL)"""


@query("press_spells_moving", f"""{SPELLS_SQL} SELECT label, CAST(team AS INTEGER) AS team, s AS start, e AS "end", round(peak,6) AS peak, CAST(best.p AS INTEGER) AS presser, best.f AS peak_frame FROM sp""", "positions")
def press_spells_moving(spark, sf):
    d = press_spells(moving(spark, sf), "label", PRESS_AT, PRESS_GAP, PRESS_LEAST)
    return d.select("label", F.col("team").cast("int").alias("team"), "start", "end", r6("peak").alias("peak"), F.col("presser").cast("int").alias("presser"), "peak_frame")


@query("pressure_score", f"{PRESSURE_SQL} SELECT frame, label, round(score,6) AS score, n FROM score", "positions")
def pressure_score(spark, sf):
    return pressured(spark, sf).select("frame", "label", r6("score").alias("score"), big("n").alias("n"))


@query("primary_presser", f"{PRESSURE_SQL} SELECT frame, CAST(presser AS INTEGER) AS presser, round(top,6) AS contribution FROM score", "positions")
def primary_presser(spark, sf):
    return pressured(spark, sf).select("frame", "presser", r6("top").alias("contribution"))


@query(
    "pressure_by_label",
    f"{PRESSURE_SQL} SELECT label, count(*) AS frames, round(avg(score),6) AS mean_score, round(max(score),6) AS max_score FROM score GROUP BY label",
    "positions",
)
def pressure_by_label(spark, sf):
    return pressured(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("frames"), r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("max_score")
    )


@query("wide_pressure", f"{PRESSURE_SQL} SELECT frame, CASE WHEN abs(qy) > 20.4e0 THEN round(score,6) END AS wide_pressure FROM score", "positions")
def wide_pressure(spark, sf):
    return pressured(spark, sf).select("frame", F.when(F.abs("ball_y") > P.WIDE_Y, r6("score")).alias("wide_pressure"))


@per_session
def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per frame and side: depth of the back four, length, widest gap, centre, width."""
    m = moments(spark, sf)
    two = m.withColumn("team", F.explode(F.array(F.lit(0), F.lit(1))))
    p = G.outfield(F.col("players"), F.col("team"))
    two = two.withColumn("s", G.sorted_by_depth(p, P.own_goal_x(F.col("team")))).withColumn("back", F.slice("s", 1, 4))
    d, y = G.field(F.col("s"), "d"), G.field(F.col("s"), "y")
    return two.where(F.size("s") >= 3).select(
        "frame",
        "label",
        "poss",
        "team",
        G.mean(G.field(F.col("back"), "d")).alias("depth"),
        G.spread(d).alias("length"),
        G.widest_step(G.field(F.col("back"), "y")).alias("gap"),
        G.spread(y).alias("width"),
        (G.mean(d) - P.LENGTH / 2).alias("centre"),
        F.size("s").alias("n"),
    )


SHAPE_SQL = """outf AS (SELECT frame, label, poss_team, team, entity, x, y, CASE WHEN team = 0 THEN abs(-52.5e0 - x) ELSE abs(52.5e0 - x) END AS d
 FROM positions_v WHERE entity < 22 AND NOT is_gk),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame, team ORDER BY d, y) AS r FROM outf),
back AS (SELECT *, y - lag(y) OVER (PARTITION BY frame, team ORDER BY y) AS step FROM rk WHERE r <= 4),
bk AS (SELECT frame, team, avg(d) AS depth, coalesce(max(step), 0) AS gap FROM back GROUP BY frame, team),
shp AS (SELECT o.frame, o.label, o.poss_team, o.team, b.depth, b.gap, max(d)-min(d) AS length, max(y)-min(y) AS width, avg(d)-52.5e0 AS centre, count(*) AS n
 FROM outf o JOIN bk b ON o.frame=b.frame AND o.team=b.team GROUP BY o.frame, o.label, o.poss_team, o.team, b.depth, b.gap HAVING count(*) >= 3)"""


@query("team_shape", f"{SHAPE_SQL} SELECT frame, team, round(depth,6) AS depth, round(length,6) AS inter_line, round(gap,6) AS backline_gap, n FROM shp", "positions")
def team_shape(spark, sf):
    return shapes(spark, sf).select(
        "frame", "team", r6("depth").alias("depth"), r6("length").alias("inter_line"), r6("gap").alias("backline_gap"), big("n").alias("n")
    )


@query("block_measures", f"{SHAPE_SQL} SELECT frame, team, round(depth,6) AS back_line, round(width,6) AS width, round(length,6) AS length, round(centre,6) AS centre FROM shp WHERE n >= 8", "positions")
def block_measures(spark, sf):
    return shapes(spark, sf).where(F.col("n") >= 8).select(
        "frame", "team", r6("depth").alias("back_line"), r6("width").alias("width"), r6("length").alias("length"), r6("centre").alias("centre")
    )


BLOCK_CASE = """CASE WHEN depth >= 40 THEN 'High Press' WHEN depth >= 32 THEN 'Mid Block' WHEN length <= 20 THEN 'Low Block' ELSE 'Mid Block' END"""


@query(
    "structure_label",
    f"{SHAPE_SQL} SELECT frame, team, CASE WHEN team = poss_team THEN 'In Possession' ELSE {BLOCK_CASE} END AS structure FROM shp",
    "positions",
)
def structure_label(spark, sf):
    s = labelled(spark, sf)
    return s.select("frame", "team", "structure")


@per_session
def labelled(spark, sf):
    phase = F.when(F.col("team") == F.col("poss"), "In Possession").otherwise("Organized Defense")
    return shapes(spark, sf).withColumn("structure", P.structure_label(phase, F.col("depth"), F.col("length")))


@per_session
def defending_measures(spark: SparkSession, sf: str) -> DataFrame:
    return measure_defence(moments(spark, sf))


def measure_defence(m: DataFrame) -> DataFrame:
    """Defending side per frame with its structure, pressure and five-nearest span, all from one row."""
    m = m.withColumn("team", F.lit(1) - F.col("poss"))
    p = G.outfield(F.col("players"), F.col("team"))
    m = m.withColumn("def", p)
    # columns, not nested calls: an array used inside a lambda would be rebuilt for every element
    m = m.withColumn("s", G.sorted_by_depth(F.col("def"), P.own_goal_x(F.col("team"))))
    m = m.withColumn("near", G.nearest_k(F.col("def"), F.col("ball_x"), F.col("ball_y"), 5))
    depth, length = G.mean(G.field(F.slice("s", 1, 4), "d")), G.spread(G.field(F.col("s"), "d"))
    return m.select(
        "frame",
        "label",
        "team",
        "ball_x",
        "ball_y",
        depth.alias("depth"),
        length.alias("length"),
        G.any_of(G.pressure(F.col("def"), F.col("ball_x"), F.col("ball_y"))).alias("score"),
        G.diameter(F.col("near")).alias("span"),
    ).withColumn("structure", P.block_label(F.col("depth"), F.col("length")))


ENGAGED_SQL = f"{PRESSURE_SQL}, {SHAPE_SQL}, ds AS (SELECT frame, label, team, depth, length, {BLOCK_CASE} AS structure FROM shp WHERE team <> poss_team)"


@query(
    "engaged_label",
    f"{ENGAGED_SQL} SELECT d.frame, structure, CASE WHEN score >= 0.4e0 THEN 'Engaged' ELSE 'Passive' END AS engaged FROM ds d JOIN score s ON d.frame = s.frame",
    "positions",
)
def engaged_label(spark, sf):
    d = defending_measures(spark, sf)
    return d.select("frame", "structure", P.engaged_label(F.col("structure"), F.col("score"), 0.4).alias("engaged"))


@query(
    "engaged_label_moving",
    f"{MOVING_SCORE_SQL}, {SHAPE_SQL}, ds AS (SELECT frame, {BLOCK_CASE} AS structure FROM shp WHERE team <> poss_team)"
    " SELECT d.frame, structure, CASE WHEN score >= 0.4e0 THEN 'Engaged' ELSE 'Passive' END AS engaged FROM ds d JOIN score s ON d.frame = s.frame",
    "positions",
)
def engaged_label_moving(spark, sf):
    """Engaged by the whole pressure model, not by where defenders stand."""
    d = defending_measures(spark, sf).drop("score").join(moving(spark, sf).select("frame", "score"), "frame")
    return d.select("frame", "structure", P.engaged_label(F.col("structure"), F.col("score"), 0.4).alias("engaged"))


SPAN_SQL = """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy)), entity) AS r FROM def_v) q WHERE r <= 5),
span AS (SELECT a.frame, max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS span FROM near a JOIN near b ON a.frame = b.frame GROUP BY a.frame)"""


@query("marking_label", f"{SHAPE_SQL}, {SPAN_SQL} SELECT s.frame, CASE WHEN span <= 23 THEN 'Tight' ELSE 'Loose' END AS marking FROM shp s JOIN span p ON s.frame = p.frame WHERE team <> poss_team", "positions")
def marking_label(spark, sf):
    d = defending_measures(spark, sf)
    return d.select("frame", P.marking_label(F.col("structure"), F.col("span")).alias("marking"))


@query("ball_proximal_compactness", f"{SPAN_SQL} SELECT frame, round(span,6) AS bpc FROM span", "positions")
def ball_proximal_compactness(spark, sf):
    return defending_measures(spark, sf).select("frame", r6("span").alias("bpc"))


@per_session
def players_long(spark: SparkSession, sf: str) -> DataFrame:
    return moments(spark, sf).select("frame", "label", "poss", "ball_x", "ball_y", F.inline("players"))


OWN_SQL = """own AS (SELECT frame, entity, team, CASE WHEN team = 0 THEN x ELSE -x END AS ox, CASE WHEN team = 0 THEN y ELSE -y END AS oy
 FROM positions_v WHERE entity < 22 AND NOT is_gk)"""


@per_session
def own_positions(spark, sf):
    p = players_long(spark, sf).where(~F.col("gk"))
    f = P.flip(F.col("team"))
    return p.withColumn("ox", F.col("x") * f).withColumn("oy", F.col("y") * f)


@query("own_frame_flip", f"{OWN_SQL} SELECT frame, entity, round(ox,6)+0e0 AS ox, round(oy,6)+0e0 AS oy FROM own", "positions")
def own_frame_flip(spark, sf):
    return own_positions(spark, sf).select("frame", "entity", r6("ox").alias("ox"), r6("oy").alias("oy"))


LANE5_SQL = "CASE WHEN oy <= -20.16e0 THEN 'right wing' WHEN oy <= -9.16e0 THEN 'right half-space' WHEN oy <= 9.16e0 THEN 'centre' WHEN oy <= 20.16e0 THEN 'left half-space' ELSE 'left wing' END"


@query(
    "thirds_lanes",
    f"""{OWN_SQL} SELECT team, CASE WHEN ox < -17.5e0 THEN 'own' WHEN ox > 17.5e0 THEN 'final' ELSE 'middle' END AS third,
 CASE WHEN oy > 68e0/6 THEN 'left' WHEN oy < -68e0/6 THEN 'right' ELSE 'middle' END AS lane3, {LANE5_SQL} AS lane5, count(*) AS n
 FROM own GROUP BY ALL""",
    "positions",
)
def thirds_lanes(spark, sf):
    x, y = F.col("ox"), F.col("oy")
    return own_positions(spark, sf).groupBy(
        "team", P.third(x).alias("third"), P.lane3(y).alias("lane3"), P.lane5(y).alias("lane5")
    ).agg(F.count(F.lit(1)).alias("n"))


BACK_SQL = """dfn AS (SELECT frame, label, team, entity, CASE WHEN team = 0 THEN x ELSE -x END AS ox, CASE WHEN team = 0 THEN y ELSE -y END AS y FROM def_v),
opn AS (SELECT frame, label, 1-team AS team, entity, CASE WHEN team = 1 THEN x ELSE -x END AS ox, CASE WHEN team = 1 THEN y ELSE -y END AS y FROM att_v),
bl AS (SELECT frame, avg(ox) AS back_x FROM (SELECT frame, ox, row_number() OVER (PARTITION BY frame ORDER BY ox) AS r FROM dfn) q WHERE r <= 4 GROUP BY frame),
d AS (SELECT dfn.frame, label, team, entity, ox - back_x AS x, y FROM dfn JOIN bl ON dfn.frame = bl.frame),
o AS (SELECT opn.frame, label, team, entity, ox - back_x AS x, y FROM opn JOIN bl ON opn.frame = bl.frame)"""
HULL_SQL = f"""{BACK_SQL},
edges AS (SELECT a.frame, a.x AS ax, a.y AS ay, b.x - a.x AS ex, b.y - a.y AS ey FROM d a JOIN d b ON a.frame = b.frame AND a.entity <> b.entity
 JOIN d p ON p.frame = a.frame GROUP BY a.frame, a.x, a.y, b.x, b.y HAVING min((b.x-a.x)*(p.y-a.y)-(b.y-a.y)*(p.x-a.x)) >= -1e-9)"""
CELL_SQL = f"""{HULL_SQL},
box AS (SELECT frame, any_value(label) AS label, any_value(team) AS team, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d GROUP BY frame),
g AS (SELECT frame, label, team, CAST(i AS INTEGER) AS ix, CAST(j AS INTEGER) AS iy, i + 0.5e0 AS xc, j + 0.5e0 AS yc FROM box, range(-20,70) a(i), range(-34,34) b(j)
 WHERE i + 0.5e0 BETWEEN x0 - 1 AND x1 + 1 AND j + 0.5e0 BETWEEN y0 - 1 AND y1 + 1),
ins AS (SELECT g.frame, g.label, g.team, ix, iy, xc, yc FROM g JOIN edges e ON g.frame = e.frame GROUP BY ALL HAVING min(ex*(yc-ay)-ey*(xc-ax)) >= -1e-9),
cells AS (SELECT i.frame, i.label, i.team, ix, iy, min((d.x-xc)*(d.x-xc)+(d.y-yc)*(d.y-yc)) > 64 AS hole FROM ins i JOIN d ON i.frame = d.frame GROUP BY i.frame, i.label, i.team, ix, iy)"""
FREE_SQL = """oin AS (SELECT o.frame, o.label, o.team, o.entity, o.x, o.y FROM o JOIN edges e ON o.frame = e.frame GROUP BY ALL HAVING min(ex*(o.y-ay)-ey*(o.x-ax)) >= -1e-9),
free AS (SELECT f.frame, f.label, f.team, f.entity, f.x, f.y FROM oin f JOIN d ON f.frame = d.frame GROUP BY ALL HAVING min((d.x-f.x)*(d.x-f.x)+(d.y-f.y)*(d.y-f.y)) > 25)"""


@per_session
def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return G.block_moments(G.spread_out(moments(spark, sf)))


@query("zone_index", f"{BACK_SQL} SELECT frame, entity, CAST(floor(x/8) AS INTEGER) AS band, CAST((y > -20.16e0)::INT + (y > -9.16e0)::INT + (y > 9.16e0)::INT + (y > 20.16e0)::INT AS INTEGER) AS lane, CASE WHEN x >= -20 AND x < 70 THEN CAST(floor(x+20) AS INTEGER) ELSE -1 END AS cx, CASE WHEN y >= -34 AND y < 34 THEN CAST(floor(y+34) AS INTEGER) ELSE -1 END AS cy FROM o", "positions")
def zone_index(spark, sf):
    o = G.block_moments(moments(spark, sf)).select("frame", F.inline("o"))
    x, y = F.col("x"), F.col("y")
    return o.select(
        "frame", "entity", P.depth_band(x).alias("band"), P.lane5_index(y).alias("lane"),
        P.cell(x, G.GRID_X0, 90).alias("cx"), P.cell(y, G.GRID_Y0, 68).alias("cy"),
    )


@query("holes_in_block", f"{CELL_SQL} SELECT frame, team, count(*) AS inside, count(*) FILTER (hole) AS holes FROM cells GROUP BY frame, team", "positions")
def holes_in_block(spark, sf):
    return G.block_areas(blocks(spark, sf)).select("frame", "team", "inside", "holes")


@query("free_opponents", f"{HULL_SQL}, {FREE_SQL} SELECT frame, team, entity, round(x,6) AS x, round(y,6) AS y FROM free", "positions")
def free_opponents(spark, sf):
    b = blocks(spark, sf)
    free = b.select("frame", "team", F.inline(G.free_players(F.col("o"), F.col("d"), F.col("edges"))))
    return free.select("frame", "team", "entity", r6("x").alias("x"), r6("y").alias("y"))


@query("gap_cells", f"{CELL_SQL} SELECT team, ix, iy, count(*) AS inside, count(*) FILTER (hole) AS holes FROM cells GROUP BY team, ix, iy", "positions")
def gap_cells(spark, sf):
    return G.block_grid(blocks(spark, sf), ["team"])


@query("gap_summary", f"""{CELL_SQL}, {FREE_SQL},
a AS (SELECT b.frame, b.team, count(*) FILTER (hole) AS area FROM box b LEFT JOIN cells c ON b.frame = c.frame GROUP BY b.frame, b.team),
f AS (SELECT frame, count(*) AS n FROM free GROUP BY frame)
SELECT a.team, count(*) AS moments, round(avg(area),6) AS holes, round(avg(coalesce(n,0)),6) AS free FROM a LEFT JOIN f ON a.frame = f.frame GROUP BY a.team""", "positions")
def gap_summary(spark, sf):
    """Mean hole area and free opponents per team: each moment is reduced to two numbers before any grouping."""
    b = blocks(spark, sf).withColumn("free", F.size(G.free_players(F.col("o"), F.col("d"), F.col("edges"))))
    return G.block_areas(b, "free").groupBy("team").agg(
        F.count(F.lit(1)).alias("moments"), r6(F.avg("holes")).alias("holes"), r6(F.avg("free")).alias("free")
    )


@query("busiest_zone", f"""{CELL_SQL}, z AS (SELECT team, CAST((iy+0.5e0 > -20.16e0)::INT + (iy+0.5e0 > -9.16e0)::INT + (iy+0.5e0 > 9.16e0)::INT + (iy+0.5e0 > 20.16e0)::INT AS INTEGER) AS lane,
 CAST(floor((ix+0.5e0)/8) AS INTEGER) AS band, count(*) FILTER (hole) AS n FROM cells GROUP BY ALL)
SELECT team, lane, band, n AS holes FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, lane, band) AS r FROM z) q WHERE r = 1""", "positions")
def busiest_zone(spark, sf):
    return busiest(gap_cells(spark, sf), "holes")


FREE_MAP_SQL = f"""{HULL_SQL}, {FREE_SQL}, cell AS (SELECT team, CAST(floor(x) AS INTEGER) AS ix, CAST(floor(y) AS INTEGER) AS iy, count(*) AS free FROM free GROUP BY ALL)"""


@query("free_opponent_cells", f"{FREE_MAP_SQL} SELECT * FROM cell", "positions")
def free_opponent_cells(spark, sf):
    """How often an opponent stood free in each square metre, per defending side."""
    free = free_opponents(spark, sf)
    return free.groupBy("team", F.floor("x").cast("int").alias("ix"), F.floor("y").cast("int").alias("iy")).agg(F.count(F.lit(1)).alias("free"))


def busiest(cells, measure):
    """The zone of five lanes and bands of eight metres with the most of ``measure`` per team; the first of equal ones."""
    z = cells.groupBy("team", P.lane5_index(F.col("iy") + 0.5).alias("lane"), P.depth_band(F.col("ix") + 0.5).alias("band")).agg(F.sum(measure).alias("n"))
    best = z.groupBy("team").agg(F.max(F.struct("n", (-F.col("lane")).alias("l"), (-F.col("band")).alias("b"))).alias("m"))
    return best.select("team", (-F.col("m.l")).alias("lane"), (-F.col("m.b")).alias("band"), F.col("m.n").alias(measure))


@query("busiest_free_zone", f"""{FREE_MAP_SQL}, z AS (SELECT team, CAST((iy+0.5e0 > -20.16e0)::INT + (iy+0.5e0 > -9.16e0)::INT + (iy+0.5e0 > 9.16e0)::INT + (iy+0.5e0 > 20.16e0)::INT AS INTEGER) AS lane,
 CAST(floor((ix+0.5e0)/8) AS INTEGER) AS band, CAST(sum(free) AS BIGINT) AS n FROM cell GROUP BY ALL)
SELECT team, lane, band, n AS free FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, lane, band) AS r FROM z) q WHERE r = 1""", "positions")
def busiest_free_zone(spark, sf):
    return busiest(free_opponent_cells(spark, sf), "free")


HIST_SQL = """hist AS (SELECT label, CAST(least(floor((x+52.5e0)/(105.0e0/52)),51) AS INTEGER) AS ix, CAST(least(floor((y+34e0)/(68.0e0/34)),33) AS INTEGER) AS iy, CAST(count(*) AS DOUBLE) AS v
 FROM positions_v WHERE entity < 22 AND NOT is_gk GROUP BY ALL)"""
BLUR_SQL = f"""{HIST_SQL}, kr AS (SELECT k, exp(-0.5e0*k*k/(1.2e0*1.2e0)) AS w FROM range(-5,6) t(k)), kn AS (SELECT k, w/(SELECT sum(w) FROM kr) AS w FROM kr),
bx1 AS (SELECT label, p.at - k AS ix, iy, sum(v*w) AS v FROM hist h, kn, (SELECT unnest([0,1,2]) AS side) s, LATERAL (SELECT CASE side WHEN 0 THEN h.ix WHEN 1 THEN -1-h.ix ELSE 103-h.ix END AS at) p
 WHERE p.at - k BETWEEN 0 AND 51 GROUP BY ALL),
blur AS (SELECT label, ix, p.at - k AS iy, sum(v*w) AS v FROM bx1 h, kn, (SELECT unnest([0,1,2]) AS side) s, LATERAL (SELECT CASE side WHEN 0 THEN h.iy WHEN 1 THEN -1-h.iy ELSE 67-h.iy END AS at) p
 WHERE p.at - k BETWEEN 0 AND 33 GROUP BY ALL)"""


@per_session
def label_histogram(spark, sf):
    p = players_long(spark, sf).where(~F.col("gk"))
    return R.histogram(p, ["label"], F.col("x"), F.col("y"))


@query("pitch_histogram", f"{HIST_SQL} SELECT * FROM hist", "positions")
def pitch_histogram(spark, sf):
    return label_histogram(spark, sf)


@query("raster_blur", f"{BLUR_SQL} SELECT label, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(v,6) AS v FROM blur WHERE v > 1e-9", "positions")
def raster_blur(spark, sf):
    b = R.blur(label_histogram(spark, sf), ["label"], 1.2)
    return b.where(F.col("v") > 1e-9).select("label", "ix", "iy", r6("v").alias("v"))


CEIL_SQL = f"{BLUR_SQL}, lg AS (SELECT label, ix, iy, ln(1 + v*0.001e0/3e-4) AS lv FROM blur WHERE v > 1e-9), cl AS (SELECT quantile_cont(lv, 0.995) AS c FROM lg)"


@query("heat_ceiling", f"{CEIL_SQL} SELECT round(c,6) AS vmax_log FROM cl", "positions")
def heat_ceiling(spark, sf):
    return ceiling(logged(spark, sf)).select(r6("c").alias("vmax_log"))


@per_session
def logged(spark, sf):
    b = R.blur(label_histogram(spark, sf), ["label"], 1.2).where(F.col("v") > 1e-9)
    return b.select("label", "ix", "iy", R.log_scale(F.col("v") * 0.001).alias("lv"))


def ceiling(lg):
    """One number over keys x cells; equal values are counted before the percentile sees them."""
    return lg.groupBy("lv").count().agg(F.percentile("lv", 0.995, F.col("count")).alias("c"))


@query("quantise_raster", f"{CEIL_SQL} SELECT label, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(round_even(least(1.0e0, greatest(0.0e0, lv/c))*255, 0) AS INTEGER) AS q FROM lg, cl", "positions")
def quantise_raster(spark, sf):
    lg = logged(spark, sf)
    one = ceiling(lg)
    return lg.join(F.broadcast(one)).select("label", "ix", "iy", R.quantise(F.col("lv"), F.col("c")).alias("q"))


@query("space_behind_line", """q AS (SELECT frame, label, team, arg_min(x, CASE WHEN team=0 THEN x+52.5e0 ELSE 52.5e0-x END) AS line_x FROM def_v GROUP BY frame, label, team),
w AS (SELECT label, team, abs(CASE WHEN team=0 THEN -52.5e0 ELSE 52.5e0 END - line_x) AS width FROM q)
SELECT label, team, count(*) AS n, round(avg(width),6) AS width_m, round(avg(width*68),6) AS area_m2 FROM w GROUP BY label, team""", "positions")
def space_behind_line(spark, sf):
    m = moments(spark, sf).withColumn("team", F.lit(1) - F.col("poss"))
    s = G.sorted_by_depth(G.outfield(F.col("players"), F.col("team")), P.own_goal_x(F.col("team")))
    w = m.select("label", "team", F.abs(P.own_goal_x(F.col("team")) - F.element_at(s, 1)["x"]).alias("w"))
    return w.groupBy("label", "team").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("w")).alias("width_m"), r6(F.avg(F.col("w") * P.WIDTH)).alias("area_m2")
    )


@query("nearest_teammate", "SELECT frame, CAST(arg_min(entity, (x-qx)*(x-qx)+(y-qy)*(y-qy)) AS INTEGER) AS entity, round(sqrt(min((x-qx)*(x-qx)+(y-qy)*(y-qy))),6) AS dist FROM att_v GROUP BY frame", "positions")
def nearest_teammate(spark, sf):
    near = G.nearest_k(G.outfield(F.col("players"), F.col("poss")), F.col("ball_x"), F.col("ball_y"), 1)
    return moments(spark, sf).select("frame", F.element_at(near, 1).alias("n")).select("frame", F.col("n.entity").alias("entity"), r6("n.d").alias("dist"))


@query("full_team_gate", """seen AS (SELECT frame, d, row_number() OVER (PARTITION BY frame ORDER BY d) AS r, count(*) OVER (PARTITION BY frame) AS n
 FROM (SELECT frame, CASE WHEN team=0 THEN x+52.5e0 ELSE 52.5e0-x END AS d FROM def_v WHERE abs(y) <= 30) q)
SELECT frame, any_value(n) AS n_seen, CASE WHEN any_value(n) = 10 THEN round(avg(d) FILTER (r <= 4),6) END AS depth FROM seen GROUP BY frame""", "positions")
def full_team_gate(spark, sf):
    """Depth is read only when the whole team is in view."""
    m = moments(spark, sf).withColumn("team", F.lit(1) - F.col("poss"))
    seen = F.filter(G.outfield(F.col("players"), F.col("team")), lambda p: F.abs(p["y"]) <= 30)
    m = m.withColumn("s", G.sorted_by_depth(seen, P.own_goal_x(F.col("team")))).where(F.size("s") > 0)
    depth = F.when(F.size("s") == 10, r6(G.mean(G.field(F.slice("s", 1, 4), "d"))))
    return m.select("frame", big(F.size("s")).alias("n_seen"), depth.alias("depth"))


@query("homography_project", """h AS (SELECT vec_id AS frame, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(embedding[3] AS DOUBLE) AS e3 FROM embeddings),
u AS (SELECT p.frame, entity, (1+e1)*x + e2*y + 3*e3 AS a, e3*x + (1+e2)*y - 2*e1 AS b, e1*x*0.001e0 + e2*y*0.001e0 + 1 AS w FROM positions_v p JOIN h ON p.frame = h.frame WHERE entity < 22)
SELECT frame, entity, round(a/w,6) AS px, round(b/w,6) AS py, abs(a/w) <= 53.5e0 AND abs(b/w) <= 35e0 AS on_pitch FROM u""", "positions")
def homography_project(spark, sf):
    """Pixel-to-pitch projection with a 3x3 matrix per frame, carried on the frame's own row."""
    e = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    h = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("frame"), *[c.alias(f"e{i}") for i, c in enumerate(e, 1)])
    p = moments(spark, sf).select("frame", "players").join(h, "frame").select("frame", "e1", "e2", "e3", F.inline("players"))
    e1, e2, e3, x, y = (F.col(c) for c in ("e1", "e2", "e3", "x", "y"))
    w = e1 * x * 0.001 + e2 * y * 0.001 + 1
    px, py = ((1 + e1) * x + e2 * y + 3 * e3) / w, (e3 * x + (1 + e2) * y - 2 * e1) / w
    return p.select("frame", "entity", r6(px).alias("px"), r6(py).alias("py"), ((F.abs(px) <= 53.5) & (F.abs(py) <= 35.0)).alias("on_pitch"))


#: Least cost over all one-to-one matchings: players of one side in turn, by the set of the other side's players taken so far.
ASSIGNED_SQL = """RECURSIVE_d AS (SELECT a.frame, a.entity - 1 AS a, b.entity - 12 AS b, sqrt((a.x + b.x)*(a.x + b.x) + (a.y + b.y)*(a.y + b.y)) AS d
  FROM positions_v a JOIN positions_v b ON a.frame = b.frame AND a.entity BETWEEN 1 AND 10 AND b.entity BETWEEN 12 AND 21),
s AS (SELECT DISTINCT frame, 0 AS a, 0 AS taken, 0e0 AS cost, CAST(0 AS BIGINT) AS path FROM positions_v
  UNION ALL SELECT s.frame, s.a + 1, taken | (1 << d.b), min(cost + d), arg_min(path * 16 + d.b, cost + d) FROM s JOIN d ON d.frame = s.frame AND d.a = s.a AND (taken & (1 << d.b)) = 0
  GROUP BY s.frame, s.a + 1, taken | (1 << d.b)),
e AS (SELECT d.frame, CAST(d.a AS INTEGER) AS a, CAST(d.b AS INTEGER) AS b, round(d, 6) AS err FROM s JOIN d ON d.frame = s.frame AND s.a = 10 AND d.b = (path >> (4 * (9 - d.a))) & 15 WHERE d <= 8)"""


@query("assignment_error", f"{ASSIGNED_SQL}\nSELECT * FROM e", "positions")
def assignment_error(spark, sf):
    """Optimal matching of the two sides' mirrored shapes within 8 m."""
    m = moments(spark, sf)
    a, b = G.outfield(F.col("players"), F.lit(0)), G.outfield(F.col("players"), F.lit(1))
    arrays = m.select(
        "frame", G.field(a, "x").alias("ax"), G.field(a, "y").alias("ay"),
        F.transform(b, lambda p: -p["x"]).alias("bx"), F.transform(b, lambda p: -p["y"]).alias("by"),
    )
    pairs = arrays.mapInPandas(partial(matched_distances, gate=8.0), "frame bigint, a int, b int, err double")
    return pairs.select("frame", "a", "b", r6("err").alias("err"))
