"""Time-series operators over the event stream: as-of, windows, runs, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators import play
from touchline.operators.timeline import (
    absorb_short_runs, asof_join, lerp_fill, merge_gaps, nxt, prev, row_index, runs, scan, trailing,
)
from touchline.plans.registry import big, query, r6
from touchline.sources.driver_tables import feed, per_session, stream, stream_axis, stream_frames

S = play.SECOND
SLIM = ("event_id", "match_id", "period", "team", "kind", "clock_us", "value")  # all a stacked scan needs to carry


@query("stream_frame_index", "SELECT event_id, match_id, frame FROM stream_v", "stream")
def stream_frame_index(spark, sf):
    """Frame numbers of the stream: a running count per match."""
    return stream_frames(spark, sf).select("event_id", "match_id", "frame")


@query("asof_possession", """otb AS (SELECT match_id, clock_us, event_id AS oid, CASE WHEN value > 60 THEN NULL ELSE team END AS oteam FROM stream_v WHERE kind = 'OTB'
 QUALIFY row_number() OVER (PARTITION BY match_id, clock_us ORDER BY event_id DESC) = 1)
SELECT s.event_id, oid AS otb_id, oteam AS otb_team FROM stream_v s ASOF LEFT JOIN otb ON s.match_id = otb.match_id AND s.clock_us >= otb.clock_us WHERE s.kind <> 'OTB'""", "stream")
def asof_possession(spark, sf):
    """Team of the last on-ball event; an event with no team gives no team, not the one before it.

    On-ball events of the same time count, whatever their ids; of several at one time, the one with the greatest id is the last.
    """
    team = F.when(F.col("value") > 60, None).otherwise(F.col("team"))
    last = F.struct(F.col("event_id").alias("otb_id"), team.alias("otb_team"))
    s = stream(spark, sf).withColumn("off", F.col("kind") != "OTB")
    d = scan(s, stream_axis(spark, sf).on("clock_us", "off", "event_id"), o=prev(last, when=~F.col("off")))
    return d.where("off").select("event_id", "o.otb_id", "o.otb_team")


@query("asof_nearest_tol", """pa AS (SELECT match_id, clock_us, event_id AS pid FROM stream_v WHERE kind = 'PA'), sh AS (SELECT match_id, clock_us, event_id FROM stream_v WHERE kind = 'SH'),
b AS (SELECT sh.event_id, sh.clock_us - pa.clock_us AS gap, pid FROM sh ASOF LEFT JOIN pa ON sh.match_id = pa.match_id AND sh.clock_us >= pa.clock_us),
f AS (SELECT sh.event_id, pa.clock_us - sh.clock_us AS gap, pid FROM sh ASOF LEFT JOIN pa ON sh.match_id = pa.match_id AND sh.clock_us <= pa.clock_us)
SELECT b.event_id, CASE WHEN b.gap IS NULL OR f.gap < b.gap THEN CASE WHEN f.gap <= 20000000 THEN f.pid END ELSE CASE WHEN b.gap <= 20000000 THEN b.pid END END AS pass_id FROM b JOIN f ON b.event_id = f.event_id""", "stream")
def asof_nearest_tol(spark, sf):
    s = stream(spark, sf)
    got = asof_join(
        s.where(F.col("kind") == "SH").select("match_id", "clock_us", "event_id"), s.where(F.col("kind") == "PA"),
        stream_axis(spark, sf), F.col("event_id"), "pass_id", "nearest", 20 * S,
    )
    return got.select("event_id", "pass_id")


@query("asof_forward", """sh AS (SELECT match_id, clock_us, min(event_id) AS sid FROM stream_v WHERE kind = 'SH' GROUP BY match_id, clock_us)
SELECT c.event_id, sid AS shot_id, sh.clock_us - c.clock_us AS wait_us FROM stream_v c ASOF LEFT JOIN sh ON c.match_id = sh.match_id AND c.clock_us <= sh.clock_us WHERE c.kind = 'CH'""", "stream")
def asof_forward(spark, sf):
    """The next shot at or after a challenge; of several at one time, the one with the least id."""
    s = stream(spark, sf)
    got = asof_join(
        s.where(F.col("kind") == "CH").select("match_id", "clock_us", "event_id"), s.where(F.col("kind") == "SH"),
        stream_axis(spark, sf), F.col("event_id"), "shot_id", "forward",
    )
    return got.select("event_id", "shot_id", (F.col("shot_id_t") - F.col("clock_us")).alias("wait_us"))


@query("trailing_mean", """SELECT event_id, round(avg(value) OVER (PARTITION BY match_id, period, team ORDER BY clock_us RANGE BETWEEN 2999999 PRECEDING AND CURRENT ROW),6) AS mean_3s FROM stream_v""", "stream")
def trailing_mean(spark, sf):
    d = trailing(stream(spark, sf).select(*SLIM), stream_axis(spark, sf, "match_id", "period", "team"), 3 * S, F.col("value"), "w")
    return d.select("event_id", r6(F.col("w_sum") / F.col("w_n")).alias("mean_3s"))


@query("trailing_mean_pressing", """p AS (SELECT event_id, avg(value) OVER (PARTITION BY match_id, period, team ORDER BY clock_us RANGE BETWEEN 29999999 PRECEDING AND CURRENT ROW) AS m FROM stream_v WHERE kind IN ('CH','PA'))
SELECT s.event_id, round(m,6) AS smooth FROM stream_v s LEFT JOIN p ON s.event_id = p.event_id""", "stream")
def trailing_mean_pressing(spark, sf):
    """Smoothed over a team's own pressing rows only, empty on every other row; teams never mix."""
    s = stream(spark, sf).select(*SLIM)
    on = F.col("kind").isin("CH", "PA")
    v = F.when(on, F.col("value"))
    d = trailing(s, stream_axis(spark, sf, "match_id", "period", "team"), 30 * S, v, "w")
    return d.select("event_id", F.when(on, r6(F.try_divide("w_sum", "w_n"))).alias("smooth"))


RUN_SQL = """ch AS (SELECT *, CASE WHEN team IS DISTINCT FROM lag(team) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM stream_v WINDOW w AS (PARTITION BY match_id, period ORDER BY clock_us, event_id)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id) AS rid FROM ch),
rn AS (SELECT match_id, period, team, rid, min(clock_us) AS s, max(clock_us) AS e, count(*) AS n FROM isl GROUP BY ALL)"""


def team_runs(spark, sf, *aggs):
    return runs(stream(spark, sf), stream_axis(spark, sf, "match_id", "period"), F.col("team"), *aggs, name="team")


@query("possession_spells", f"{RUN_SQL} SELECT match_id, period, team, s AS start, e AS \"end\", n FROM rn", "stream")
def possession_spells(spark, sf):
    return team_runs(spark, sf)


ABSORB_SQL = RUN_SQL + """,
a AS (SELECT *, (e - s >= 10000000 OR row_number() OVER w = 1 {last}) AS anchor FROM rn WINDOW w AS (PARTITION BY match_id, period ORDER BY s)),
h AS (SELECT *, last_value(CASE WHEN anchor THEN team END IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM a),
g AS (SELECT *, sum(CASE WHEN held IS DISTINCT FROM ph THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, period ORDER BY s) AS sid FROM (SELECT *, lag(held) OVER (PARTITION BY match_id, period ORDER BY s) AS ph FROM h) q)
SELECT match_id, period, held AS team, min(s) AS start, max(e) AS "end", CAST(sum(n) AS BIGINT) AS n, count(*) AS parts FROM g GROUP BY match_id, period, held, sid"""


def spells(spark, sf, keep_last: bool):
    tl = stream_axis(spark, sf, "match_id", "period")
    return absorb_short_runs(team_runs(spark, sf), tl, "team", F.col("end") - F.col("start"), 10 * S, keep_last)


@query("flicker_prev_absorb", ABSORB_SQL.format(last=""), "stream")
def flicker_prev_absorb(spark, sf):
    return spells(spark, sf, False)


@query("flicker_fixpoint", ABSORB_SQL.format(last="OR lead(s) OVER w IS NULL"), "stream")
def flicker_fixpoint(spark, sf):
    return spells(spark, sf, True)


@query("merged_runs", """m AS (SELECT match_id, team, clock_us, event_id, value > 10 AS f FROM stream_v),
c AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER w THEN 1 ELSE 0 END AS c FROM m WINDOW w AS (PARTITION BY match_id, team ORDER BY clock_us, event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY match_id, team ORDER BY clock_us, event_id) AS rid FROM c),
r AS (SELECT match_id, team, rid, min(clock_us) AS s, max(clock_us) AS e FROM i WHERE f GROUP BY ALL),
b AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY match_id, team ORDER BY s) < 15000000 THEN 0 ELSE 1 END AS nw FROM r),
k AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, team ORDER BY s) AS g FROM b)
SELECT match_id, team, min(s) AS start, max(e) AS "end", count(*) AS parts FROM k GROUP BY match_id, team, g HAVING max(e) - min(s) >= 333333""", "stream")
def merged_runs(spark, sf):
    """Stretches above a threshold, joined over short pauses, then cut to a minimum length."""
    tl = stream_axis(spark, sf, "match_id", "team")
    on = runs(stream(spark, sf), tl, F.col("value") > 10).where(F.col("state"))
    m = merge_gaps(on, tl, 15 * S, True)
    return m.where(F.col("end") - F.col("start") >= 333333).select("match_id", "team", "start", "end", "parts")


@query("ball_losses", """o AS (SELECT match_id, event_id, clock_us, team, lag(team) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS was FROM stream_v WHERE kind = 'OTB')
SELECT match_id, event_id, clock_us, was AS loser, team AS winner FROM o WHERE was IS NOT NULL AND was <> team""", "stream")
def ball_losses(spark, sf):
    return losses(spark, sf).select("match_id", "event_id", "clock_us", "loser", "winner")


@per_session
def losses(spark, sf):
    return feed(spark, sf).losses()


@query("forward_fill", """SELECT event_id, last_value(CASE WHEN kind = 'PA' THEN team END IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM stream_v""", "stream")
def forward_fill(spark, sf):
    d = scan(stream(spark, sf), stream_axis(spark, sf, "match_id", "period"), filled=prev(F.col("team"), when=F.col("kind") == "PA", inclusive=True))
    return d.select("event_id", "filled")


@query("densify_second_grid", """b AS (SELECT match_id, period, CAST(floor(clock_us/1000000e0) AS BIGINT) AS sec, avg(x) AS x, count(*) AS n FROM stream_v GROUP BY ALL),
g AS (SELECT match_id, period, unnest(range(min(sec), max(sec)+1)) AS sec FROM b GROUP BY match_id, period)
SELECT g.match_id, g.period, g.sec, round(x,6) AS x, coalesce(n,0) AS n FROM g LEFT JOIN b ON g.match_id=b.match_id AND g.period=b.period AND g.sec=b.sec""", "stream")
def densify_second_grid(spark, sf):
    """Every second of a period, empty ones included; only the per-second table is joined."""
    b = per_second(spark, sf)
    g = b.groupBy("match_id", "period").agg(F.min("sec").alias("a"), F.max("sec").alias("z"))
    g = g.select("match_id", "period", F.explode(F.sequence("a", "z")).alias("sec"))
    return g.join(b, ["match_id", "period", "sec"], "left").select("match_id", "period", "sec", r6("x").alias("x"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@per_session
def per_second(spark, sf):
    sec = F.floor(F.col("clock_us") / 1000000.0)
    return stream(spark, sf).groupBy("match_id", "period", sec.alias("sec")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))


LERP_SQL = """k AS (SELECT *, CASE WHEN kind = 'PA' THEN {'t': clock_us, 'v': x} END AS pt FROM stream_v),
ab AS (SELECT *, last_value(pt IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
 first_value(pt IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM k)
SELECT event_id, round(CASE {keep} WHEN pt IS NULL AND b.t - a.t <= 30000000 THEN a.v + (b.v - a.v) * (CAST(clock_us - a.t AS DOUBLE) / (b.t - a.t)) END, 6) AS x_filled FROM ab"""


def filled(spark, sf, strict):
    s = stream(spark, sf).withColumn("known_x", F.when(F.col("kind") == "PA", F.col("x")))
    d = lerp_fill(s, stream_axis(spark, sf, "match_id", "period"), "known_x", 30 * S, "xf", strict)
    return d.select("event_id", r6("xf").alias("x_filled"))


@query("lerp_fill", LERP_SQL.replace("{keep}", "WHEN pt IS NOT NULL THEN x"), "stream")
def lerp_fill_query(spark, sf):
    return filled(spark, sf, False)


@query("lerp_fill_strict", LERP_SQL.replace("{keep}", "WHEN pt IS NOT NULL AND (b IS NULL OR b.t - a.t <= 30000000) THEN x"), "stream")
def lerp_fill_strict(spark, sf):
    return filled(spark, sf, True)


@query("bridge_gaps", """k AS (SELECT *, CASE WHEN value > 5 THEN {'t': clock_us, 'd': team, 'x': x, 'k': kind} END AS pt FROM stream_v),
ab AS (SELECT *, last_value(pt IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
 first_value(pt IGNORE NULLS) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b,
 count(pt) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id) AS gap FROM k),
g AS (SELECT match_id, period, gap FROM ab WHERE pt IS NULL GROUP BY ALL HAVING bool_and(value >= 1 AND team = a.d)),
w AS (SELECT ab.*, CASE WHEN b.t = a.t THEN 0.5e0 ELSE CAST(clock_us - a.t AS DOUBLE)/(b.t - a.t) END AS w FROM ab JOIN g USING (match_id, period, gap) WHERE pt IS NULL AND b.t - a.t <= 20000000 AND a.d = b.d)
SELECT event_id, CASE WHEN w < 0.5 THEN a.k ELSE b.k END AS label, round((1-w)*a.x + w*b.x,6) AS x FROM w""", "stream")
def bridge_gaps(spark, sf):
    """Short dropouts take the nearer side's label when both sides agree on the team and every row between is usable and of that team.

    The last and the next row that break this are looked up in the same way as the gap's ends: a gap is whole if neither lies in it.
    Rows of one time are in the order of their ids, and as near to one end as to the other where both ends share their time.
    """
    seen, here = F.col("value") > 5, F.col("clock_us")
    at = F.struct("clock_us", "event_id")
    pt = F.struct(here.alias("t"), F.col("team").alias("d"), "x", F.col("kind").alias("k"), at.alias("at"))
    axis = stream_axis(spark, sf, "match_id", "period")
    d = scan(stream(spark, sf), axis, a=prev(pt, when=seen), b=nxt(pt, when=seen))
    breaks = ~seen & ~F.coalesce((F.col("value") >= 1) & (F.col("team") == F.col("a.d")), F.lit(False))
    d = scan(d, axis, broke=prev(at, when=breaks, inclusive=True), breaks=nxt(at, when=breaks, inclusive=True))
    span = F.col("b.t") - F.col("a.t")
    whole = F.coalesce(F.col("broke") < F.col("a.at"), F.lit(True)) & F.coalesce(F.col("breaks") > F.col("b.at"), F.lit(True))
    d = d.where(~seen & (span <= 20 * S) & (F.col("a.d") == F.col("b.d")) & whole).withColumn("w", F.coalesce(F.try_divide((here - F.col("a.t")).cast("double"), span.cast("double")), F.lit(0.5)))
    w = F.col("w")
    return d.select("event_id", F.when(w < 0.5, F.col("a.k")).otherwise(F.col("b.k")).alias("label"), r6((1 - w) * F.col("a.x") + w * F.col("b.x")).alias("x"))


STEP_SQL = """st AS (SELECT event_id, clock_us AS t, x, y, lag(clock_us) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py,
 lead(clock_us) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, match_id, period, team FROM stream_v WINDOW w AS (PARTITION BY match_id, period, team ORDER BY clock_us, event_id))"""


@per_session
def steps(spark, sf):
    here = F.struct(F.col("clock_us").alias("t"), "x", "y")
    return scan(stream(spark, sf), stream_axis(spark, sf, "match_id", "period", "team"), p=prev(here), q=nxt(here))


def speed(a, b):
    dx, dy = F.col(f"{b}x") - F.col(f"{a}x"), F.col(f"{b}y") - F.col(f"{a}y")
    ta, tb = (F.col(f"{c}t") if c else F.col("clock_us") for c in (a, b))
    return F.sqrt(dx * dx + dy * dy) / ((tb - ta) / 1e6)


@query("spike_filter", f"""{STEP_SQL} SELECT event_id FROM st WHERE NOT coalesce(t > pt AND nt > t AND sqrt((x-px)*(x-px)+(y-py)*(y-py))/((t-pt)/1e6) > 5 AND sqrt((nx-x)*(nx-x)+(ny-y)*(ny-y))/((nt-t)/1e6) > 5
 AND sqrt((nx-px)*(nx-px)+(ny-py)*(ny-py))/((nt-pt)/1e6) <= 5, false)""", "stream")
def spike_filter(spark, sf):
    """Drop a sample whose speed in and out is impossible while its neighbours are a plausible speed apart."""
    d = steps(spark, sf).where(F.col("p").isNull() | F.col("q").isNull() | ~is_spike(5.0))
    return d.select("event_id")


def is_spike(vmax):
    ok = (F.col("clock_us") > F.col("p.t")) & (F.col("q.t") > F.col("clock_us"))
    fast = (speed("p.", "") > vmax) & (speed("", "q.") > vmax) & (speed("p.", "q.") <= vmax)
    return F.when(ok, fast).otherwise(False)


@query("velocity_backward", f"{STEP_SQL} SELECT event_id, CASE WHEN t - pt > 0 AND t - pt <= 10000000 THEN round((x-px)/((t-pt)/1e6),6)+0e0 ELSE 0e0 END AS vx, CASE WHEN t - pt > 0 AND t - pt <= 10000000 THEN round((y-py)/((t-pt)/1e6),6)+0e0 ELSE 0e0 END AS vy FROM st", "stream")
def velocity_backward(spark, sf):
    """Velocity from the previous sample; unknown (zero) when that sample is too old."""
    dt = F.col("clock_us") - F.col("p.t")
    v = lambda c: F.when((dt > 0) & (dt <= 10 * S), r6((F.col(c) - F.col(f"p.{c}")) / (dt / 1e6))).otherwise(F.lit(0.0))
    return steps(spark, sf).select("event_id", v("x").alias("vx"), v("y").alias("vy"))


@query("velocity_central", f"{STEP_SQL} SELECT event_id, round((coalesce(nx,x)-coalesce(px,x))/nullif((coalesce(nt,t)-coalesce(pt,t))/1e6,0),6)+0e0 AS vx, round((coalesce(ny,y)-coalesce(py,y))/nullif((coalesce(nt,t)-coalesce(pt,t))/1e6,0),6)+0e0 AS vy FROM st", "stream")
def velocity_central(spark, sf):
    dt = (F.coalesce("q.t", "clock_us") - F.coalesce("p.t", "clock_us")) / 1e6
    v = lambda c: r6(F.try_divide(F.coalesce(f"q.{c}", c) - F.coalesce(f"p.{c}", c), dt))
    return steps(spark, sf).select("event_id", v("x").alias("vx"), v("y").alias("vy"))


@query("top_speed", f"""{STEP_SQL}, dv AS (SELECT match_id, team, sqrt((x-px)*(x-px)+(y-py)*(y-py))/((t-pt)/1e6) AS v FROM st WHERE t - pt > 0 AND t - pt <= 10000000),
rw AS (SELECT match_id, team, quantile_cont(value/10, 0.99) AS p FROM stream_v WHERE kind = 'SH' AND value > 50 GROUP BY match_id, team),
de AS (SELECT match_id, team, quantile_cont(v, 0.99) AS p FROM dv GROUP BY match_id, team)
SELECT coalesce(rw.match_id, de.match_id) AS match_id, coalesce(rw.team, de.team) AS team, round(greatest(4.0e0, coalesce(rw.p, de.p)),6) AS vmax, CASE WHEN rw.p IS NOT NULL THEN 'raw' ELSE 'derived' END AS source FROM rw FULL JOIN de ON rw.match_id = de.match_id AND rw.team = de.team""", "stream")
def top_speed(spark, sf):
    """99th percentile of measured speed, else of displacement speed, floored at 4 m/s."""
    key = ["match_id", "team"]
    dt = F.col("clock_us") - F.col("p.t")
    der = steps(spark, sf).where((dt > 0) & (dt <= 10 * S)).select(*key, speed("p.", "").alias("v"))
    raw = stream(spark, sf).where((F.col("kind") == "SH") & (F.col("value") > 50)).select(*key, (F.col("value") / 10).alias("v"))
    p99 = lambda d, n: d.groupBy(*key, "v").count().groupBy(*key).agg(F.percentile("v", 0.99, F.col("count")).alias(n))
    both = p99(raw, "r").join(p99(der, "d"), key, "full")
    return both.select(
        *key, r6(F.greatest(F.lit(4.0), F.coalesce("r", "d"))).alias("vmax"),
        F.when(F.col("r").isNotNull(), "raw").otherwise("derived").alias("source"),
    )


LIVE_SQL = """lo AS (SELECT *, max(CASE WHEN kind = 'OUT' THEN clock_us END) OVER (PARTITION BY match_id ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM stream_v),
ot AS (SELECT match_id, event_id, clock_us AS s, clock_us + CAST(floor(value*10000) AS BIGINT) AS e, lead(clock_us) OVER w AS ns, lead(po) OVER w AS no FROM lo WHERE kind = 'OTB' WINDOW w AS (PARTITION BY match_id ORDER BY clock_us, event_id)),
iv AS (SELECT match_id, event_id, s, CASE WHEN ns IS NOT NULL AND ns - e <= 30000000 AND (no IS NULL OR no <= e) THEN ns ELSE e + 1500000 END AS live_to FROM ot),
lv AS (SELECT s.*, iv.live_to, coalesce(max(iv.live_to) OVER (PARTITION BY s.match_id ORDER BY s.clock_us, s.event_id) > s.clock_us, false) AS live FROM stream_v s LEFT JOIN iv ON s.event_id = iv.event_id)"""


@per_session
def live_stream(spark: SparkSession, sf: str) -> DataFrame:
    return feed(spark, sf).live.drop("end_us", "pressed")


@query("live_mask", f"{LIVE_SQL} SELECT event_id, live_to, live FROM lv", "stream")
def live_mask(spark, sf):
    return live_stream(spark, sf).select("event_id", "live_to", "live")


@query("live_minutes", f"{LIVE_SQL} SELECT match_id, count(*) FILTER (live) AS n_live, round(count(*) FILTER (live)/5e0/60,6) AS live_min, round(100e0*count(*) FILTER (live AND team=0)/greatest(count(*) FILTER (live),1),6) AS home_pct FROM lv GROUP BY match_id", "stream")
def live_minutes(spark, sf):
    n = F.count_if("live")
    return live_stream(spark, sf).groupBy("match_id").agg(
        n.alias("n_live"), r6(n / 5.0 / 60).alias("live_min"),
        r6(100.0 * F.count_if(F.col("live") & (F.col("team") == 0)) / F.greatest(n, F.lit(1))).alias("home_pct"),
    )


@query("dead_ball_mask", """sp AS (SELECT match_id, clock_us AS t FROM stream_v WHERE kind = 'OUT' AND abs(y) > 30)
SELECT event_id, EXISTS (SELECT 1 FROM sp WHERE sp.match_id = s.match_id AND s.clock_us BETWEEN sp.t - 2000000 AND sp.t + 15000000) AS masked FROM stream_v s""", "stream")
def dead_ball_mask(spark, sf):
    mark = (F.col("kind") == "OUT") & (F.abs("y") > 30)
    return play.near_marks(stream(spark, sf), stream_axis(spark, sf), mark, 2 * S, 15 * S).select("event_id", "masked")


@query("downsample_stride", "SELECT event_id, match_id, frame FROM stream_v WHERE (frame - 1) % 6 = 0", "stream")
def downsample_stride(spark, sf):
    """Every sixth frame of each match: the sampling the 5 Hz views work on."""
    return stream_frames(spark, sf).where((F.col("frame") - 1) % 6 == 0).select("event_id", "match_id", "frame")


@query("defending_side", """SELECT event_id, 1 - team AS dteam, CASE WHEN team = 0 THEN y ELSE x END AS stitched FROM stream_v""", "stream")
def defending_side(spark, sf):
    """The side without the ball, and a measure stitched from that side's column."""
    return stream(spark, sf).select("event_id", (1 - F.col("team")).alias("dteam"), F.when(F.col("team") == 0, F.col("y")).otherwise(F.col("x")).alias("stitched"))


@query("defending_moments", f"{LIVE_SQL} SELECT match_id, 1 - team AS dteam, count(*) AS n, round(avg(value),6) AS mean_value FROM lv WHERE live AND abs(x) <= 52 GROUP BY match_id, 1 - team", "stream")
def defending_moments(spark, sf):
    d = live_stream(spark, sf).where(F.col("live") & (F.abs("x") <= 52))
    return d.groupBy("match_id", (1 - F.col("team")).alias("dteam")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("resample_second", """b AS (SELECT match_id, period, team, CAST(floor(clock_us/1000000e0) AS BIGINT) AS sec, kind, count(*) AS n, sum(x) AS sx FROM stream_v GROUP BY ALL)
SELECT match_id, period, team, sec, CAST(sum(n) AS BIGINT) AS n, round(sum(sx)/sum(n),6) AS x, arg_max(kind, printf('%09d%s', n, kind)) AS mode_kind FROM b GROUP BY match_id, period, team, sec""", "stream")
def resample_second(spark, sf):
    """Means, counts and the most frequent kind per second (ties by name, last first)."""
    sec = F.floor(F.col("clock_us") / 1000000.0).alias("sec")
    k = ["match_id", "period", "team"]
    b = stream(spark, sf).groupBy(*k, sec, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"))
    return b.groupBy(*k, "sec").agg(
        F.sum("n").alias("nn"), r6(F.sum("sx") / F.sum("n")).alias("x"), F.max_by("kind", F.struct("n", "kind")).alias("mode_kind")
    ).withColumnRenamed("nn", "n")
