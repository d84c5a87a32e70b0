"""Match-play views over the event stream: pressing, turnovers, chances, phases."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators import feed as views
from touchline.operators import geometry as G
from touchline.operators import play
from touchline.operators.sequences import rate_limit
from touchline.operators.timeline import (
    absorb_short_runs, asof_join, grouped_percentile, merge_gaps, nxt, prev, runs, scan, spell_before, total,
)
from touchline.plans.registry import big, query, r6
from touchline.plans.timeseries import LIVE_SQL, RUN_SQL, live_stream, losses
from touchline.sources.driver_tables import feed, moments, per_session, stream, stream_axis

S = play.SECOND
ZONE = "abs(CASE WHEN dteam = 0 THEN -52.5e0 ELSE 52.5e0 END - x) >= 35"
PPDA_SQL = """pc AS (SELECT *, CASE WHEN kind = 'CH' THEN team ELSE 1 - team END AS dteam, (kind = 'PA')::INT AS is_pass, (kind = 'CH')::INT AS is_action FROM stream_v WHERE kind IN ('PA','CH'))"""
PPDA_COLS = "CAST(sum(is_pass) AS BIGINT) AS passes, CAST(sum(is_action) AS BIGINT) AS actions, round(CAST(sum(is_pass) AS DOUBLE)/nullif(sum(is_action),0),6) AS ppda"


def rounded_ppda(d):
    return d.withColumn("ppda", r6("ppda"))


@query("ppda_bucket", f"{PPDA_SQL} SELECT match_id, dteam, CAST(floor(clock_us/300000000e0) AS BIGINT) AS bucket, {PPDA_COLS} FROM pc WHERE {ZONE} GROUP BY ALL", "stream")
def ppda_bucket(spark, sf):
    b = F.floor(F.col("clock_us") / 300000000.0).alias("bucket")
    return rounded_ppda(play.ppda(play.press_counts(stream(spark, sf)), "match_id", "dteam", b))


@query("ppda_true_clock", f"""{PPDA_SQL}, o AS (SELECT match_id, period, min(clock_us) AS t0 FROM stream_v GROUP BY ALL),
t AS (SELECT pc.*, pc.clock_us - t0 + CASE WHEN pc.period = 1 THEN 0 ELSE 2700000000 END AS tc FROM pc JOIN o ON pc.match_id = o.match_id AND pc.period = o.period)
SELECT match_id, dteam, CAST(floor(tc/300000000e0) AS BIGINT) AS bucket, {PPDA_COLS} FROM t WHERE {ZONE} GROUP BY ALL""", "stream")
def ppda_true_clock(spark, sf):
    """Buckets on the period clock: each period is rebased to its own kick-off."""
    s = stream(spark, sf)
    start = s.groupBy("match_id", "period").agg(F.min("clock_us").alias("t0"))
    tc = F.col("clock_us") - F.col("t0") + F.when(F.col("period") == 1, 0).otherwise(2700 * S)
    d = play.press_counts(s).join(start, ["match_id", "period"])
    return rounded_ppda(play.ppda(d, "match_id", "dteam", F.floor(tc / 300000000.0).alias("bucket")))


LABEL_SQL = """lb AS (SELECT *, 1 - team AS dteam, CASE WHEN dep >= 40 THEN 'High Press' WHEN dep >= 32 THEN 'Mid Block' WHEN abs(y) <= 20 THEN 'Low Block' ELSE 'Mid Block' END AS structure
 FROM (SELECT *, abs(CASE WHEN team = 1 THEN -52.5e0 ELSE 52.5e0 END - x) * 0.6e0 AS dep FROM stream_v) q)"""


@per_session
def labelled(spark, sf):
    """Each event as a reading of the defending side's block height."""
    s = stream(spark, sf).withColumn("dteam", 1 - F.col("team"))
    depth = F.abs(P.own_goal_x(F.col("dteam")) - F.col("x")) * 0.6
    return s.withColumn("depth", depth).withColumn("structure", P.block_label(F.col("depth"), F.abs("y")))


SEG_SQL = f"""{LABEL_SQL}, sc AS (SELECT *, CASE WHEN structure IS DISTINCT FROM lag(structure) OVER w THEN 1 ELSE 0 END AS c FROM lb WINDOW w AS (PARTITION BY match_id, dteam ORDER BY clock_us, event_id)),
si AS (SELECT *, sum(c) OVER (PARTITION BY match_id, dteam ORDER BY clock_us, event_id) AS rid FROM sc),
seg AS (SELECT match_id, dteam, structure AS state, min(clock_us) AS s, max(clock_us) AS e FROM si GROUP BY match_id, dteam, structure, rid HAVING max(clock_us) - min(clock_us) >= 5000000)"""


@per_session
def segments(spark, sf):
    """Sustained block phases: runs of one label lasting at least 5 s."""
    r = runs(labelled(spark, sf), stream_axis(spark, sf, "match_id", "dteam"), F.col("structure"))
    return r.where(F.col("end") - F.col("start") >= 5 * S).select("match_id", "dteam", "state", "start", "end")


@query("phase_segments", f"{SEG_SQL} SELECT match_id, dteam, state, s AS start, e AS \"end\" FROM seg", "stream")
def phase_segments(spark, sf):
    return segments(spark, sf)


def in_segments(points, segs, tl):
    """Points with the segment holding them; segments of a key never overlap, so the last one started decides."""
    right = segs.withColumn("clock_us", F.col("start"))
    got = asof_join(points, right, tl, F.struct("state", "start", "end"), "seg")
    return got.where(F.col("seg").isNotNull())


@query("events_in_segments", f"{SEG_SQL} SELECT lb.event_id, seg.dteam, seg.state, seg.s AS start FROM lb JOIN seg ON lb.match_id = seg.match_id AND lb.dteam = seg.dteam AND lb.clock_us BETWEEN seg.s AND seg.e", "stream")
def events_in_segments(spark, sf):
    tl = stream_axis(spark, sf, "match_id", "dteam")
    pts = labelled(spark, sf).select("event_id", "match_id", "dteam", "clock_us")
    hit = in_segments(pts, segments(spark, sf), tl).where(F.col("clock_us") <= F.col("seg.end"))
    return hit.select("event_id", "dteam", "seg.state", "seg.start")


@query("ppda_by_state", f"""{PPDA_SQL}, {SEG_SQL} SELECT seg.dteam, seg.state, {PPDA_COLS} FROM pc JOIN seg ON pc.match_id = seg.match_id AND pc.dteam = seg.dteam AND pc.clock_us >= seg.s AND pc.clock_us < seg.e GROUP BY seg.dteam, seg.state""", "stream")
def ppda_by_state(spark, sf):
    tl = stream_axis(spark, sf, "match_id", "dteam")
    pts = play.press_counts(stream(spark, sf), zone=False).select("match_id", "dteam", "clock_us", "is_pass", "is_action")
    hit = in_segments(pts, segments(spark, sf), tl).where(F.col("clock_us") < F.col("seg.end"))
    return rounded_ppda(play.ppda(hit, "dteam", F.col("seg.state").alias("state")))


SEGLAB_SQL = f"""{SEG_SQL}, sl AS (SELECT seg.match_id, seg.dteam, seg.state, seg.s, seg.e, count(*) AS n_resolved, avg((value >= 15)::INT) AS frac
 FROM seg JOIN lb ON lb.match_id = seg.match_id AND lb.dteam = seg.dteam AND lb.clock_us BETWEEN seg.s AND seg.e AND value > 2 GROUP BY ALL),
sg AS (SELECT seg.*, coalesce(n_resolved, 0) AS n_resolved, frac, CASE WHEN coalesce(n_resolved,0) < 3 THEN 'Unresolved' WHEN frac >= 0.5 THEN 'Engaged' ELSE 'Passive' END AS label
 FROM seg LEFT JOIN sl ON seg.match_id = sl.match_id AND seg.dteam = sl.dteam AND seg.s = sl.s)"""


@per_session
def labelled_segments(spark, sf):
    tl = stream_axis(spark, sf, "match_id", "dteam")
    segs = segments(spark, sf)
    pts = labelled(spark, sf).where(F.col("value") > 2).select("match_id", "dteam", "clock_us", "value")
    hit = in_segments(pts, segs, tl).where(F.col("clock_us") <= F.col("seg.end"))
    n = hit.groupBy("match_id", "dteam", F.col("seg.start").alias("start")).agg(
        F.count(F.lit(1)).alias("n_resolved"), F.avg((F.col("value") >= 15).cast("int")).alias("frac")
    )
    d = segs.join(n, ["match_id", "dteam", "start"], "left").withColumn("n_resolved", F.coalesce("n_resolved", big(F.lit(0))))
    lab = F.when(F.col("n_resolved") < 3, "Unresolved").when(F.col("frac") >= 0.5, "Engaged").otherwise("Passive")
    return d.withColumn("label", lab)


@query("segment_labels", f"{SEGLAB_SQL} SELECT match_id, dteam, state, s AS start, n_resolved, round(frac,6) AS frac_engaged, label FROM sg", "stream")
def segment_labels(spark, sf):
    return labelled_segments(spark, sf).select("match_id", "dteam", "state", "start", "n_resolved", r6("frac").alias("frac_engaged"), "label")


@query("engaged_share", f"""{SEGLAB_SQL} SELECT state, count(*) AS n_segments, round(sum(e-s)/1e6,6) AS total_s, round(100e0*sum(CASE WHEN label='Engaged' THEN e-s ELSE 0 END)/sum(e-s),6) AS engaged_pct,
 round(100e0*sum(CASE WHEN label='Passive' THEN e-s ELSE 0 END)/sum(e-s),6) AS passive_pct FROM sg GROUP BY state""", "stream")
def engaged_share(spark, sf):
    dur = F.col("end") - F.col("start")
    part = lambda l: r6(100.0 * F.sum(F.when(F.col("label") == l, dur).otherwise(0)) / F.sum(dur))
    return labelled_segments(spark, sf).groupBy("state").agg(
        F.count(F.lit(1)).alias("n_segments"), r6(F.sum(dur) / 1e6).alias("total_s"), part("Engaged").alias("engaged_pct"), part("Passive").alias("passive_pct")
    )


@query("ppda_by_label", f"""{PPDA_SQL}, {SEGLAB_SQL} SELECT sg.dteam, sg.state, sg.label, {PPDA_COLS} FROM pc JOIN sg ON pc.match_id = sg.match_id AND pc.dteam = sg.dteam AND pc.clock_us >= sg.s AND pc.clock_us < sg.e GROUP BY sg.dteam, sg.state, sg.label""", "stream")
def ppda_by_label(spark, sf):
    """Passes per defensive action pooled by phase and engagement of the segment."""
    tl = stream_axis(spark, sf, "match_id", "dteam")
    pts = play.press_counts(stream(spark, sf), zone=False).select("match_id", "dteam", "clock_us", "is_pass", "is_action")
    segs = labelled_segments(spark, sf).withColumn("clock_us", F.col("start"))
    hit = asof_join(pts, segs, tl, F.struct("state", "label", "end"), "seg").where(F.col("clock_us") < F.col("seg.end"))
    return rounded_ppda(play.ppda(hit, "dteam", F.col("seg.state").alias("state"), F.col("seg.label").alias("label")))


@query("regain_within", """o AS (SELECT match_id, period, clock_us, team, lag(team) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id) AS was FROM stream_v WHERE kind = 'OTB'),
rg AS (SELECT match_id, period, team, clock_us FROM o WHERE was <> team), g AS (SELECT DISTINCT match_id, period, 1 - team AS team, CAST(floor(clock_us/1000000e0) AS BIGINT) AS sec FROM stream_v),
n AS (SELECT g.*, rg.clock_us AS nx FROM g ASOF LEFT JOIN rg ON g.match_id=rg.match_id AND g.period=rg.period AND g.team=rg.team AND g.sec*1000000 < rg.clock_us)
SELECT match_id, period, team, count(*) AS seconds, round(avg((coalesce(nx - sec*1000000 <= 5000000, false))::INT),6) AS within_5s, round(avg((coalesce(nx - sec*1000000 <= 8000000, false))::INT),6) AS within_8s, round(avg((coalesce(nx - sec*1000000 <= 10000000, false))::INT),6) AS within_10s FROM n GROUP BY 1, 2, 3""", "stream")
def regain_within(spark, sf):
    """Share of a team's defending seconds followed by a regain within 5, 8 and 10 s: one forward lookup, then comparisons."""
    k = ["match_id", "period", "team"]
    o = scan(stream(spark, sf).where(F.col("kind") == "OTB"), stream_axis(spark, sf, "match_id", "period"), was=prev(F.col("team")))
    rg = o.where(F.col("was") != F.col("team")).select(*k, "clock_us")
    sec = F.floor(F.col("clock_us") / 1000000.0)
    g = stream(spark, sf).select("match_id", "period", (1 - F.col("team")).alias("team"), sec.alias("sec")).distinct()
    g = g.withColumn("clock_us", F.col("sec") * S + 1)  # strictly after the second
    d = asof_join(g, rg, stream_axis(spark, sf, *k), F.lit(1), "hit", "forward")
    hit = lambda n: r6(F.avg(F.coalesce(F.col("hit_t") - F.col("sec") * S <= n * S, F.lit(False)).cast("int")))
    return d.groupBy(*k).agg(F.count(F.lit(1)).alias("seconds"), hit(5).alias("within_5s"), hit(8).alias("within_8s"), hit(10).alias("within_10s"))


DOM_SQL = f"""{LABEL_SQL}, bc AS (SELECT match_id, dteam, CAST(floor(clock_us/300000000e0) AS BIGINT) AS bucket, structure, count(*) AS n FROM lb WHERE structure <> 'Low Block' OR abs(y) < 15 GROUP BY ALL),
dom AS (SELECT match_id, dteam, bucket, structure AS state, n FROM (SELECT *, row_number() OVER (PARTITION BY match_id, dteam, bucket ORDER BY n DESC, structure) AS r FROM bc) q WHERE r = 1)"""


@per_session
def dominant(spark, sf):
    d = labelled(spark, sf).where((F.col("structure") != "Low Block") | (F.abs("y") < 15))
    c = d.groupBy("match_id", "dteam", F.floor(F.col("clock_us") / 300000000.0).alias("bucket"), "structure").count()
    best = F.min(F.struct((-F.col("count")).alias("m"), F.col("structure").alias("s"), F.col("count").alias("n")))
    return c.groupBy("match_id", "dteam", "bucket").agg(best.alias("b")).select("match_id", "dteam", "bucket", F.col("b.s").alias("state"), F.col("b.n").alias("n"))


@query("dominant_state", f"{DOM_SQL} SELECT * FROM dom", "stream")
def dominant_state(spark, sf):
    return dominant(spark, sf)


@query("state_crosstab", f"""{PPDA_SQL}, {DOM_SQL}, pb AS (SELECT match_id, dteam, CAST(floor(clock_us/300000000e0) AS BIGINT) AS bucket, CAST(sum(is_pass) AS DOUBLE)/nullif(sum(is_action),0) AS ppda FROM pc WHERE {ZONE} GROUP BY ALL)
SELECT dom.dteam, state, count(*) AS n, round(avg(ppda),6) AS mean_ppda, round(min(ppda),6) AS min_ppda, round(max(ppda),6) AS max_ppda FROM dom JOIN pb ON dom.match_id=pb.match_id AND dom.dteam=pb.dteam AND dom.bucket=pb.bucket WHERE ppda IS NOT NULL GROUP BY dom.dteam, state""", "stream")
def state_crosstab(spark, sf):
    b = F.floor(F.col("clock_us") / 300000000.0).alias("bucket")
    p = play.ppda(play.press_counts(stream(spark, sf)), "match_id", "dteam", b).where(F.col("ppda").isNotNull())
    d = dominant(spark, sf).drop("n").join(p, ["match_id", "dteam", "bucket"])
    return d.groupBy("dteam", "state").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("ppda")).alias("mean_ppda"), r6(F.min("ppda")).alias("min_ppda"), r6(F.max("ppda")).alias("max_ppda")
    )


@query("label_counts", f"{LABEL_SQL} SELECT dteam, structure, count(*) AS n, round(avg(dep),6) AS mean_depth, round(min(dep),6) AS min_depth, round(max(dep),6) AS max_depth FROM lb GROUP BY ALL", "stream")
def label_counts(spark, sf):
    return labelled(spark, sf).groupBy("dteam", "structure").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("depth")).alias("mean_depth"), r6(F.min("depth")).alias("min_depth"), r6(F.max("depth")).alias("max_depth")
    )


@query("passes_before_loss", """o AS (SELECT *, CASE WHEN kind = 'OTB' AND team IS DISTINCT FROM last_value(CASE WHEN kind='OTB' THEN team END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS c FROM stream_v),
g AS (SELECT *, sum(c) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS sid FROM o),
sp AS (SELECT match_id, sid, min(clock_us) AS s, arg_min(team, clock_us) AS team FROM g WHERE sid > 0 GROUP BY match_id, sid),
nx AS (SELECT *, lead(s) OVER (PARTITION BY match_id ORDER BY s) AS e FROM sp)
SELECT nx.match_id, nx.team, nx.s AS start, nx.e AS lost_at, count(*) FILTER (g.kind = 'PA' AND g.team = nx.team) AS passes FROM nx JOIN g ON nx.match_id = g.match_id AND nx.sid = g.sid WHERE e IS NOT NULL GROUP BY ALL""", "stream")
def passes_before_loss(spark, sf):
    """Completed passes of each on-ball spell before the other team takes over."""
    tl = stream_axis(spark, sf)
    otb = F.col("kind") == "OTB"
    d = scan(stream(spark, sf), tl, was=prev(F.col("team"), when=otb))
    turn = otb & (F.col("was").isNull() | (F.col("was") != F.col("team")))
    d = scan(d, tl, head=prev(F.struct("clock_us", "team"), when=turn, inclusive=True), lost_at=nxt(F.col("clock_us"), when=turn))
    d = d.where(F.col("head").isNotNull() & F.col("lost_at").isNotNull())
    return d.groupBy("match_id", F.col("head.team").alias("team"), F.col("head.clock_us").alias("start"), "lost_at").agg(
        F.count_if((F.col("kind") == "PA") & (F.col("team") == F.col("head.team"))).alias("passes")
    )


@query("defending_minutes", f"{LIVE_SQL} SELECT match_id, 1 - team AS dteam, round(count(*) FILTER (live)/5e0/60,6) AS minutes FROM lv GROUP BY match_id, 1 - team", "stream")
def defending_minutes(spark, sf):
    return live_stream(spark, sf).groupBy("match_id", (1 - F.col("team")).alias("dteam")).agg(r6(F.count_if("live") / 5.0 / 60).alias("minutes"))


@query("state_time", "SELECT match_id, team, period, count(*) AS n, round(count(*)/29.97e0,6) AS seconds FROM stream_v WHERE kind <> 'OUT' GROUP BY ALL", "stream")
def state_time(spark, sf):
    return stream(spark, sf).where(F.col("kind") != "OUT").groupBy("match_id", "team", "period").agg(
        F.count(F.lit(1)).alias("n"), r6(F.count(F.lit(1)) / 29.97).alias("seconds")
    )


# ------------------------------------------------------------------ settling after a loss

STEP, CAP, REF, TOL_D, TOL_L = 5 * S, 100 * S, 15 * S, 15.0, 12.0
SETTLE_SQL = f"""o AS (SELECT match_id, event_id, clock_us, team, lag(team) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS was FROM stream_v WHERE kind = 'OTB'),
ls AS (SELECT match_id, event_id AS loss_id, clock_us AS t0, was AS dteam, least({CAP}, coalesce(lead(clock_us) OVER (PARTITION BY match_id, was ORDER BY clock_us) - clock_us, {CAP})) AS room FROM o WHERE was <> team),
gr AS (SELECT *, t0 + k*{STEP} AS clock_us, k*{STEP} AS rel FROM ls, range(0,21) g(k) WHERE k*{STEP} <= room),
bk AS (SELECT gr.*, s.clock_us AS bt, s.x AS bd, abs(s.y) AS bl FROM gr ASOF LEFT JOIN stream_v s ON gr.match_id = s.match_id AND gr.clock_us >= s.clock_us),
fw AS (SELECT bk.*, s.clock_us AS ft, s.x AS fd, abs(s.y) AS fl FROM bk ASOF LEFT JOIN stream_v s ON bk.match_id = s.match_id AND bk.clock_us <= s.clock_us),
sm AS (SELECT match_id, loss_id, t0, dteam, rel, CASE WHEN uf THEN fd ELSE bd END AS d, CASE WHEN uf THEN fl ELSE bl END AS l
 FROM (SELECT *, (bt IS NULL OR ft - clock_us < clock_us - bt) AS uf FROM fw) q WHERE CASE WHEN uf THEN ft - clock_us ELSE clock_us - bt END <= {STEP}),
rf AS (SELECT *, avg(d) FILTER (rel >= mx - {REF}) OVER w AS rd, avg(l) FILTER (rel >= mx - {REF}) OVER w AS rl, count(*) OVER w AS n FROM (SELECT *, max(rel) OVER (PARTITION BY match_id, loss_id) AS mx FROM sm) q WINDOW w AS (PARTITION BY match_id, loss_id)),
ok AS (SELECT *, avg((abs(d-rd) <= {TOL_D})::INT) OVER w AS fd, avg((abs(l-rl) <= {TOL_L})::INT) OVER w AS fl FROM rf WINDOW w AS (PARTITION BY match_id, loss_id ORDER BY rel ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
st AS (SELECT match_id, loss_id, any_value(n) AS n, min(rel) FILTER (fd >= 0.85 AND fl >= 0.85) AS sat, any_value(mx) AS mx FROM ok GROUP BY match_id, loss_id),
dur AS (SELECT ls.match_id, ls.loss_id, ls.t0, ls.dteam, CASE WHEN coalesce(n,0) < 2 THEN 0 WHEN sat IS NOT NULL THEN sat ELSE mx END AS dur_us, coalesce(n,0) >= 2 AND sat IS NOT NULL AS settled FROM ls LEFT JOIN st ON ls.match_id = st.match_id AND ls.loss_id = st.loss_id)"""


@per_session
def settle(spark: SparkSession, sf: str):
    return views.settling(feed(spark, sf), STEP, CAP, REF, TOL_D, TOL_L)


@query("settle_duration", f"{SETTLE_SQL} SELECT match_id, loss_id, dteam, CAST(dur_us AS BIGINT) AS dur_us, settled FROM dur", "stream")
def settle_duration(spark, sf):
    return settle(spark, sf).select("match_id", "loss_id", "dteam", "dur_us", "settled")


@query("settle_summary", f"{SETTLE_SQL} SELECT dteam, count(*) AS n, round(avg(dur_us)/1e6,6) AS mean_s, round(max(dur_us)/1e6,6) AS max_s, round(avg(settled::INT),6) AS settled_share FROM dur GROUP BY dteam", "stream")
def settle_summary(spark, sf):
    return settle(spark, sf).groupBy("dteam").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("dur_us") / 1e6).alias("mean_s"), r6(F.max("dur_us") / 1e6).alias("max_s"), r6(F.avg(F.col("settled").cast("int"))).alias("settled_share")
    )


@query("phase_label", f"""{SETTLE_SQL}, ev AS (SELECT event_id, match_id, clock_us, t.k AS side, team FROM stream_v, range(0,2) t(k)),
a AS (SELECT ev.*, dur.t0, dur.dur_us FROM ev ASOF LEFT JOIN dur ON ev.match_id = dur.match_id AND ev.side = dur.dteam AND ev.clock_us >= dur.t0)
SELECT event_id, CAST(side AS INTEGER) AS side, CASE WHEN team = side THEN 'In Possession' WHEN t0 IS NULL THEN 'Organized Defense' WHEN clock_us - t0 <= coalesce(dur_us, 5000000) THEN 'Defensive Transition' ELSE 'Organized Defense' END AS phase FROM a""", "stream")
def phase_label(spark, sf):
    """Possession phase of both sides at every event, from the last loss and its settling time."""
    tl = stream_axis(spark, sf, "match_id", "side")
    ev = stream(spark, sf).select("event_id", "match_id", "clock_us", "team", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    lost = settle(spark, sf).select("match_id", F.col("dteam").alias("side"), F.col("t0").alias("clock_us"), "dur_us")
    d = asof_join(ev, lost, tl, F.col("dur_us"), "dur")
    phase = (
        F.when(F.col("team") == F.col("side"), "In Possession")
        .when(F.col("clock_us") - F.col("dur_t") <= F.coalesce("dur", F.lit(5 * S)), "Defensive Transition")
        .otherwise("Organized Defense")
    )
    return d.select("event_id", "side", phase.alias("phase"))


# ------------------------------------------------------------------ turnovers

OPEN_ROWS = 3  # as in Feed.opened
OPEN_SQL = f"""{LIVE_SQL}, ix AS (SELECT *, row_number() OVER w AS i FROM lv WINDOW w AS (PARTITION BY match_id ORDER BY clock_us, event_id)),
op AS (SELECT *, i > {OPEN_ROWS} AND abs(x) <= 52.4e0 AND i - coalesce(max(CASE WHEN NOT live THEN i END) OVER (PARTITION BY match_id ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) > {OPEN_ROWS} AS open FROM ix)"""
MRUN_SQL = """ch AS (SELECT *, CASE WHEN team IS DISTINCT FROM lag(team) OVER w THEN 1 ELSE 0 END AS c FROM op WINDOW w AS (PARTITION BY match_id ORDER BY clock_us, event_id)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS rid FROM ch),
rn AS (SELECT match_id, team, rid, min(clock_us) AS s, max(clock_us) AS e, arg_min(x, clock_us) AS fx, arg_min(y, clock_us) AS fy, arg_min(open, clock_us) AS fo, arg_min(period, clock_us) AS fp FROM isl GROUP BY match_id, team, rid),
ak AS (SELECT *, (e - s >= 5000000 OR row_number() OVER (PARTITION BY match_id ORDER BY s) = 1) AS anchor FROM rn),
hd AS (SELECT *, last_value(CASE WHEN anchor THEN team END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ak),
fr AS (SELECT *, anchor AND (held IS NULL OR held <> team) AS fresh FROM hd)"""
TURN_SQL = f"""{OPEN_SQL}, {MRUN_SQL},
sp AS (SELECT match_id, team, s, fx, fy, fo, fp, lead(s) OVER (PARTITION BY match_id ORDER BY s) AS ns, row_number() OVER (PARTITION BY match_id ORDER BY s) AS k FROM fr WHERE fresh),
tv AS (SELECT sp.*, max(CASE WHEN sp.team = 0 THEN v.x ELSE -v.x END) AS ahead FROM sp JOIN stream_v v ON v.match_id = sp.match_id AND v.clock_us >= sp.s AND v.clock_us < least(sp.s + 30000000, coalesce(sp.ns, 9000000000)) WHERE k > 1 AND fo GROUP BY ALL),
tn AS (SELECT match_id, team, s AS start, fp AS period, CASE WHEN team = 0 THEN fx ELSE -fx END AS x, CASE WHEN team = 0 THEN fy ELSE -fy END AS y, ahead > 17.5e0 AS fast,
 EXISTS (SELECT 1 FROM stream_v h WHERE h.match_id = tv.match_id AND h.kind = 'SH' AND h.team = tv.team AND h.clock_us BETWEEN tv.s AND tv.s + 45000000) AS shot FROM tv)"""


@per_session
def find_turnovers(spark, sf):
    return views.turnovers(feed(spark, sf))


@query("turnovers", f"{TURN_SQL} SELECT match_id, team, start, period, round(x,6)+0e0 AS x, round(y,6)+0e0 AS y, fast, shot FROM tn", "stream")
def turnovers(spark, sf):
    t = find_turnovers(spark, sf)
    return t.select("match_id", "team", "start", "period", r6("x").alias("x"), r6("y").alias("y"), "fast", "shot")


@query("turnover_summary", f"""{TURN_SQL}, two AS (SELECT match_id, team, x, fast, shot, true AS won FROM tn UNION ALL SELECT match_id, 1 - team, -x, fast, shot, false FROM tn)
SELECT match_id, team, count(*) FILTER (won) AS won, count(*) FILTER (won AND x >= 0) AS won_opp_half, count(*) FILTER (won AND fast) AS won_fast, count(*) FILTER (won AND shot) AS won_shot, count(*) FILTER (NOT won) AS lost,
 count(*) FILTER (NOT won AND x < -17.5e0) AS lost_own_third, count(*) FILTER (NOT won AND x > 17.5e0) AS lost_final_third, round(100e0*count(*) FILTER (won AND x >= 0)/greatest(count(*) FILTER (won),1),6) AS won_opp_half_pct FROM two GROUP BY match_id, team""", "stream")
def turnover_summary(spark, sf):
    """Wins per team, and losses as the opponent's wins mirrored into the loser's own frame."""
    t = find_turnovers(spark, sf)
    roles = F.explode(
        F.array(
            F.struct(F.col("team").alias("side"), F.col("x").alias("at"), F.lit(True).alias("won")),
            F.struct((1 - F.col("team")).alias("side"), (-F.col("x")).alias("at"), F.lit(False).alias("won")),
        )
    )
    d = t.select("match_id", "fast", "shot", roles.alias("r"))
    won, x = F.col("r.won"), F.col("r.at")
    return d.groupBy("match_id", F.col("r.side").alias("team")).agg(
        F.count_if(won).alias("won"), F.count_if(won & (x >= 0)).alias("won_opp_half"), F.count_if(won & F.col("fast")).alias("won_fast"),
        F.count_if(won & F.col("shot")).alias("won_shot"), F.count_if(~won).alias("lost"), F.count_if(~won & (x < -P.THIRD_X)).alias("lost_own_third"),
        F.count_if(~won & (x > P.THIRD_X)).alias("lost_final_third"),
        r6(100.0 * F.count_if(won & (x >= 0)) / F.greatest(F.count_if(won), big(F.lit(1)))).alias("won_opp_half_pct"),
    )


# ------------------------------------------------------------------ presses

PRESS_SQL = f"""{LIVE_SQL},
lk AS (SELECT *, max(CASE WHEN team=0 THEN clock_us END) OVER p AS p0, max(CASE WHEN team=1 THEN clock_us END) OVER p AS p1,
 min(CASE WHEN team=0 THEN clock_us END) OVER n AS n0, min(CASE WHEN team=1 THEN clock_us END) OVER n AS n1,
 last_value(CASE WHEN team=0 AND kind='PA' THEN {{'t': clock_us, 'x': x}} END IGNORE NULLS) OVER q AS q0, last_value(CASE WHEN team=1 AND kind='PA' THEN {{'t': clock_us, 'x': x}} END IGNORE NULLS) OVER q AS q1
 FROM lv WINDOW p AS (PARTITION BY match_id ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY match_id ORDER BY clock_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), q AS (PARTITION BY match_id ORDER BY clock_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
mk AS (SELECT *, CASE WHEN live AND value > 8 THEN 1 - team END AS pteam FROM lk),
pc2 AS (SELECT *, CASE WHEN pteam IS DISTINCT FROM lag(pteam) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM mk WINDOW w AS (PARTITION BY match_id ORDER BY clock_us, event_id)),
pi AS (SELECT *, sum(c) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS rid FROM pc2),
pr AS (SELECT match_id, pteam, rid, min(clock_us) AS s, max(clock_us) AS e FROM pi WHERE pteam IS NOT NULL GROUP BY match_id, pteam, rid),
pg AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY match_id, pteam ORDER BY s) < 10000000 THEN 0 ELSE 1 END AS nw FROM pr),
pk AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, pteam ORDER BY s) AS g FROM pg),
ps AS (SELECT match_id, pteam, min(s) AS s, max(e) AS e FROM pk GROUP BY match_id, pteam, g HAVING max(e) - min(s) >= 333333),
pf AS (SELECT ps.match_id, ps.pteam AS team, ps.s AS start, ps.e AS "end", a.user_id AS presser, CASE WHEN pteam=0 THEN a.x ELSE -a.x END AS x, CASE WHEN pteam=0 THEN a.y ELSE -a.y END AS y,
 coalesce(CASE WHEN pteam=0 THEN n0 ELSE n1 END - ps.s <= 15000000, false) AS won,
 CASE WHEN ps.s - CASE WHEN pteam=0 THEN p0 ELSE p1 END <= 10000000 THEN 'counter-press' WHEN q IS NULL OR ps.s - q.t > 20000000 THEN 'carry or first touch'
  WHEN (a.x - q.x) * CASE WHEN pteam=1 THEN 1 ELSE -1 END < -2 THEN 'back pass' WHEN abs(a.y) > 20.16e0 THEN 'pass out wide' ELSE 'other pass' END AS trigger
 FROM ps JOIN (SELECT *, CASE WHEN team=0 THEN q0 ELSE q1 END AS q FROM lk) a ON a.match_id = ps.match_id AND a.clock_us = ps.s)"""


@per_session
def find_presses(spark, sf):
    return views.presses(feed(spark, sf))


@query("presses", f"{PRESS_SQL} SELECT match_id, team, start, \"end\", presser, round(x,6)+0e0 AS x, round(y,6)+0e0 AS y, won FROM pf", "stream")
def presses(spark, sf):
    return find_presses(spark, sf).select("match_id", "team", "start", "end", "presser", r6("x").alias("x"), r6("y").alias("y"), "won")


@query("press_triggers", f"{PRESS_SQL} SELECT team, trigger, count(*) AS n, count(*) FILTER (won) AS won FROM pf GROUP BY team, trigger", "stream")
def press_triggers(spark, sf):
    return find_presses(spark, sf).groupBy("team", "trigger").agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("won"))


@query("press_summary", f"""{PRESS_SQL}, dm AS (SELECT match_id, 1-team AS team, count(*) FILTER (live)/5e0/60 AS m FROM lv GROUP BY match_id, 1-team)
SELECT dm.match_id, dm.team, count(pf.start) AS presses, count(*) FILTER (won) AS won_5s, round(coalesce(100e0*count(*) FILTER (won)/nullif(count(pf.start),0),0),6) AS win_rate, count(*) FILTER (x > 0) AS in_opp_half,
 round(coalesce(count(pf.start)/nullif(any_value(m),0),0),6) AS per_defending_min FROM dm LEFT JOIN pf ON dm.match_id = pf.match_id AND dm.team = pf.team GROUP BY dm.match_id, dm.team""", "stream")
def press_summary(spark, sf):
    p = find_presses(spark, sf).groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("won").alias("w"), F.count_if(F.col("x") > 0).alias("h")
    )
    dm = live_stream(spark, sf).groupBy("match_id", (1 - F.col("team")).alias("team")).agg((F.count_if("live") / 5.0 / 60).alias("m"))
    z = big(F.lit(0))
    d = dm.join(p, ["match_id", "team"], "left").withColumn("n", F.coalesce("n", z)).withColumn("w", F.coalesce("w", z))
    return d.select(
        "match_id", "team", F.col("n").alias("presses"), F.col("w").alias("won_5s"), r6(F.coalesce(F.try_divide(100.0 * F.col("w"), "n"), F.lit(0.0))).alias("win_rate"),
        F.coalesce("h", z).alias("in_opp_half"), r6(F.coalesce(F.try_divide(F.col("n").cast("double"), "m"), F.lit(0.0))).alias("per_defending_min"),
    )


@query("top_n", f"""{PRESS_SQL}, c AS (SELECT team, presser, count(*) AS n, count(*) FILTER (won) AS won FROM pf GROUP BY team, presser)
SELECT team, presser, n, won, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n DESC, presser) AS r FROM c) q WHERE r <= 5""", "stream")
def top_n(spark, sf):
    """Five busiest pressers per team; counted first, so the ranking sees one row per player."""
    c = find_presses(spark, sf).groupBy("team", "presser").agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("won"))
    r = F.row_number().over(Window.partitionBy("team").orderBy(F.col("n").desc(), "presser"))
    return c.withColumn("place", big(r)).where(F.col("place") <= 5)


# ------------------------------------------------------------------ chances

CHANCE_SQL = f"""{OPEN_SQL},
ch AS (SELECT *, CASE WHEN team IS DISTINCT FROM lag(team) OVER w THEN 1 ELSE 0 END AS c FROM op WINDOW w AS (PARTITION BY match_id ORDER BY clock_us, event_id)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS rid, row_number() OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS i FROM ch),
rn AS (SELECT match_id, team, rid, min(clock_us) AS s, max(clock_us) AS e, arg_min(x, i) AS fx, arg_min(open, i) AS fo FROM isl GROUP BY match_id, team, rid),
ak AS (SELECT *, (e - s >= 5000000 OR row_number() OVER (PARTITION BY match_id ORDER BY rid) = 1) AS anchor FROM rn),
hd AS (SELECT *, last_value(CASE WHEN anchor THEN team END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM ak),
fr AS (SELECT *, anchor AND (held IS NULL OR held <> team) AS fresh FROM hd),
bf AS (SELECT *, last_value(CASE WHEN fresh THEN {{'team': team, 's': s, 'x': fx, 'o': fo}} END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM fr),
bl AS (SELECT * FROM bf QUALIFY row_number() OVER (PARTITION BY match_id, s ORDER BY rid DESC) = 1),
rs AS (SELECT match_id, clock_us AS rt FROM (SELECT *, lag(live) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS was FROM lv) q WHERE live AND NOT was),
sh AS (SELECT match_id, event_id, team, clock_us AS t, clock_us - 1 AS pt, period FROM stream_v WHERE kind = 'SH'),
j AS (SELECT sh.*, bl.team AS lt, bl.s AS ls, bl.e AS le, bl.fx AS lx, bl.fo AS lopen, bl.b FROM sh ASOF JOIN bl ON sh.match_id = bl.match_id AND sh.pt >= bl.s),
k AS (SELECT j.*, rt FROM j ASOF LEFT JOIN rs ON j.match_id = rs.match_id AND j.t >= rs.rt),
h AS (SELECT *, b IS NOT NULL AND ((least(le, t-1) - ls < 5000000 AND lt <> team) OR b.team = lt) AS keep_b FROM k),
o AS (SELECT *, CASE WHEN keep_b THEN b.team ELSE lt END AS ht, CASE WHEN keep_b THEN b.s ELSE ls END AS hs, CASE WHEN keep_b THEN b.x ELSE lx END AS hx, CASE WHEN keep_b THEN b.o ELSE lopen END AS ho FROM h),
p AS (SELECT *, CASE WHEN ht = team THEN hs ELSE t END AS own, coalesce(rt, -1) AS rst FROM o),
q AS (SELECT *, greatest(own, rst, t - 20000000) AS st FROM p),
ct AS (SELECT match_id, event_id, team, period, t, st AS start, CASE WHEN rst = st THEN 'restart' WHEN own = st AND (ht <> team OR ho) THEN 'turnover' ELSE 'long' END AS kind,
 CASE WHEN rst <> st AND own = st AND ht = team AND ho THEN CASE WHEN hx*(CASE WHEN team=0 THEN 1 ELSE -1 END) < -17.5e0 THEN 'own' WHEN hx*(CASE WHEN team=0 THEN 1 ELSE -1 END) > 17.5e0 THEN 'final' ELSE 'middle' END END AS third,
 (SELECT count(*) FROM stream_v v WHERE v.match_id = q.match_id AND v.team = q.team AND v.kind = 'PA' AND v.clock_us >= q.st AND v.clock_us < q.t) AS passes FROM q)"""


@per_session
def trace_chances(spark, sf):
    return views.chances(feed(spark, sf))


@query("chances_traced", f"{CHANCE_SQL} SELECT match_id, event_id, team, start, kind, third, passes FROM ct", "stream")
def chances_traced(spark, sf):
    return trace_chances(spark, sf).select("match_id", "event_id", "team", "start", "kind", "third", "passes")


@query("chances_summary", f"""{CHANCE_SQL} SELECT match_id, 1 - team AS team, count(*) AS shots_faced, count(*) FILTER (kind='turnover') AS after_turnover, count(*) FILTER (kind='restart') AS after_restart, count(*) FILTER (kind='long') AS long_possession,
 count(*) FILTER (t - start <= 10000000) AS within_10s, count(*) FILTER (third='own') AS lost_final_third, count(*) FILTER (third='middle') AS lost_middle_third, count(*) FILTER (third='final') AS lost_own_third FROM ct GROUP BY match_id, 1 - team""", "stream")
def chances_summary(spark, sf):
    return sum_up_chances(trace_chances(spark, sf))


def sum_up_chances(chances):
    k = lambda v: F.count_if(F.col("kind") == v)
    z = lambda v: F.count_if(F.col("third") == v)
    return chances.groupBy("match_id", (1 - F.col("team")).alias("team")).agg(
        F.count(F.lit(1)).alias("shots_faced"), k("turnover").alias("after_turnover"), k("restart").alias("after_restart"), k("long").alias("long_possession"),
        F.count_if(F.col("t") - F.col("start") <= 10 * S).alias("within_10s"), z("own").alias("lost_final_third"), z("middle").alias("lost_middle_third"), z("final").alias("lost_own_third"),
    )


GOAL_SQL = "gl AS (SELECT match_id, team, CAST(floor(clock_us/60000000e0) AS BIGINT) + 1 AS minute, event_id AS goal_id, clock_us FROM stream_v WHERE kind = 'SH' AND value > 150)"


@per_session
def goals(spark, sf):
    s = stream(spark, sf).where((F.col("kind") == "SH") & (F.col("value") > 150))
    return s.select("match_id", "team", (F.floor(F.col("clock_us") / 60000000.0) + 1).alias("minute"), F.col("event_id").alias("goal_id"), "clock_us")


@query("goal_shot_match", f"""{GOAL_SQL}, gm AS (SELECT match_id, team, minute + CASE WHEN goal_id % 5 = 0 THEN 1 ELSE 0 END AS minute, goal_id FROM gl),
sh AS (SELECT match_id, team, CAST(floor(clock_us/60000000e0) AS BIGINT)+1 AS minute, arg_max(event_id, clock_us) AS shot_id FROM stream_v WHERE kind = 'SH' GROUP BY ALL)
SELECT gm.goal_id, gm.match_id, gm.team, gm.minute, shot_id, shot_id IS NULL AS unmatched FROM gm LEFT JOIN sh ON gm.match_id=sh.match_id AND gm.team=sh.team AND gm.minute=sh.minute""", "stream")
def goal_shot_match(spark, sf):
    """Each registered goal takes the scoring team's last shot in its minute; some registered minutes are off by one."""
    g = goals(spark, sf).drop("clock_us").withColumn("minute", F.col("minute") + F.when(F.col("goal_id") % 5 == 0, 1).otherwise(0))
    s = stream(spark, sf).where(F.col("kind") == "SH").groupBy("match_id", "team", (F.floor(F.col("clock_us") / 60000000.0) + 1).alias("minute"))
    s = s.agg(F.max_by("event_id", "clock_us").alias("shot_id"))
    return g.join(s, ["match_id", "team", "minute"], "left").select("goal_id", "match_id", "team", "minute", "shot_id", F.col("shot_id").isNull().alias("unmatched"))


@query("final_score", f"{GOAL_SQL} SELECT m.match_id, m.team, count(goal_id) AS goals FROM (SELECT DISTINCT match_id, team FROM stream_v) m LEFT JOIN gl ON m.match_id=gl.match_id AND m.team=gl.team GROUP BY ALL", "stream")
def final_score(spark, sf):
    s = stream(spark, sf)
    return s.groupBy("match_id", "team").agg(F.count_if((F.col("kind") == "SH") & (F.col("value") > 150)).alias("goals"))


@query("goal_groups", f"""{GOAL_SQL}, g AS (SELECT *, CASE WHEN team IS DISTINCT FROM lag(team) OVER w OR minute - lag(minute) OVER w > 3 THEN 1 ELSE 0 END AS nw FROM gl WINDOW w AS (PARTITION BY match_id ORDER BY clock_us, goal_id)),
k AS (SELECT *, sum(nw) OVER (PARTITION BY match_id ORDER BY clock_us, goal_id) AS g FROM g) SELECT match_id, team, min(minute) AS first_minute, max(minute) AS last_minute, count(*) AS goals FROM k GROUP BY match_id, team, g""", "stream")
def goal_groups(spark, sf):
    """Goals of one team within three minutes of each other share a label."""
    tl = stream_axis(spark, sf).on("clock_us", "goal_id")
    d = scan(goals(spark, sf), tl, was=prev(F.struct("team", "minute")))
    fresh = F.col("was").isNull() | (F.col("was.team") != F.col("team")) | (F.col("minute") - F.col("was.minute") > 3)
    d = scan(d, tl, head=prev(F.struct("clock_us", "goal_id"), when=fresh, inclusive=True))
    return d.groupBy("match_id", "team", "head").agg(
        F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.count(F.lit(1)).alias("goals")
    ).drop("head")


# ------------------------------------------------------------------ line-breaking passes

BREAK_SQL = f"""{LIVE_SQL}, nf AS (SELECT count(*) AS n FROM embeddings),
ps AS (SELECT match_id, event_id, team, clock_us, x, y, live, event_id % n AS frame FROM lv, nf WHERE kind = 'PA'),
rc AS (SELECT match_id, clock_us, team AS rteam, x AS rx, y AS ry FROM stream_v WHERE kind = 'OTB'),
c AS (SELECT ps.*, rc.clock_us AS rt, rteam, rx, ry, CASE WHEN ps.team = 1 THEN 1 ELSE -1 END AS sg FROM ps ASOF JOIN rc ON ps.match_id = rc.match_id AND ps.clock_us <= rc.clock_us),
d AS (SELECT *, x*sg AS x0, rx*sg AS x1, ry*sg AS y1 FROM c WHERE live AND rteam = team AND rt - clock_us <= 60000000 AND x*sg - rx*sg >= 5),
pl AS (SELECT d.event_id, x0, x1, CASE WHEN d.team = 1 THEN p.x ELSE -p.x END AS dx, row_number() OVER (PARTITION BY d.event_id ORDER BY CASE WHEN d.team = 1 THEN p.x ELSE -p.x END) AS r FROM d JOIN positions_v p ON p.frame = d.frame AND p.team = 1 - d.team AND NOT p.is_gk),
bt AS (SELECT event_id, count(*) FILTER (r <= 7 AND dx < x0 AND dx > x1) AS beaten, any_value(x1) < avg(dx) FILTER (r <= 4) AS behind FROM pl GROUP BY event_id HAVING count(*) >= 9),
lbk AS (SELECT d.match_id, d.event_id, 1 - d.team AS dteam, beaten, behind, x0, x1, y1, CASE WHEN y1 <= -20.16e0 THEN 'right wing' WHEN y1 <= -9.16e0 THEN 'right half-space' WHEN y1 <= 9.16e0 THEN 'centre' WHEN y1 <= 20.16e0 THEN 'left half-space' ELSE 'left wing' END AS lane FROM d JOIN bt ON d.event_id = bt.event_id WHERE beaten >= 3)"""

# the same with the receiver by order of events: of those at the pass's own time, only one with a greater id is next
NEXT_SQL = BREAK_SQL.replace(" FROM ps ASOF JOIN rc ON ps.match_id = rc.match_id AND ps.clock_us <= rc.clock_us)", " FROM ps JOIN rc ON ps.match_id = rc.match_id AND ps.event_id = rc.pass_id)").replace(
    """rc AS (SELECT match_id, clock_us, team AS rteam, x AS rx, y AS ry FROM stream_v WHERE kind = 'OTB')""",
    """nx AS (SELECT match_id, event_id AS pass_id, kind, first_value(CASE WHEN kind = 'OTB' THEN {'t': clock_us, 'team': team, 'x': x, 'y': y} END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY clock_us, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM stream_v),
rc AS (SELECT match_id, pass_id, n.t AS clock_us, n.team AS rteam, n.x AS rx, n.y AS ry FROM nx WHERE kind = 'PA' AND n IS NOT NULL)""",
)


@per_session
def find_line_breaks(spark, sf):
    """Completed passes that gain ground and bypass at least three of the deepest seven defenders.

    The next on-ball event receives the pass; events of one time are in the order of their ids.
    """
    return breaks_among(spark, sf, scan(live_stream(spark, sf), stream_axis(spark, sf), rc=receiver()))


def receiver():
    return nxt(F.struct("clock_us", "team", "x", "y"), when=F.col("kind") == "OTB")


def breaks_among(spark, sf, d):
    """Line-breaking passes among live rows that know their :func:`receiver` as ``rc``."""
    sg = F.when(F.col("team") == 1, 1).otherwise(-1)
    d = d.where((F.col("kind") == "PA") & F.col("live") & (F.col("rc.team") == F.col("team")) & (F.col("rc.clock_us") - F.col("clock_us") <= 60 * S))
    d = d.select("match_id", "event_id", "team", "user_id", "clock_us", (F.col("x") * sg).alias("x0"), (F.col("rc.x") * sg).alias("x1"), (F.col("rc.y") * sg).alias("y1"))
    d = d.where(F.col("x0") - F.col("x1") >= 5)
    m = moments(spark, sf).select("frame", "players")
    n = m.agg(F.count(F.lit(1)).alias("nf"))  # one row
    d = d.join(F.broadcast(n)).withColumn("frame", F.col("event_id") % F.col("nf")).join(m, "frame")
    own = F.when(F.col("team") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    xs = F.array_sort(F.transform(G.outfield(F.col("players"), 1 - F.col("team")), lambda p: p["x"] * own))
    d = d.withColumn("xs", xs).where(F.size("xs") >= 9)
    beaten = F.size(F.filter(F.slice("xs", 1, 7), lambda x: (x < F.col("x0")) & (x > F.col("x1"))))
    return d.select(
        "match_id", "event_id", "user_id", "clock_us", (1 - F.col("team")).alias("dteam"), big(beaten).alias("beaten"), (F.col("x1") < G.mean(F.slice("xs", 1, 4))).alias("behind"),
        "x0", "x1", "y1", P.lane5(F.col("y1")).alias("lane"),
    ).where(F.col("beaten") >= 3)


@query("line_breaks", f"{BREAK_SQL} SELECT match_id, event_id, dteam, beaten, behind, lane, round(x0,6)+0e0 AS x0, round(x1,6)+0e0 AS x1 FROM lbk", "positions stream")
def line_breaks(spark, sf):
    return find_line_breaks(spark, sf).select("match_id", "event_id", "dteam", "beaten", "behind", "lane", r6("x0").alias("x0"), r6("x1").alias("x1"))


@query("line_break_summary", f"""{NEXT_SQL} SELECT dteam, count(*) AS conceded, count(*) FILTER (behind) AS behind, count(*) FILTER (lane='right wing') AS right_wing, count(*) FILTER (lane='right half-space') AS right_half,
 count(*) FILTER (lane='centre') AS centre, count(*) FILTER (lane='left half-space') AS left_half, count(*) FILTER (lane='left wing') AS left_wing FROM lbk GROUP BY dteam""", "positions stream")
def line_break_summary(spark, sf):
    return sum_up_breaks(find_line_breaks(spark, sf))


def sum_up_breaks(breaks):
    lane = lambda v: F.count_if(F.col("lane") == v)
    return breaks.groupBy("dteam").agg(
        F.count(F.lit(1)).alias("conceded"), F.count_if("behind").alias("behind"), lane("right wing").alias("right_wing"), lane("right half-space").alias("right_half"),
        lane("centre").alias("centre"), lane("left half-space").alias("left_half"), lane("left wing").alias("left_wing"),
    )


@query("line_break_report", f"""{NEXT_SQL}, pb AS (SELECT l.*, s.user_id, s.clock_us FROM lbk l JOIN stream_v s ON s.event_id = l.event_id),
wh AS (SELECT match_id, dteam, user_id, count(*) AS n, min(struct_pack(a := clock_us, b := event_id)) AS f FROM pb GROUP BY ALL),
tp AS (SELECT match_id, dteam, string_agg(user_id || ' (' || n || ')', ', ' ORDER BY r) AS top_passers FROM (SELECT *, row_number() OVER (PARTITION BY match_id, dteam ORDER BY n DESC, f) AS r FROM wh) q WHERE r <= 5 GROUP BY ALL),
dm AS (SELECT match_id, 1-team AS dteam, count(*) FILTER (live)/5e0 AS secs FROM lv GROUP BY ALL),
cn AS (SELECT match_id, dteam, count(*) AS n, count(*) FILTER (behind) AS behind FROM pb GROUP BY ALL)
SELECT dm.match_id, CAST(dm.dteam AS INTEGER) AS dteam, coalesce(n, 0) AS conceded, coalesce(behind, 0) AS behind, top_passers, secs AS live_defending_s, round(coalesce(n, 0)/nullif(secs/60, 0),6) AS per_minute, round(secs/n,6) AS seconds_per_pass
FROM dm LEFT JOIN cn ON cn.match_id = dm.match_id AND cn.dteam = dm.dteam LEFT JOIN tp ON tp.match_id = dm.match_id AND tp.dteam = dm.dteam""", "positions stream")
def line_break_report(spark, sf):
    """Line-breaking passes conceded per match and side: the five busiest passers, rate per minute, seconds between them.

    Passers are counted before they are ranked; of equal ones the earlier comes first.
    """
    k = ["match_id", "dteam"]
    p = find_line_breaks(spark, sf)
    who = p.groupBy(*k, "user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("clock_us", "event_id")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*k).orderBy(F.col("n").desc(), "first"))
    named = F.struct(place.alias("place"), F.concat(F.col("user_id").cast("string"), F.lit(" ("), "n", F.lit(")")).alias("text"))
    who = who.select(*k, named.alias("p")).where(F.col("p.place") <= 5).groupBy(*k).agg(F.array_join(F.array_sort(F.collect_list("p"))["text"], ", ").alias("top_passers"))
    c = p.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.count_if("behind").alias("b"))
    d = live_stream(spark, sf).groupBy("match_id", (1 - F.col("team")).alias("dteam")).agg((F.count_if("live") / 5.0).alias("secs"))
    d = d.join(c, k, "left").join(who, k, "left").withColumn("conceded", F.coalesce("n", big(F.lit(0))))
    return d.select(
        *k, "conceded", F.coalesce("b", big(F.lit(0))).alias("behind"), "top_passers", F.col("secs").alias("live_defending_s"),
        r6(F.try_divide(F.col("conceded").cast("double"), F.col("secs") / 60)).alias("per_minute"), r6(F.try_divide("secs", F.col("n").cast("double"))).alias("seconds_per_pass"),
    )


# ------------------------------------------------------------------ lanes

FWD_SQL = """fw AS (SELECT *, CASE WHEN team=0 THEN x ELSE -x END AS ox, CASE WHEN team=0 THEN y ELSE -y END AS oy, lag(x) OVER w * CASE WHEN team=0 THEN 1 ELSE -1 END AS px, lag(team) OVER w = team AND lag(period) OVER w = period AS step
 FROM stream_v WINDOW w AS (PARTITION BY match_id ORDER BY clock_us, event_id)),
ln AS (SELECT *, CASE WHEN oy > 68e0/6 THEN 'left' WHEN oy < -68e0/6 THEN 'right' ELSE 'middle' END AS lane FROM fw)"""


@per_session
def forward_steps(spark, sf):
    return steps_among(scan(stream(spark, sf), stream_axis(spark, sf), was=event_before()))


def event_before():
    return prev(F.struct("team", "period", "x"))


def steps_among(d):
    """Rows that know the :func:`event_before` as ``was``, in their side's own frame, and whether they go on from it."""
    f = P.flip(F.col("team"))
    step = F.coalesce((F.col("was.team") == F.col("team")) & (F.col("was.period") == F.col("period")), F.lit(False))
    d = d.withColumn("ox", F.col("x") * f).withColumn("oy", F.col("y") * f).withColumn("px", F.col("was.x") * f).withColumn("step", step)
    return d.withColumn("lane", P.lane3(F.col("oy")))


@query("lane_shares", f"""{FWD_SQL}, a AS (SELECT match_id, team, coalesce(period, 0) AS period, lane, sum(ox - px) AS dx FROM ln WHERE step AND px > -17.5e0 AND ox - px > 0 GROUP BY GROUPING SETS ((match_id, team, period, lane), (match_id, team, lane)))
SELECT match_id, team, CAST(period AS INTEGER) AS period, lane, round(100e0*dx/sum(dx) OVER (PARTITION BY match_id, team, period),6) AS share FROM a""", "stream")
def lane_shares(spark, sf):
    """Share of forward ball movement per lane, per half and in total (period 0)."""
    return share_lanes(forward_steps(spark, sf))


def share_lanes(steps):
    d = steps.where(F.col("step") & (F.col("px") > -P.THIRD_X) & (F.col("ox") - F.col("px") > 0))
    k = ["match_id", "team", "period", "lane"]
    a = d.groupingSets([k, ["match_id", "team", "lane"]], *k).agg(F.sum(F.col("ox") - F.col("px")).alias("dx"))
    a = a.withColumn("period", F.coalesce("period", F.lit(0)))
    tot = F.sum("dx").over(Window.partitionBy("match_id", "team", "period"))
    return a.select(*k, r6(100.0 * F.col("dx") / tot).alias("share"))


@query("zone_entries", f"""RECURSIVE_{FWD_SQL}, cr AS (SELECT match_id, team, clock_us, lane, row_number() OVER (PARTITION BY match_id, team ORDER BY clock_us) AS r FROM ln WHERE step AND ox >= 17.5e0 AND px < 17.5e0),
wk AS (SELECT match_id, team, clock_us, lane, r, clock_us AS last, true AS keep FROM cr WHERE r = 1 UNION ALL SELECT c.match_id, c.team, c.clock_us, c.lane, c.r, CASE WHEN c.clock_us - w.last >= 60000000 THEN c.clock_us ELSE w.last END, c.clock_us - w.last >= 60000000 FROM wk w JOIN cr c ON c.match_id = w.match_id AND c.team = w.team AND c.r = w.r + 1)
SELECT match_id, team, lane, count(*) AS entries FROM wk WHERE keep GROUP BY ALL""", "stream")
def zone_entries(spark, sf):
    """Final-third entries, at most one per minute and team (greedy), by lane."""
    return count_entries(forward_steps(spark, sf))


def count_entries(steps):
    cross = steps.where(F.col("step") & (F.col("ox") >= P.THIRD_X) & (F.col("px") < P.THIRD_X)).select("match_id", "team", "clock_us", "lane")
    kept = rate_limit(cross, ["match_id", "team"], "clock_us", 60 * S)
    return cross.join(kept, ["match_id", "team", "clock_us"]).groupBy("match_id", "team", "lane").agg(F.count(F.lit(1)).alias("entries"))


# ------------------------------------------------------------------ series and medians

@query("rolling_median_grid", """g AS (SELECT match_id, team, k FROM (SELECT DISTINCT match_id, team FROM stream_v) m, range(0, (SELECT CAST(max(clock_us)//30000000 + 11 AS BIGINT) FROM stream_v)) t(k))
SELECT g.match_id, g.team, g.k AS half_minute, count(*) AS n, round(median(x),6) AS x FROM g JOIN stream_v s ON s.match_id = g.match_id AND s.team = g.team AND s.clock_us BETWEEN g.k*30000000 - 300000000 AND g.k*30000000 + 300000000 GROUP BY ALL HAVING count(*) >= 20""", "stream")
def rolling_median_grid(spark, sf):
    """Median within five minutes of every half-minute mark.

    The marks end where the samples do. Samples are counted per half-minute slot and value first; only those counts are
    copied to the marks they reach.
    """
    w = 30 * S
    slot = F.floor(F.col("clock_us") / w)
    c = stream(spark, sf).groupBy("match_id", "team", slot.alias("slot"), (F.col("clock_us") % w == 0).alias("on"), "x").agg(F.count(F.lit(1)).alias("n"))
    first = F.greatest(F.col("slot") - F.when(F.col("on"), 10).otherwise(9), big(F.lit(0)))
    last = F.col("slot") + 10
    c = c.withColumn("half_minute", F.explode(F.sequence(first, last)))
    k = ["match_id", "team", "half_minute"]
    c = c.groupBy(*k, "x").agg(F.sum("n").alias("n"))
    return c.groupBy(*k).agg(F.sum("n").alias("nn"), r6(F.percentile("x", 0.5, F.col("n"))).alias("xx")).where(F.col("nn") >= 20).select(
        *k, F.col("nn").alias("n"), F.col("xx").alias("x")
    )


@query("first_last_medians", f"""{LIVE_SQL} SELECT match_id, 1 - team AS dteam, round(median(x) FILTER (period = 1 AND clock_us < 900000000),6) AS first15, round(median(x) FILTER (period = 2 AND clock_us >= 4500000000),6) AS last15, round(median(x),6) AS whole FROM lv WHERE live GROUP BY match_id, 1 - team""", "stream")
def first_last_medians(spark, sf):
    return early_and_late(live_stream(spark, sf))


def early_and_late(live):
    d = live.where("live").withColumn("dteam", 1 - F.col("team"))
    part = (
        F.when((F.col("period") == 1) & (F.col("clock_us") < 900 * S), 1)
        .when((F.col("period") == 2) & (F.col("clock_us") >= 4500 * S), 2)
        .otherwise(0)
    )
    c = d.groupBy("match_id", "dteam", part.alias("part"), "x").agg(F.count(F.lit(1)).alias("n"))
    med = lambda cond: r6(F.percentile("x", 0.5, F.when(cond, F.col("n")).otherwise(big(F.lit(0)))))
    return c.groupBy("match_id", "dteam").agg(
        med(F.col("part") == 1).alias("first15"), med(F.col("part") == 2).alias("last15"), med(F.lit(True)).alias("whole")
    )


@query("player_minutes", "SELECT match_id, team, user_id, count(*) AS n, round(count(*)/(29.97e0/6)/60,6) AS minutes, round(median(x),6) AS med_x, round(median(y),6)+0e0 AS med_y FROM stream_v GROUP BY ALL HAVING count(*) >= 10", "stream")
def player_minutes(spark, sf):
    k = ["match_id", "team", "user_id"]
    s = stream(spark, sf)
    n = s.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 10)
    mx = grouped_percentile(s, k, "x", {"mx": 0.5}, bounded=True)
    my = grouped_percentile(s, k, "y", {"my": 0.5}, bounded=True)
    return n.join(mx, k).join(my, k).select(*k, "n", r6(F.col("n") / (29.97 / 6) / 60).alias("minutes"), r6("mx").alias("med_x"), r6("my").alias("med_y"))


@query("team_medians", "SELECT match_id, team, round(median(x),6) AS centre, round(quantile_cont(y,0.9) - quantile_cont(y,0.1),6) AS width FROM stream_v GROUP BY ALL", "stream")
def team_medians(spark, sf):
    k, s = ["match_id", "team"], stream(spark, sf)
    c = grouped_percentile(s, k, "x", {"centre": 0.5}, bounded=True)
    w = grouped_percentile(s, k, "y", {"lo": 0.1, "hi": 0.9}, bounded=True)
    return c.join(w, k).select(*k, r6("centre").alias("centre"), r6(F.col("hi") - F.col("lo")).alias("width"))
