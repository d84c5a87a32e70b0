"""Threshold calibration, correlations, lead-lag, game state and fixed-effects study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators import feed as views
from touchline.operators import geometry as G
from touchline.operators import play
from touchline.operators import states
from touchline.operators import stats as ST
from touchline.operators.feed import Feed
from touchline.operators.timeline import Timeline, grouped_percentile, scan, total
from touchline.plans.events import PRESS_SQL, find_presses
from touchline.plans.events import labelled as labelled_stream
from touchline.plans.frames import BLOCK_CASE, CELL_SQL, FREE_SQL, SHAPE_SQL, blocks, labelled, shapes
from touchline.plans.registry import big, query, r6
from touchline.plans.timeseries import LIVE_SQL, live_stream
from touchline.session import cut_lineage
from touchline.sources.driver_tables import feed, moments, per_session, stream, stream_axis, table

TAG_SQL = "tg AS (SELECT d.source, l.quality = 1 AS pos, d.n_chars / 20000e0 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@per_session
def tagged(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") / 20000.0).alias("score"))
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("pos")).join(d, "doc_id")


YOUDEN_SQL = """th AS (SELECT k, 0.05e0 + k*0.01e0 AS t FROM range(0,91) g(k)),
rt AS (SELECT {key} k, t, avg((score >= t)::INT) FILTER (pos) AS tpr, avg((score >= t)::INT) FILTER (NOT pos) AS fpr, count(*) FILTER (pos) AS p_n, count(*) FILTER (NOT pos) AS n_n FROM tg, th GROUP BY ALL),
yo AS (SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY round(tpr - fpr, 9) DESC, k) AS r FROM rt) q WHERE r = 1)"""


@query("youden_threshold", f"{TAG_SQL}, {YOUDEN_SQL.format(key='', part='')} SELECT round(t,6) AS threshold, round(tpr-fpr,6) AS j, round(tpr,6) AS tpr, round(fpr,6) AS fpr, p_n, n_n FROM yo")
def youden_threshold(spark, sf):
    y = ST.youden(tagged(spark, sf), [], F.col("score"), F.col("pos"))
    return y.select(r6("threshold").alias("threshold"), r6("j").alias("j"), r6("tpr").alias("tpr"), r6("fpr").alias("fpr"), "p_n", "n_n")


@query("pooled_threshold", f"""{TAG_SQL}, {YOUDEN_SQL.format(key='source,', part='PARTITION BY source')}, s AS (SELECT DISTINCT source FROM documents),
c AS (SELECT s.source, CASE WHEN p_n >= 30 AND n_n >= 30 THEN round(t,2) END AS own FROM s LEFT JOIN yo ON s.source = yo.source), m AS (SELECT round(median(own),2) AS pooled FROM c)
SELECT source, round(coalesce(own, pooled),6) AS threshold, own IS NULL AS is_pooled FROM c, m""")
def pooled_threshold(spark, sf):
    """Own threshold where both classes have enough tags, the median of those elsewhere."""
    y = ST.youden(tagged(spark, sf), ["source"], F.col("score"), F.col("pos"))
    own = F.when((F.col("p_n") >= ST.MIN_TAGS) & (F.col("n_n") >= ST.MIN_TAGS), F.round("threshold", 2))
    c = table(spark, sf, "documents").select("source").distinct().join(y.select("source", own.alias("own")), "source", "left")
    m = c.agg(F.round(F.median("own"), 2).alias("pooled"))  # one row
    return c.join(F.broadcast(m)).select("source", r6(F.coalesce("own", "pooled")).alias("threshold"), F.col("own").isNull().alias("is_pooled"))


@query("auc", f"""{TAG_SQL}, r AS (SELECT source, pos, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1)/2e0 AS rk FROM tg)
SELECT source, round((sum(rk) FILTER (pos) - count(*) FILTER (pos)*(count(*) FILTER (pos)+1)/2e0)/(count(*) FILTER (pos)*CAST(count(*) FILTER (NOT pos) AS DOUBLE)),6) AS auc, count(*) FILTER (pos) AS p_n, count(*) FILTER (NOT pos) AS n_n FROM r GROUP BY source HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0""")
def auc(spark, sf):
    a = ST.auc(tagged(spark, sf), ["source"], "score", F.col("pos")).where((F.col("p_n") > 0) & (F.col("n_n") > 0))
    return a.select("source", r6("auc").alias("auc"), "p_n", "n_n")


@query("pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice),6) AS r, count(*) AS n FROM lineitem GROUP BY 1")
def pearson(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("r"), F.count(F.lit(1)).alias("n"))


@query("partial_corr", """c AS (SELECT l_returnflag, corr(l_extendedprice, l_quantity) AS yx, corr(l_extendedprice, l_discount) AS yz, corr(l_quantity, l_discount) AS xz, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((yx - yz*xz)/sqrt((1-yz*yz)*(1-xz*xz)),6) AS r, n FROM c WHERE n >= 30""".replace("c AS", "WITH c AS", 1))
def partial_corr(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.corr("l_extendedprice", "l_quantity").alias("yx"), F.corr("l_extendedprice", "l_discount").alias("yz"), F.corr("l_quantity", "l_discount").alias("xz"), F.count(F.lit(1)).alias("n")
    )
    return c.where(F.col("n") >= 30).select("l_returnflag", r6(ST.partial_corr(F.col("yx"), F.col("yz"), F.col("xz"))).alias("r"), "n")


@query("anova_f", """WITH g AS (SELECT l_linestatus, l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, sum(n*m) OVER (PARTITION BY l_linestatus)/sum(n) OVER (PARTITION BY l_linestatus) AS gm FROM g)
SELECT l_linestatus, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, round((sum(n*(m-gm)*(m-gm))/(count(*)-1))/(sum(n*v)/(sum(n)-count(*))),6) AS f FROM t GROUP BY 1""")
def anova_f(spark, sf):
    a = ST.anova_f(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", "l_extendedprice")
    return a.select("l_linestatus", "k", "n", r6("f").alias("f"))


@query("quantile_report", """WITH e AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.2) AS q1, quantile_cont(l_extendedprice, 0.4) AS q2, quantile_cont(l_extendedprice, 0.6) AS q3, quantile_cont(l_extendedprice, 0.8) AS q4 FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, CAST((l_extendedprice > q1)::INT + (l_extendedprice > q2)::INT + (l_extendedprice > q3)::INT + (l_extendedprice > q4)::INT AS INTEGER) AS qbin, count(*) AS n, round(avg((l_discount > 0.05e0)::INT),6) AS rate, round(avg(l_extendedprice),4) AS mean_val
FROM lineitem l JOIN e ON l.l_returnflag = e.l_returnflag GROUP BY 1, 2""")
def quantile_report(spark, sf):
    """Outcome rate per value quintile of each group; the edges are one row per group, broadcast, so that rows stay where they are."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount")
    e = grouped_percentile(li, ["l_returnflag"], "l_extendedprice", {f"q{i}": i / 5 for i in range(1, 5)})
    b = sum(((F.col("l_extendedprice") > F.col(f"q{i}")).cast("int") for i in range(1, 5)), F.lit(0))
    return li.join(F.broadcast(e), "l_returnflag").groupBy("l_returnflag", b.alias("qbin")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("l_discount") > 0.05).cast("int"))).alias("rate"), r6(F.avg("l_extendedprice"), 4).alias("mean_val")
    )


@query("threshold_agreement", """WITH t AS (SELECT k*5e0 AS thr FROM range(1,11) g(k))
SELECT thr, round(avg(((l_quantity <= thr) = (l_extendedprice <= 40000))::INT),6) AS agreement, round(avg((l_quantity <= thr)::INT),6) AS share FROM lineitem, t GROUP BY thr""")
def threshold_agreement(spark, sf):
    """Agreement of a swept threshold with the current rule; rows collapse to (value, rule) counts first."""
    c = table(spark, sf, "lineitem").groupBy("l_quantity", (F.col("l_extendedprice") <= 40000).alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("thr", F.explode(F.array(*[F.lit(5.0 * k) for k in range(1, 11)])))
    low = F.col("l_quantity") <= F.col("thr")
    share = lambda cond: r6(F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n"))
    return c.groupBy("thr").agg(share(low == F.col("rule")).alias("agreement"), share(low).alias("share"))


# ------------------------------------------------------------------ lead-lag

SEC_SQL = "sc AS (SELECT match_id, period, CAST(floor(clock_us/1000000e0) AS BIGINT) AS sec, avg(CASE WHEN abs(y) > 20.4e0 THEN value END) AS wp, avg(x) AS dd FROM stream_v GROUP BY ALL)"


def seconds(spark, sf, *extra):
    sec = F.floor(F.col("clock_us") / 1000000.0).alias("sec")
    wide = F.avg(F.when(F.abs("y") > P.WIDE_Y, F.col("value")))
    return stream(spark, sf).groupBy("match_id", "period", *extra, sec).agg(wide.alias("wp"), F.avg("x").alias("dd"))


def lagged(s, keys):
    """Each second's wide pressure against the depth ``lag`` seconds later; joins the per-second table to itself."""
    a = s.where(F.col("wp").isNotNull()).select(*keys, "wp", F.explode(F.sequence(F.lit(-20), F.lit(20))).alias("lag"), "sec")
    a = a.select(*keys, "wp", "lag", (F.col("sec") + F.col("lag")).alias("sec"))
    return a.join(s.select(*keys, "sec", "dd"), [*keys, "sec"])


@query("lead_lag", f"{SEC_SQL} SELECT CAST(lag AS INTEGER) AS lag, round(corr(a.wp, b.dd),6) AS r, count(*) AS n FROM sc a, range(-20,21) g(lag), sc b WHERE a.match_id=b.match_id AND a.period=b.period AND b.sec = a.sec + lag AND a.wp IS NOT NULL GROUP BY lag HAVING count(*) >= 20", "stream")
def lead_lag(spark, sf):
    d = lagged(seconds(spark, sf), ["match_id", "period"])
    return d.groupBy("lag").agg(r6(F.corr("wp", "dd")).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 20)


@query("lead_lag_by_team", f"""{SEC_SQL.replace('period, CAST', 'period, team, CAST')}, c AS (SELECT a.team, lag, corr(a.wp, b.dd) AS r, count(*) AS n FROM sc a, range(-20,21) g(lag), sc b WHERE a.match_id=b.match_id AND a.period=b.period AND a.team=b.team AND b.sec = a.sec + lag AND a.wp IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)
SELECT team, CAST(lag AS INTEGER) AS best_lag, round(r,6) AS r, n FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY round(abs(r),9) DESC, lag) AS k FROM c) q WHERE k = 1""", "stream")
def lead_lag_by_team(spark, sf):
    """Strongest lag per team: the arg-max row of the correlation table."""
    d = lagged(seconds(spark, sf, "team"), ["match_id", "period", "team"])
    c = d.groupBy("team", "lag").agg(F.corr("wp", "dd").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 20)
    best = F.max(F.struct(F.round(F.abs("r"), 9).alias("a"), (-F.col("lag")).alias("l"), "r", "n"))
    return c.groupBy("team").agg(best.alias("b")).select("team", (-F.col("b.l")).alias("best_lag"), r6("b.r").alias("r"), "b.n")


@query("lead_lag_delta", f"{SEC_SQL} SELECT CAST(h AS INTEGER) AS horizon, round(corr(a.wp, b.dd - a.dd),6) AS r, count(*) AS n FROM sc a, (SELECT unnest([3,5,10,15]) AS h) g, sc b WHERE a.match_id=b.match_id AND a.period=b.period AND b.sec = a.sec + h AND a.wp IS NOT NULL GROUP BY h", "stream")
def lead_lag_delta(spark, sf):
    s = seconds(spark, sf)
    k = ["match_id", "period"]
    a = s.where(F.col("wp").isNotNull()).select(*k, "wp", F.col("dd").alias("d0"), "sec", F.explode(F.array(*map(F.lit, (3, 5, 10, 15)))).alias("horizon"))
    a = a.withColumn("sec", F.col("sec") + F.col("horizon")).join(s.select(*k, "sec", "dd"), [*k, "sec"])
    return a.groupBy("horizon").agg(r6(F.corr("wp", F.col("dd") - F.col("d0"))).alias("r"), F.count(F.lit(1)).alias("n"))


@query("shape_in_out", f"""{SHAPE_SQL} SELECT label, team, team = poss_team AS has_ball, count(*) AS n, round(median(depth),6) AS back_line, round(median(width),6) AS width, round(median(length),6) AS length, round(median(centre),6)+0e0 AS centre FROM shp GROUP BY ALL""", "positions")
def shape_in_out(spark, sf):
    """Median shape with and without the ball, all four measures from one percentile pass."""
    s = shapes(spark, sf).withColumn("has_ball", F.col("team") == F.col("poss"))
    long = s.select("label", "team", "has_ball", F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for c in ("depth", "width", "length", "centre")])).alias("q"))
    long = long.select("label", "team", "has_ball", F.col("q.m").alias("m"), F.col("q.v").alias("v"))
    med = grouped_percentile(long, ["label", "team", "has_ball", "m"], "v", {"p": 0.5})
    k = ["label", "team", "has_ball"]
    wide = med.groupBy(*k).agg(*[F.max(F.when(F.col("m") == c, r6("p"))).alias(a) for c, a in (("depth", "back_line"), ("width", "width"), ("length", "length"), ("centre", "centre"))])
    return s.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).join(wide, k)


# ------------------------------------------------------------------ game state

STATE_SQL = """gd AS (SELECT *, sum(CASE WHEN kind='SH' AND value > 150 THEN CASE WHEN team=0 THEN 1 ELSE -1 END ELSE 0 END) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS gdh FROM lv),
sd AS (SELECT gd.*, k AS side, CASE WHEN k = 0 THEN gdh ELSE -gdh END AS gdiff, live AND team <> k AS defending, live AND team = k AS has_ball, CASE WHEN k=0 THEN x ELSE -x END AS line FROM gd, range(0,2) t(k)),
sm AS (SELECT *, CASE WHEN gdiff > 0 THEN 'leading' WHEN gdiff < 0 THEN 'trailing' ELSE 'level' END AS state, CAST(floor(clock_us/300000000e0) AS BIGINT) AS bin FROM sd)"""


@per_session
def scored(spark, sf):
    """The feed with the score: ``gdh``, home goals so far less away goals."""
    f = feed(spark, sf)
    goal = (F.col("kind") == "SH") & (F.col("value") > 150)
    return Feed(scan(f.rows, f.axis, gdh=total(F.when(goal, F.when(F.col("team") == 0, 1).otherwise(-1)).otherwise(0))), f.axis)


@per_session
def samples(spark, sf):
    """One row per event and side: score state, defending or on the ball, line height in the side's own frame."""
    return both_sides(scored(spark, sf).live)


def both_sides(d):
    d = d.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    diff = F.when(F.col("side") == 0, F.col("gdh")).otherwise(-F.col("gdh"))
    return d.select(
        "match_id", "event_id", "clock_us", "period", "side", P.game_state(diff).alias("state"), F.floor(F.col("clock_us") / 300000000.0).alias("bin"),
        "live", (F.col("live") & (F.col("team") != F.col("side"))).alias("defending"), (F.col("live") & (F.col("team") == F.col("side"))).alias("has_ball"),
        (F.col("x") * P.flip(F.col("side"))).alias("line"),
    )


BINS_SQL = f"""{PRESS_SQL}, {STATE_SQL},
df AS (SELECT match_id, side, period, bin, state, count(*) AS n_def, median(line) AS line, avg(clock_us)/6e7 AS clock FROM sm WHERE defending GROUP BY ALL),
li AS (SELECT match_id, side, period, bin, state, count(*) AS n_live, 100e0*avg(has_ball::INT) AS possession FROM sm WHERE live GROUP BY ALL),
pp AS (SELECT pf.match_id, pf.team AS side, sm.period, sm.bin, sm.state, count(*) AS presses FROM pf JOIN sm ON pf.match_id=sm.match_id AND pf.team=sm.side AND pf.start=sm.clock_us GROUP BY ALL),
bb AS (SELECT coalesce(df.match_id, li.match_id) AS match_id, coalesce(df.side, li.side) AS side, coalesce(df.period, li.period) AS period, coalesce(df.bin, li.bin) AS bin, coalesce(df.state, li.state) AS state, coalesce(n_def,0) AS n_def, line, clock, coalesce(n_live,0) AS n_live, possession
 FROM df FULL JOIN li ON df.match_id=li.match_id AND df.side=li.side AND df.period=li.period AND df.bin=li.bin AND df.state=li.state),
bins AS (SELECT bb.*, coalesce(presses,0) AS presses FROM bb LEFT JOIN pp ON bb.match_id=pp.match_id AND bb.side=pp.side AND bb.period=pp.period AND bb.bin=pp.bin AND bb.state=pp.state)"""
BIN_KEYS = ["match_id", "side", "period", "bin", "state"]


@per_session
def state_bins(spark, sf):
    """Team-match x period x five minutes x state: medians, shares and presses, joined from three grouped tables."""
    s = samples(spark, sf)
    d = s.where("defending")
    c = d.groupBy(*BIN_KEYS, "line").agg(F.count(F.lit(1)).alias("n"), F.sum("clock_us").alias("ck"))
    df = c.groupBy(*BIN_KEYS).agg(F.sum("n").alias("n_def"), F.percentile("line", 0.5, F.col("n")).alias("med"), (F.sum("ck") / F.sum("n") / 6e7).alias("clock"))
    li = s.where("live").groupBy(*BIN_KEYS).agg(F.count(F.lit(1)).alias("n_live"), (100.0 * F.avg(F.col("has_ball").cast("int"))).alias("possession"))
    pr = find_presses(spark, sf).select("match_id", F.col("team").alias("side"), F.col("start").alias("clock_us"))
    pp = s.join(pr, ["match_id", "side", "clock_us"]).groupBy(*BIN_KEYS).agg(F.count(F.lit(1)).alias("presses"))
    z = big(F.lit(0))
    b = df.join(li, BIN_KEYS, "full").join(pp, BIN_KEYS, "left")
    return b.select(
        *BIN_KEYS, F.coalesce("n_def", z).alias("n_def"), F.col("med").alias("line"), "clock", F.coalesce("n_live", z).alias("n_live"), "possession", F.coalesce("presses", z).alias("presses")
    )


@query("game_state_bins", f"{BINS_SQL} SELECT match_id, CAST(side AS INTEGER) AS side, period, bin, state, n_def, round(line,6)+0e0 AS line, n_live, round(possession,6) AS possession, presses, round(presses/nullif(n_def*0.2e0/60,0),6) AS press_rate FROM bins", "stream")
def game_state_bins(spark, sf):
    b = state_bins(spark, sf)
    return b.select(*BIN_KEYS, "n_def", r6("line").alias("line"), "n_live", r6("possession").alias("possession"), "presses", r6(F.try_divide(F.col("presses").cast("double"), F.col("n_def") * 0.2 / 60)).alias("press_rate"))


@query("game_state_timing", f"""{LIVE_SQL}, {STATE_SQL}, d AS (SELECT *, CAST(floor(clock_us/900000000e0) AS BIGINT) AS band FROM sm WHERE defending)
SELECT band, round(count(*) FILTER (state='leading')*0.2e0/60,6) AS leading, round(count(*) FILTER (state='level')*0.2e0/60,6) AS level, round(count(*) FILTER (state='trailing')*0.2e0/60,6) AS trailing, round(median(line),6)+0e0 AS line FROM d GROUP BY band""", "stream")
def game_state_timing(spark, sf):
    d = samples(spark, sf).where("defending").withColumn("band", F.floor(F.col("clock_us") / 900000000.0))
    c = d.groupBy("band", "state", "line").agg(F.count(F.lit(1)).alias("n"))
    mins = lambda v: r6(F.sum(F.when(F.col("state") == v, F.col("n")).otherwise(0)) * 0.2 / 60)
    return c.groupBy("band").agg(mins("leading").alias("leading"), mins("level").alias("level"), mins("trailing").alias("trailing"), r6(F.percentile("line", 0.5, F.col("n"))).alias("lineh")).withColumnRenamed("lineh", "line")


@query("late_share", f"{LIVE_SQL}, {STATE_SQL} SELECT state, round(100e0*avg((clock_us >= 2700000000)::INT),6) AS late_pct, round(count(*)*0.2e0/60,6) AS def_minutes FROM sm WHERE defending GROUP BY state", "stream")
def late_share(spark, sf):
    return samples(spark, sf).where("defending").groupBy("state").agg(
        r6(100.0 * F.avg((F.col("clock_us") >= 2700 * play.SECOND).cast("int"))).alias("late_pct"), r6(F.count(F.lit(1)) * 0.2 / 60).alias("def_minutes")
    )


# ------------------------------------------------------------------ state study with every measure

STUDY_SQL = f"""{PRESS_SQL}, {STATE_SQL}, {SHAPE_SQL}, {CELL_SQL}, {FREE_SQL},
ha AS (SELECT frame, count(*) FILTER (hole) AS holes FROM cells GROUP BY frame), fa AS (SELECT frame, count(*) AS free FROM free GROUP BY frame), nf AS (SELECT count(*) AS n FROM embeddings),
mm AS (SELECT s.frame, s.length, s.width, {BLOCK_CASE} AS structure, CASE WHEN b.frame IS NOT NULL THEN coalesce(holes, 0) END AS holes, CASE WHEN b.frame IS NOT NULL THEN coalesce(free, 0) END AS free
 FROM shp s LEFT JOIN (SELECT DISTINCT frame FROM box) b ON b.frame = s.frame LEFT JOIN ha ON ha.frame = s.frame LEFT JOIN fa ON fa.frame = s.frame WHERE s.team <> s.poss_team),
fs AS (SELECT sm.match_id, sm.event_id, sm.clock_us, sm.side, sm.period, sm.bin, sm.state, sm.live, sm.defending, sm.has_ball, sm.line, mm.length, mm.width, mm.structure, mm.holes, mm.free FROM sm CROSS JOIN nf LEFT JOIN mm ON mm.frame = sm.event_id % n WHERE sm.live),
sb AS (SELECT match_id, side, period, bin, state, count(*) FILTER (defending) AS n_def, count(*) FILTER (defending AND structure IS NOT NULL) AS n_org, count(*) AS n_live,
 median(line) FILTER (defending) AS line, median(length) FILTER (defending) AS length, median(width) FILTER (defending) AS width, avg(holes) FILTER (defending) AS holes, avg(free) FILTER (defending) AS free,
 100e0*avg((structure = 'High Press')::INT) FILTER (defending) AS high, 100e0*avg((structure = 'Low Block')::INT) FILTER (defending) AS low, 100e0*avg(has_ball::INT) AS possession,
 coalesce(avg(clock_us) FILTER (defending), avg(clock_us))/6e7 AS clock FROM fs GROUP BY match_id, side, period, bin, state),
pq AS (SELECT match_id, side, period, bin, state, count(*) AS presses FROM (SELECT sm.* FROM pf JOIN sm ON pf.match_id=sm.match_id AND pf.team=sm.side AND pf.start=sm.clock_us) z GROUP BY ALL),
study AS (SELECT sb.*, coalesce(presses, 0) AS presses FROM sb LEFT JOIN pq USING (match_id, side, period, bin, state))"""
ROUNDED = ("line", "length", "width", "holes", "free", "high", "low", "possession", "clock")


@per_session
def defending_blocks(spark, sf):
    """Length, width, structure, hole area and free opponents of the defending block, one row per frame."""
    b = blocks(spark, sf).withColumn("free", F.size(G.free_players(F.col("o"), F.col("d"), F.col("edges"))))
    gaps = G.block_areas(b, "free").select("frame", "holes", "free")
    return labelled(spark, sf).where(F.col("team") != F.col("poss")).select("frame", "length", "width", "structure").join(gaps, "frame", "left")


def study_bins(spark, sf):
    """Bins of the study; live flags, score and blocks are read several times, so they are stored once."""
    kept = scored(spark, sf).kept("gdh")
    n = moments(spark, sf).agg(F.count(F.lit(1)).alias("frames"))  # one row
    both = both_sides(kept.live)
    d = both.where("live").join(F.broadcast(n)).withColumn("frame", F.col("event_id") % F.col("frames")).join(cut_lineage(defending_blocks(spark, sf)), "frame", "left")
    pr = views.presses(kept).select("match_id", F.col("team").alias("side"), F.col("start").alias("clock_us"))
    pressed = both.join(pr, ["match_id", "side", "clock_us"]).select(*BIN_KEYS)
    d = states.bins(d.withColumn("clock", F.col("clock_us")), pressed, BIN_KEYS)
    return d.withColumn("clock", F.col("clock") / 6e7)  # whole microseconds add up exactly, minutes do not


@query("state_study", f"""{STUDY_SQL} SELECT match_id, CAST(side AS INTEGER) AS side, period, bin, state, n_def, n_org, n_live, presses, {", ".join(f"round({c},6)+0e0 AS {c}" for c in ROUNDED)},
 round(presses/nullif(n_def*0.2e0/60,0),6) AS press_rate FROM study""", "positions stream")
def state_study(spark, sf):
    """Team-match x period x five minutes x state with all block measures, shares, weights and presses."""
    return study_bins(spark, sf).select(*BIN_KEYS, "n_def", "n_org", "n_live", "presses", *[r6(c).alias(c) for c in (*ROUNDED, "press_rate")])


EFFECT_SQL = " UNION ALL ".join(
    f"SELECT match_id, side, state, '{m}' AS measure, CAST({m} AS DOUBLE) AS y, CAST({states.WEIGHTS.get(m, 'n_def')} AS DOUBLE) AS w, {'n_live' if m == 'possession' else 'n_def'}*0.2e0/60 AS mins FROM study"
    for m in states.MEASURES
)


@query("state_effects", f"""{STUDY_SQL}, lg AS ({EFFECT_SQL}),
vs AS (SELECT lg.*, v.s AS versus, (state <> 'level')::INT AS x FROM lg, (VALUES ('leading'), ('trailing')) v(s) WHERE (state = 'level' OR state = v.s) AND y IS NOT NULL AND w*0.2e0 >= 0.2e0),
kt AS (SELECT measure, versus, match_id, side, sum(w*y)/sum(w) AS my, sum(w*x)/sum(w) AS mx FROM vs GROUP BY ALL HAVING sum(CASE WHEN x = 1 THEN mins END) >= 0.01e0 AND sum(CASE WHEN x = 0 THEN mins END) >= 0.01e0)
SELECT measure, versus AS state, round(sum(w*(x-mx)*(y-my))/sum(w*(x-mx)*(x-mx)),6)+0e0 AS effect, count(DISTINCT match_id*2+side) AS teams FROM vs JOIN kt USING (measure, versus, match_id, side) GROUP BY measure, versus HAVING count(DISTINCT match_id*2+side) >= 3""", "positions stream")
def state_effects(spark, sf):
    """Within team-matches, what leading and trailing change in every measure, each by its own weights."""
    d = states.effects(study_bins(spark, sf), ["match_id", "side"], min_bin_s=0.2, min_state_min=0.01)
    return d.withColumn("effect", r6("effect"))


# ------------------------------------------------------------------ fixed-effects study

WLS_SQL = f"""{BINS_SQL}, d0 AS (SELECT *, match_id*2 + side AS tm, (state='leading')::INT AS xs FROM bins WHERE state IN ('level','leading') AND line IS NOT NULL AND n_def > 0),
kp AS (SELECT tm FROM d0 GROUP BY tm HAVING sum(CASE WHEN xs=1 THEN n_def END) >= 5 AND sum(CASE WHEN xs=0 THEN n_def END) >= 5),
d1 AS (SELECT d0.*, line - sum(line*n_def) OVER (PARTITION BY tm)/sum(n_def) OVER (PARTITION BY tm) AS yd, xs - sum(xs*n_def) OVER (PARTITION BY tm)/sum(n_def) OVER (PARTITION BY tm) AS xd FROM d0 SEMI JOIN kp ON d0.tm = kp.tm)"""


def study_rows(spark, sf, spline: bool):
    """Bins of team-matches seen in both states; outcome, state dummy and (optionally) the clock basis."""
    b = state_bins(spark, sf).where(F.col("state").isin("level", "leading") & F.col("line").isNotNull() & (F.col("n_def") > 0))
    b = b.withColumn("xs", (F.col("state") == "leading").cast("double")).withColumnRenamed("line", "ys")
    u = Window.partitionBy("match_id", "side")
    enough = lambda v: F.sum(F.when(F.col("xs") == v, F.col("n_def"))).over(u) >= 5
    b = b.withColumn("ok", enough(1) & enough(0)).where("ok")
    if not spline:
        return b, ["ys", "xs"]
    knots = b.agg(F.min("clock").alias("k0"), F.percentile("clock", 0.5).alias("k1"), F.max("clock").alias("k2"))  # one row
    b = b.join(F.broadcast(knots))
    cols = ST.spline_columns(F.col("clock"), F.col("k0"), F.col("k1"), F.col("k2"))
    return b.withColumns({f"b{i}": c for i, c in enumerate(cols)}), ["ys", "xs", "b0", "b1", "b2", "b3"]


def match_sums(spark, sf, spline):
    d, cols = study_rows(spark, sf, spline)
    return ST.within_moments(d, ["match_id", "side"], ["match_id"], cols, "n_def"), cols


@query("fe_wls_effect", f"{WLS_SQL} SELECT round(sum(n_def*xd*yd)/sum(n_def*xd*xd),6) AS estimate, count(DISTINCT tm) AS n_teams, count(DISTINCT match_id) AS n_matches FROM d1", "stream")
def fe_wls_effect(spark, sf):
    """Effect of leading on line height within team-matches, weighted by defending time, no time control."""
    d, cols = study_rows(spark, sf, False)
    m = ST.within_moments(d, ["match_id", "side"], ["match_id", "side"], cols, "n_def")
    return m.agg(
        r6(F.sum("ys__xs") / F.sum("xs__xs")).alias("estimate"), F.count(F.lit(1)).alias("n_teams"), F.count_distinct("match_id").alias("n_matches")
    )


@query("leave_one_out", f"{WLS_SQL}, m AS (SELECT match_id, sum(n_def*xd*yd) AS xy, sum(n_def*xd*xd) AS xx FROM d1 GROUP BY match_id), t AS (SELECT sum(xy) AS txy, sum(xx) AS txx FROM m) SELECT match_id, round((txy-xy)/(txx-xx),6) AS estimate FROM m, t", "stream")
def leave_one_out(spark, sf):
    """Estimate without each match: the total of the sums minus that match's own."""
    m, _ = match_sums(spark, sf, False)
    t = m.agg(F.sum("ys__xs").alias("txy"), F.sum("xs__xs").alias("txx"))  # one row
    return m.join(F.broadcast(t)).select("match_id", r6((F.col("txy") - F.col("ys__xs")) / (F.col("txx") - F.col("xs__xs"))).alias("estimate"))


@query("subset_effects", f"{WLS_SQL} SELECT CASE WHEN match_id < 6 THEN 'first' ELSE 'second' END AS subset, round(sum(n_def*xd*yd)/sum(n_def*xd*xd),6) AS estimate, count(DISTINCT tm) AS n_teams FROM d1 GROUP BY 1 UNION ALL SELECT 'all', round(sum(n_def*xd*yd)/sum(n_def*xd*xd),6), count(DISTINCT tm) FROM d1", "stream")
def subset_effects(spark, sf):
    """The effect for all matches and per provider: each match's sums count for both of its subsets."""
    d, cols = study_rows(spark, sf, False)
    m = ST.within_moments(d, ["match_id", "side"], ["match_id", "side"], cols, "n_def")
    mine = F.when(F.col("match_id") < 6, "first").otherwise("second")
    m = m.withColumn("subset", F.explode(F.array(F.lit("all"), mine)))
    return m.groupBy("subset").agg(r6(F.sum("ys__xs") / F.sum("xs__xs")).alias("estimate"), F.count(F.lit(1)).alias("n_teams"))


@query("lead_lag_organised", """lb AS (SELECT *, abs(CASE WHEN team = 1 THEN -52.5e0 ELSE 52.5e0 END - x) * 0.6e0 AS dep FROM stream_v),
sc AS (SELECT match_id, period, CAST(floor(clock_us/1000000e0) AS BIGINT) AS sec, avg(CASE WHEN abs(y) > 20.4e0 THEN value END) AS wp, avg(x) AS dd FROM lb WHERE dep >= 32 OR abs(y) <= 20 GROUP BY ALL)
SELECT CAST(lag AS INTEGER) AS lag, round(corr(a.wp, b.dd),6) AS r, count(*) AS n FROM sc a, range(-20,21) g(lag), sc b WHERE a.match_id=b.match_id AND a.period=b.period AND b.sec = a.sec + lag AND a.wp IS NOT NULL GROUP BY lag HAVING count(*) >= 20""", "stream")
def lead_lag_organised(spark, sf):
    """Lead-lag over organised defence only."""
    d = labelled_stream(spark, sf).where((F.col("depth") >= 32) | (F.abs("y") <= 20))
    sec = F.floor(F.col("clock_us") / 1000000.0).alias("sec")
    s = d.groupBy("match_id", "period", sec).agg(F.avg(F.when(F.abs("y") > P.WIDE_Y, F.col("value"))).alias("wp"), F.avg("x").alias("dd"))
    d = lagged(s, ["match_id", "period"])
    return d.groupBy("lag").agg(r6(F.corr("wp", "dd")).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 20)


@query("team_effects", f"""{WLS_SQL}, pt AS (SELECT tm, sum(line*n_def) FILTER (xs=1)/sum(n_def) FILTER (xs=1) - sum(line*n_def) FILTER (xs=0)/sum(n_def) FILTER (xs=0) AS diff FROM d1 GROUP BY tm), e AS (SELECT sum(n_def*xd*yd)/sum(n_def*xd*xd) AS est FROM d1)
SELECT tm // 2 AS match_id, CAST(tm % 2 AS INTEGER) AS side, round(diff,6)+0e0 AS diff, sign(diff) = sign(est) AS same_direction FROM pt, e""", "stream")
def team_effects(spark, sf):
    d, cols = study_rows(spark, sf, False)
    m = ST.within_moments(d, ["match_id", "side"], ["match_id", "side"], cols, "n_def")
    est = m.agg((F.sum("ys__xs") / F.sum("xs__xs")).alias("est"))  # one row
    w = F.col("n_def")
    mean = lambda v: F.sum(F.when(F.col("xs") == v, F.col("ys") * w)) / F.sum(F.when(F.col("xs") == v, w))
    p = d.groupBy("match_id", "side").agg((mean(1) - mean(0)).alias("diff")).join(F.broadcast(est))
    return p.select("match_id", "side", r6("diff").alias("diff"), (F.signum("diff") == F.signum("est")).alias("same_direction"))


@query("fe_wls_spline")
def fe_wls_spline(spark, sf):
    """The same effect with a cubic spline of match time held fixed."""
    m, cols = match_sums(spark, sf, True)
    sums = m.agg(*[F.sum(c).alias(c) for c in m.columns if c != "match_id"]).withColumn("model", F.lit("spline"))
    return ST.fit_rows(sums, ["model"], cols).select("model", r6("estimate").alias("estimate"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf, reps: int = 2000, seed: int = 0):
    """95 % interval over 2000 resamplings of whole matches; only per-match sums are re-weighted."""
    m, cols = match_sums(spark, sf, True)
    m = cut_lineage(m)  # one row per match, read four times below
    n = m.agg(F.count(F.lit(1)).alias("nc"))  # one row
    ids = m.select("match_id")
    numbered = scan(ids.withColumn("all", F.lit(0)), Timeline(("all",), "match_id"), no=total(big(F.lit(1)))).withColumn("no", F.col("no") - 1)
    numbered = numbered.join(F.broadcast(n)).select("no", "match_id", "nc")
    times = ST.resample(numbered, "match_id", F.col("nc"), reps, seed)
    sums = [c for c in m.columns if c != "match_id"]
    rep = times.join(m, "match_id").groupBy("rep").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in sums])
    est = ST.fit_rows(rep.where(F.col("xs__xs") > 0), ["rep"], cols)
    return est.agg(r6(F.percentile("estimate", 0.025)).alias("lo"), r6(F.percentile("estimate", 0.975)).alias("hi"), F.count(F.lit(1)).alias("reps"))
