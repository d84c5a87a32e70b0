"""Comparison board, ranks, merges with published results, dimension joins, text."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.functions import text as T
from touchline.operators import feed as views
from touchline.operators.timeline import fit_timeline, row_index, scan, total
from touchline.plans.events import (
    PRESS_SQL, TURN_SQL, CHANCE_SQL, breaks_among, count_entries, early_and_late, event_before, find_presses, find_turnovers, press_summary, receiver,
    share_lanes, steps_among, sum_up_breaks, sum_up_chances, trace_chances, turnover_summary,
)
from touchline.plans.frames import gap_summary
from touchline.plans.registry import QUERIES, big, query, r6
from touchline.plans.timeseries import LIVE_SQL, live_stream
from touchline.session import cut_lineage
from touchline.sources.driver_tables import feed, per_session, stream, table

# ------------------------------------------------------------------ board

BOARD_SQL = f"""{TURN_SQL}, {PRESS_SQL.replace(LIVE_SQL + ",", "")},
lp AS (SELECT match_id, round(count(*) FILTER (live)*6/29.97e0/60,6) AS live_min, 100e0*count(*) FILTER (live AND team=0)/greatest(count(*) FILTER (live),1) AS home_pct FROM lv GROUP BY match_id),
sh AS (SELECT match_id, team, count(*) FILTER (kind='SH') AS shots, median(CASE WHEN team=0 THEN x ELSE -x END) AS line FROM stream_v GROUP BY match_id, team),
tw AS (SELECT match_id, team, count(*) AS wins, round(100e0*count(*) FILTER (x >= 0)/count(*),6) AS wins_high, count(*) FILTER (fast) AS fast FROM tn GROUP BY match_id, team),
pw AS (SELECT match_id, team, round(100e0*count(*) FILTER (won)/count(*),6) AS press_won FROM pf GROUP BY match_id, team),
board AS (SELECT s.match_id, s.team, 1 - s.team AS opp, round(CASE WHEN s.team=0 THEN home_pct ELSE 100-home_pct END,6) AS possession, round(s.line+52.5e0,6) AS back_line, coalesce(wins,0) AS wins, wins_high, coalesce(fast,0) AS fast, s.shots AS shots_for, coalesce(o.shots, 0) AS shots_against, live_min, press_won
 FROM sh s LEFT JOIN sh o ON s.match_id=o.match_id AND o.team = 1 - s.team JOIN lp ON lp.match_id = s.match_id LEFT JOIN tw ON tw.match_id=s.match_id AND tw.team=s.team LEFT JOIN pw ON pw.match_id=s.match_id AND pw.team=s.team)"""


@per_session
def make_board(spark: SparkSession, sf: str):
    """One row per team and match, joined from the view summaries on (match, team)."""
    return views.board(feed(spark, sf))


@query("board", f"{BOARD_SQL} SELECT * FROM board", "stream")
def board(spark, sf):
    return make_board(spark, sf)


# Board field, higher ranks first, word for first place.
CHIPS = (("back_line", True, "highest"), ("wins_high", True, "highest"), ("press_won", True, "best"), ("shots_against", False, "fewest"))
CHIP_ROWS = " UNION ALL ".join(
    f"SELECT match_id, team, '{c}' AS metric, CAST({c} AS DOUBLE) AS v, {'-1e0' if up else '1e0'}*{c} AS o, '{w}' AS best FROM board WHERE {c} IS NOT NULL" for c, up, w in CHIPS
)


@query("rank_chips", f"""{BOARD_SQL}, cps AS ({CHIP_ROWS}), rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY o) AS rank, count(*) OVER (PARTITION BY metric) AS n_of FROM cps)
SELECT match_id, team, metric, v AS value, rank, rank || CASE WHEN rank % 100 BETWEEN 10 AND 20 THEN 'th' WHEN rank % 10 = 1 THEN 'st' WHEN rank % 10 = 2 THEN 'nd' WHEN rank % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || n_of || CASE WHEN rank = 1 THEN ' (' || best || ')' ELSE '' END AS rank_text FROM rk""", "stream")
def rank_chips(spark, sf):
    """Rank of every team-match per metric, ties sharing the better rank.

    Ranks come from running counts over distinct values, so no metric is sorted in one task.
    """
    b = cut_lineage(make_board(spark, sf))  # a small result table, read three times below
    one = lambda c, up, w: F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), (F.col(c) * (-1.0 if up else 1.0)).alias("o"), F.lit(w).alias("best"))
    d = b.select("match_id", "team", F.explode(F.array(*[one(*c) for c in CHIPS])).alias("c")).select("match_id", "team", "c.*").where(F.col("value").isNotNull())
    c = d.groupBy("metric", "o").agg(F.count(F.lit(1)).alias("n"))
    c = scan(c, fit_timeline(c, ["metric"], "o"), upto=total(F.col("n")))
    c = c.select("metric", "o", (F.col("upto") - F.col("n") + 1).alias("rank"))
    of = d.groupBy("metric").agg(F.count(F.lit(1)).alias("n_of"))
    d = d.join(c, ["metric", "o"]).join(of, "metric")
    return d.select("match_id", "team", "metric", "value", "rank", T.rank_text(F.col("rank"), F.col("n_of"), F.col("best")).alias("rank_text"))


@query("board_sort", f"{BOARD_SQL}, r AS (SELECT min(shots_for) AS lo, max(shots_for) AS hi FROM board) SELECT match_id, team, shots_for, round(CASE WHEN hi > lo THEN (shots_for - lo)*100e0/(hi - lo) ELSE 0 END,6) AS bar FROM board, r ORDER BY shots_for DESC, match_id, team", "stream")
def board_sort(spark, sf, column: str = "shots_for", descending: bool = True):
    """Board ordered by any column, with the bar length relative to the column's range."""
    b = make_board(spark, sf).select("match_id", "team", column)
    r = b.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    v = F.col(column)
    bar = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) * 100.0 / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return b.join(F.broadcast(r)).select("match_id", "team", column, r6(bar).alias("bar")).orderBy(v.desc() if descending else v.asc(), "match_id", "team")


# ------------------------------------------------------------------ merges and joins

@query("publish_merge", """WITH pub AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice),2) AS total, 'published' AS src FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
fresh AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice),2) AS total, 'new' AS src FROM orders GROUP BY 1)
SELECT * FROM pub UNION ALL SELECT * FROM fresh WHERE k NOT IN (SELECT k FROM pub)""")
def publish_merge(spark, sf):
    """Published keys keep their published numbers; only keys not yet published are added."""
    o = table(spark, sf, "orders")
    summed = lambda d, s: d.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("total")).withColumn("src", F.lit(s))
    pub = summed(o.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")), "published")
    return pub.unionByName(summed(o, "new").join(pub.select("k"), "k", "left_anti"))


@query("complete_matches", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS views FROM customer WHERE c_acctbal > 5000 GROUP BY 1 HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer)")
def complete_matches(spark, sf):
    """Keys for which every kind of view exists."""
    c = table(spark, sf, "customer")
    need = c.agg(F.count_distinct("c_mktsegment").alias("need"))  # one row
    have = c.where(F.col("c_acctbal") > 5000).groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("views"))
    return have.join(F.broadcast(need)).where(F.col("views") == F.col("need")).select("c_nationkey", "views")


@query("missing_reports", "SELECT c_custkey AS k, 'no orders' AS what FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_orderkey, 'no lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_reports(spark, sf):
    c, o, li = (table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    a = c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti").withColumn("what", F.lit("no orders"))
    b = o.select(F.col("o_orderkey").alias("k")).join(li.select(F.col("l_orderkey").alias("k")), "k", "left_anti").withColumn("what", F.lit("no lines"))
    return a.unionByName(b)


LI_REST = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("dedup_first", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LI_REST)}) AS r FROM lineitem) q WHERE r = 1")
def dedup_first(spark, sf):
    """First row per key in a total order; a minimum combines before the shuffle where a ranking cannot."""
    first = F.min(F.struct(*LI_REST)).alias("f")
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first)
    return d.select("l_orderkey", "l_linenumber", "f.l_partkey", "f.l_quantity", "f.l_extendedprice")


@query("merge_left_checked", """WITH li AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT count(*) AS n_left, count(*) AS n_joined, count(*) FILTER (q IS NULL) AS n_missing, round(100e0*count(*) FILTER (q IS NULL)/count(*),6) AS missing_pct FROM orders LEFT JOIN li ON o_orderkey = l_orderkey""")
def merge_left_checked(spark, sf):
    """Left join on a key made unique first; the row count before and after is part of the result."""
    o = table(spark, sf, "orders").select("o_orderkey")
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    j = o.join(li, "o_orderkey", "left").agg(F.count(F.lit(1)).alias("n_joined"), F.count_if(F.col("q").isNull()).alias("n_missing"))
    n = o.agg(F.count(F.lit(1)).alias("n_left"))
    return n.join(F.broadcast(j)).select("n_left", "n_joined", "n_missing", r6(100.0 * F.col("n_missing") / F.col("n_joined")).alias("missing_pct"))


@query("join_inner", "SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity < 25 GROUP BY 1, 2")
def join_inner(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, sf, "lineitem").where(F.col("l_quantity") < 25)
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    return j.groupBy("o_orderpriority", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("join_full", """WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(c.k, s.k) AS nation, coalesce(customers,0) AS customers, coalesce(suppliers,0) AS suppliers FROM c FULL JOIN s ON c.k = s.k""")
def join_full(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_acctbal") > 9000).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf, "supplier").where(F.col("s_acctbal") > 5000).groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    z = big(F.lit(0))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", z).alias("customers"), F.coalesce("suppliers", z).alias("suppliers"))


@query("dim_join", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal),2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def dim_join(spark, sf):
    """Dimension lookups after the facts are reduced to one row per key; the join side is chosen by measured size."""
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("b"))
    j = c.join(table(spark, sf, "nation"), "n_nationkey").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), r6(F.sum("b"), 2).alias("balance"))


@query("opponent_pair", """t AS (SELECT match_id, team, count(*) FILTER (kind='SH') AS shots, round(avg(x),6) AS x FROM stream_v GROUP BY 1, 2)
SELECT a.match_id, a.team, a.shots AS shots_for, b.shots AS shots_against, a.shots - b.shots AS diff FROM t a JOIN t b ON a.match_id = b.match_id AND a.team <> b.team""", "stream")
def opponent_pair(spark, sf):
    t = stream(spark, sf).groupBy("match_id", "team").agg(F.count_if(F.col("kind") == "SH").alias("shots_for"))
    o = t.select("match_id", (1 - F.col("team")).alias("team"), F.col("shots_for").alias("shots_against"))
    return t.join(o, ["match_id", "team"]).withColumn("diff", F.col("shots_for") - F.col("shots_against"))


@query("union_sides", """SELECT match_id, 'home' AS side, count(*) FILTER (team=0) AS n, round(avg(x) FILTER (team=0),6) AS x FROM stream_v GROUP BY match_id UNION ALL
SELECT match_id, 'away', count(*) FILTER (team=1), round(avg(-x) FILTER (team=1),6) FROM stream_v GROUP BY match_id""", "stream")
def union_sides(spark, sf):
    """Home and away columns in long form without reading the stream twice."""
    w = stream(spark, sf).groupBy("match_id").agg(
        *[F.count_if(F.col("team") == t).alias(f"n{t}") for t in (0, 1)], *[F.avg(F.when(F.col("team") == t, F.col("x") * (1 - 2 * t))).alias(f"x{t}") for t in (0, 1)]
    )
    row = lambda s, t: F.struct(F.lit(s).alias("side"), F.col(f"n{t}").alias("n"), r6(f"x{t}").alias("x"))
    return w.select("match_id", F.inline(F.array(row("home", 0), row("away", 1))))


@query("custom_order", """p AS (SELECT match_id, team, user_id, count(*) AS n, min(kind) AS pos FROM stream_v GROUP BY 1, 2, 3)
SELECT match_id, team, user_id, row_number() OVER (PARTITION BY match_id, team ORDER BY n < 5, CASE pos WHEN 'SH' THEN 0 WHEN 'OTB' THEN 1 WHEN 'PA' THEN 2 ELSE 3 END, n DESC, user_id) AS place FROM p""", "stream")
def custom_order(spark, sf):
    """Display order of a squad: starters, position order, minutes, number."""
    p = stream(spark, sf).groupBy("match_id", "team", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("pos"))
    rank = F.when(F.col("pos") == "SH", 0).when(F.col("pos") == "OTB", 1).when(F.col("pos") == "PA", 2).otherwise(3)
    most = 1 << 40  # the whole order in one number, so that a squad of any size is ranked in pieces
    p = p.withColumn("ord", big((F.col("n") < 5).cast("int") * 4 + rank) * most + (most - F.col("n")))
    return row_index(p, fit_timeline(p, ["match_id", "team"], "ord", ["user_id"]), "place").select("match_id", "team", "user_id", "place")


@query("registry_order", """WITH o AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_name) AS ord FROM nation)
SELECT s_suppkey, s_nationkey, ord FROM supplier JOIN o ON s_nationkey = k ORDER BY ord, s_acctbal DESC, s_suppkey""")
def registry_order(spark, sf):
    """Rows in the order of a registry list, home side first; the registry is a fixed small dimension."""
    o = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), big(F.row_number().over(Window.orderBy("n_name"))).alias("ord"))
    return table(spark, sf, "supplier").join(o, "s_nationkey").orderBy("ord", F.col("s_acctbal").desc(), "s_suppkey").select("s_suppkey", "s_nationkey", "ord")


@query("argmax_row", "SELECT match_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY value DESC, event_id) AS r FROM stream_v) q WHERE r = 1", "stream")
def argmax_row(spark, sf):
    best = F.max(F.struct("value", (-F.col("event_id")).alias("e"))).alias("b")
    return stream(spark, sf).groupBy("match_id").agg(best).select("match_id", (-F.col("b.e")).alias("event_id"), "b.value")


# ------------------------------------------------------------------ text

ORD = "CASE WHEN {n} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"


@query("text_clock", """SELECT event_id, printf('%d:%02d', CAST(round_even(clock_us/1e6,0) AS BIGINT)//60, CAST(round_even(clock_us/1e6,0) AS BIGINT)%60) AS clock, printf('%02d:%02d', (clock_us//1000000)//60, (clock_us//1000000)%60) AS padded,
 CASE WHEN (clock_us//60000000)+1 > CASE period WHEN 1 THEN 45 ELSE 90 END THEN printf('%d+%d''', CASE period WHEN 1 THEN 45 ELSE 90 END, (clock_us//60000000)+1-CASE period WHEN 1 THEN 45 ELSE 90 END) ELSE printf('%d''', (clock_us//60000000)+1) END AS minute FROM stream_v""", "stream")
def text_clock(spark, sf):
    s = F.col("clock_us") / 1e6
    return stream(spark, sf).select("event_id", T.clock(s).alias("clock"), T.padded_clock(F.floor(s)).alias("padded"), T.minute_label(s, F.col("period")).alias("minute"))


@query("text_names", f"""SELECT c_custkey, c_custkey || {ORD.format(n='c_custkey')} AS place, string_split(replace(c_name, '#', ' '), ' ')[-1] AS surname, string_split(c_mktsegment || ' · ' || c_name, ' · ')[1] AS competition, replace(replace(c_name, 'Customer#', 'Feed '), 'Feed 0', 'Optical 0') AS credit FROM customer""")
def text_names(spark, sf):
    name = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", T.ordinal(F.col("c_custkey")).alias("place"), T.surname(F.replace(name, F.lit("#"), F.lit(" "))).alias("surname"),
        T.first_part(F.concat("c_mktsegment", F.lit(" · "), name)).alias("competition"), T.credit(name, [("Customer#", "Feed "), ("Feed 0", "Optical 0")]).alias("credit"),
    )


@query("text_zones", """m AS (SELECT match_id, team, avg(x) FILTER (period=1) AS a, avg(x) FILTER (period=2) AS b, CAST(floor(avg(x)/8) AS BIGINT) AS band FROM stream_v GROUP BY 1, 2)
SELECT match_id, team, 'centre, ' || CASE WHEN band*8 >= 0 THEN printf('%d-%d m ahead of', band*8, band*8+8) ELSE printf('%d-%d m behind', -(band*8+8), -band*8) END || ' the back line' AS zone,
 CASE WHEN round_even(abs(a),0) = 0 THEN 'team centre on the halfway line' ELSE printf('team centre %d m ', CAST(round_even(abs(a),0) AS BIGINT)) || CASE WHEN a > 0 THEN 'into the opponents’ half' ELSE 'inside its own half' END END AS centre,
 'Without the ball: ' || CASE WHEN abs(b-a) < 1 THEN 'back line holds its height' ELSE printf('back line %s %d m', CASE WHEN b-a > 0 THEN 'steps up' ELSE 'drops' END, CAST(round_even(abs(b-a),0) AS BIGINT)) END || ', block keeps its width and stretches 2 m' AS change,
 CASE WHEN round_even(b,0) = round_even(a,0) THEN 'no change' ELSE printf('%+d', CAST(round_even(b,0) - round_even(a,0) AS BIGINT)) END AS diff FROM m""", "stream")
def text_zones(spark, sf):
    m = stream(spark, sf).groupBy("match_id", "team").agg(
        F.avg(F.when(F.col("period") == 1, F.col("x"))).alias("a"), F.avg(F.when(F.col("period") == 2, F.col("x"))).alias("b"), F.avg("x").alias("x")
    )
    a, b = F.col("a"), F.col("b")
    return m.select(
        "match_id", "team", T.zone_name(F.lit(2), F.floor(F.col("x") / 8)).alias("zone"), T.centre_text(a).alias("centre"),
        T.shape_sentence(b - a, F.lit(0.0), F.lit(2.0)).alias("change"), T.change_text(a, b).alias("diff"),
    )


@query("view_sentences", f"""{TURN_SQL}, {PRESS_SQL.replace(LIVE_SQL + ",", "")}, m AS (SELECT DISTINCT match_id, team FROM stream_v),
t AS (SELECT match_id, team, count(*) AS won, count(*) FILTER (x >= 0) AS half, count(*) FILTER (fast) AS fast, count(*) FILTER (shot) AS shot FROM tn GROUP BY 1, 2),
p AS (SELECT match_id, team, count(*) AS n, 100e0*count(*) FILTER (won)/count(*) AS rate, count(*) FILTER (x > 0) AS half FROM pf GROUP BY 1, 2)
SELECT m.match_id, m.team, printf('Team %d: %d regains, %d past halfway, %d near goal within 10 s, %d ending in a shot', m.team, coalesce(won,0), coalesce(t.half,0), coalesce(fast,0), coalesce(shot,0)) AS turnovers,
 printf('Team %d: %d presses, %d past halfway, %d%% successful within 5 s', m.team, coalesce(n,0), coalesce(p.half,0), CAST(round_even(coalesce(rate,0),0) AS BIGINT)) AS pressing FROM m LEFT JOIN t ON m.match_id=t.match_id AND m.team=t.team LEFT JOIN p ON m.match_id=p.match_id AND m.team=p.team""", "stream")
def view_sentences(spark, sf):
    """Accessible one-line summary of the turnover and pressing views of each team."""
    t = turnover_summary(spark, sf)
    p = press_summary(spark, sf)
    d = p.join(t, ["match_id", "team"], "left").na.fill(0, ["won", "won_opp_half", "won_fast", "won_shot"])
    name = F.concat(F.lit("Team "), F.col("team").cast("string"))
    return d.select(
        "match_id", "team", T.turnover_sentence(name, F.col("won"), F.col("won_opp_half"), F.col("won_fast"), F.col("won_shot")).alias("turnovers"),
        T.press_sentence(name, F.col("presses"), F.col("win_rate"), F.col("in_opp_half")).alias("pressing"),
    )


@query("chance_captions", f"""{CHANCE_SQL} SELECT event_id, CASE WHEN third IS NOT NULL THEN 'won in ' || third || ' third' ELSE CASE kind WHEN 'restart' THEN 'after a restart' WHEN 'long' THEN 'long possession' ELSE 'after a turnover' END END || printf(' · %d s · %d pass', CAST(round_even((t-start)/1e6,0) AS BIGINT), passes) || CASE WHEN passes <> 1 THEN 'es' ELSE '' END AS caption FROM ct""", "stream")
def chance_captions(spark, sf):
    c = trace_chances(spark, sf)
    return c.select("event_id", T.caption(F.col("kind"), F.col("third"), (F.col("t") - F.col("start")) / 1e6, F.col("passes")).alias("caption"))


@query("summary_sentences")
def summary_sentences(spark, sf):
    """Sentences of the other views, each from that view's own summary; long form (view, key, sentence).

    Five views look at the events; live flags and neighbours are found in one pass and stored for all of them.
    """
    f = feed(spark, sf)
    kept = views.Feed(scan(f.rows, f.axis, was=event_before(), rc=receiver()), f.axis).kept("was", "rc")
    steps = steps_among(kept.rows)
    name = lambda c: F.concat(F.lit("Team "), F.col(c).cast("string"))
    lanes = share_lanes(steps).where(F.col("period") == 0).groupBy("match_id", "team").pivot("lane", ["left", "middle", "right"]).agg(F.first("share"))
    ent = count_entries(steps).groupBy("match_id", "team").agg(F.sum("entries").alias("entries"))
    attack = lanes.join(ent, ["match_id", "team"], "left").na.fill(0).select(
        F.lit("attack").alias("view"), F.col("match_id").alias("key"), T.attack_sentence(name("team"), F.col("left"), F.col("middle"), F.col("right"), F.col("entries")).alias("sentence")
    )
    med = early_and_late(kept.live)
    time = med.select(F.lit("time").alias("view"), F.col("match_id").alias("key"), T.time_sentence(name("dteam"), F.col("first15"), F.col("last15")).alias("sentence"))
    pocket = QUERIES["busiest_zone"](spark, sf).select("team", T.zone_name(F.col("lane"), F.col("band")).alias("pocket"))
    gaps = gap_summary(spark, sf).join(pocket, "team").select(
        F.lit("gaps").alias("view"), big(F.lit(0)).alias("key"), T.gap_sentence(name("team"), F.col("holes"), F.col("free"), F.col("pocket")).alias("sentence")
    )
    ch = sum_up_chances(views.chances(kept)).select(
        F.lit("chances").alias("view"), F.col("match_id").alias("key"),
        T.chance_sentence(name("team"), F.col("shots_faced"), F.col("after_turnover"), F.col("after_restart"), F.col("long_possession")).alias("sentence"),
    )
    lanes = ("right_wing", "right_half", "centre", "left_half", "left_wing")
    most = F.array_max(F.array(*(F.struct(F.col(c).alias("n"), F.lit(-k).alias("k"), F.lit(c.replace("_", " ")).alias("lane")) for k, c in enumerate(lanes))))
    lb = sum_up_breaks(breaks_among(spark, sf, kept.live)).select(
        F.lit("lb").alias("view"), big(F.lit(0)).alias("key"), T.line_break_sentence(name("dteam"), F.col("conceded"), F.col("behind"), most["lane"]).alias("sentence")
    )
    return attack.unionByName(time).unionByName(gaps).unionByName(ch).unionByName(lb)


def summary_sql(sql: dict[str, str]) -> str:
    """The sentences from the SQL of the summaries they tell."""
    near = lambda c: f"CAST(round_even({c}, 0) AS BIGINT)"
    parts = ("lane_shares", "zone_entries", "first_last_medians", "busiest_zone", "gap_summary", "chances_summary", "line_break_summary")
    ctes = ",\n".join(f"q_{p} AS ({sql[p]})" for p in parts)
    lane_words = "['" + "', '".join(T.GAP_LANES) + "']"
    share = lambda v: f"coalesce(max(share) FILTER (lane = '{v}'), 0)"
    places = ("right_wing", "right_half", "centre", "left_half", "left_wing")
    most = f"greatest({', '.join(places)})"
    mostly = " ".join(f"WHEN {c} = {most} THEN '{c.replace('_', ' ')}'" for c in places)
    return f"""WITH {ctes},
ls AS (SELECT match_id, team, {share('left')} AS l, {share('middle')} AS m, {share('right')} AS r FROM q_lane_shares WHERE period = 0 GROUP BY 1, 2),
en AS (SELECT match_id, team, sum(entries) AS n FROM q_zone_entries GROUP BY 1, 2),
pk AS (SELECT team, {lane_words}[lane + 1] || ', ' || CASE WHEN band * 8 >= 0 THEN printf('%d-%d m ahead of', CAST(band * 8 AS BIGINT), CAST(band * 8 + 8 AS BIGINT)) ELSE printf('%d-%d m behind', CAST(-(band * 8 + 8) AS BIGINT), CAST(-band * 8 AS BIGINT)) END || ' the back line' AS pocket FROM q_busiest_zone)
SELECT 'attack' AS view, match_id AS key, printf('Team %d: entries %d; play by lane %d/%d/%d %% (left/middle/right)', team, CAST(coalesce(n, 0) AS BIGINT), {near('l')}, {near('m')}, {near('r')}) AS sentence FROM ls LEFT JOIN en USING (match_id, team)
UNION ALL SELECT 'time', match_id, printf('Team %d: line height %d m early, %d m late', dteam, {near('first15')}, {near('last15')}) FROM q_first_last_medians
UNION ALL SELECT 'gaps', 0, printf('Team %d: mean hole area %d m2, mean free opponents ', team, {near('holes')}) || CASE WHEN free = floor(free) THEN CAST(CAST(free AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', free), '\\.?0+$', '') END || ', usual hole ' || pocket FROM q_gap_summary JOIN pk USING (team)
UNION ALL SELECT 'chances', match_id, printf('Team %d: shots against %d = turnover %d + restart %d + long possession %d', team, shots_faced, after_turnover, after_restart, long_possession) FROM q_chances_summary
UNION ALL SELECT 'lb', 0, printf('Team %d: lines broken %d times, %d of them behind the last line, mostly by the ', dteam, conceded, behind) || CASE {mostly} END FROM q_line_break_summary"""
