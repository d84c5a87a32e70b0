"""Streaming queries drained over the events table as a file source."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import geometry as G
from touchline.plans.files import once
from touchline.plans.registry import big, query, r6
from touchline.plans.timeseries import STEP_SQL
from touchline.sources.driver_tables import stream, table
from touchline.streaming import live

S = 1_000_000


#: The topic's rows come in so many micro-batches, out of order by less than this.
ARRIVALS, DISORDER, DELAY = 6, 50 * S, "60 seconds"


def source(spark, sf):
    """Event topic as a bounded file stream: shuffled rows in small batches, at last a row that closes the topic."""
    n = min(4, spark.sparkContext.defaultParallelism)

    def write(p):
        s = stream(spark, sf).withColumn("ts", F.timestamp_micros(F.col("clock_us")))
        arrival = F.col("clock_us") + F.pmod(F.col("event_id") * 7_919_000, F.lit(DISORDER))
        batch = F.least(F.floor(arrival * ARRIVALS / (5400 * S)), F.lit(ARRIVALS - 1))
        for k in range(ARRIVALS):
            s.where(batch == k).repartition(n, F.xxhash64("event_id")).write.mode("append").parquet(p)
        live.closing(s, "match_id").coalesce(1).write.mode("append").parquet(p)

    path = once(spark, sf, "topic", write)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", n).parquet(path)


@query("stream_ppda", """pc AS (SELECT *, CASE WHEN kind = 'CH' THEN team ELSE 1 - team END AS dteam FROM stream_v WHERE kind IN ('PA','CH'))
SELECT match_id, dteam, CAST(floor(clock_us/300000000e0) AS BIGINT) AS bucket, count(*) FILTER (kind='PA') AS passes, count(*) FILTER (kind='CH') AS actions FROM pc WHERE abs(CASE WHEN dteam = 0 THEN -52.5e0 ELSE 52.5e0 END - x) >= 35 GROUP BY 1, 2, 3""", "stream")
def stream_ppda(spark, sf):
    w = live.ppda_windows(source(spark, sf), delay=DELAY)
    w = w.select("match_id", "dteam", F.floor(F.unix_micros(F.col("w.start")) / 300000000.0).alias("bucket"), "passes", "actions")
    return live.latest(live.drain(spark, w, "update"), "match_id", "dteam", "bucket")


@query("stream_dedup", "SELECT DISTINCT match_id, CAST(floor(clock_us/1000000e0) AS BIGINT) AS sec FROM stream_v", "stream")
def stream_dedup(spark, sf):
    """One row per match and second."""
    s = source(spark, sf).withColumn("sec", F.floor(F.col("clock_us") / 1000000.0))
    d = live.unique_rows(s, ["match_id", "sec"], DELAY).select("match_id", "sec")
    return live.drain(spark, d, "append").where("match_id IS NOT NULL").select("match_id", "sec")


SESSION_SQL = """m AS (SELECT match_id, team, clock_us FROM stream_v WHERE value > 10),
b AS (SELECT *, CASE WHEN clock_us - lag(clock_us) OVER (PARTITION BY match_id, team ORDER BY clock_us) <= 10000000 THEN 0 ELSE 1 END AS nw FROM m),
k AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, team ORDER BY clock_us) AS g FROM b)
SELECT match_id, team, min(clock_us) AS start_us, max(clock_us) + 10000000 AS end_us, count(*) AS n FROM k GROUP BY match_id, team, g"""


@query("stream_sessions", SESSION_SQL, "stream")
def stream_sessions(spark, sf):
    """Presses as session windows; the topic's last row ends those still open."""
    s = source(spark, sf).where((F.col("value") > 10) | F.col("match_id").isNull())
    d = live.drain(spark, live.sessions(s, ["match_id", "team"], "10 seconds", DELAY), "append")
    return d.where("match_id IS NOT NULL").select("match_id", "team", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_trailing_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY match_id, team ORDER BY clock_us RANGE BETWEEN 2999999 PRECEDING AND CURRENT ROW),6) AS mean_3s FROM stream_v", "stream")
def stream_trailing_mean(spark, sf):
    d = live.in_order(source(spark, sf), ["match_id", "team"], live.TrailingMean(3 * S), "event_id bigint, mean double", DELAY)
    return live.drain(spark, d, "append").select("event_id", r6("mean").alias("mean_3s"))


@query("stream_possession", """o AS (SELECT match_id, event_id, team, lag(team) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS was FROM stream_v WHERE kind = 'OTB')
SELECT match_id, event_id, was AS loser FROM o WHERE was <> team""", "stream")
def stream_possession(spark, sf):
    return losses(spark, sf, 1)


def losses(spark, sf, touches):
    s = source(spark, sf).where((F.col("kind") == "OTB") | F.col("match_id").isNull())
    d = live.in_order(s, ["match_id"], live.Possession(touches), "match_id bigint, event_id bigint, loser int", DELAY)
    return live.drain(spark, d, "append").select("match_id", "event_id", "loser")


@query("stream_possession_settled", """RECURSIVE_o AS (SELECT match_id, event_id, team, row_number() OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS n FROM stream_v WHERE kind = 'OTB'),
w AS (SELECT match_id, n, event_id, team AS holder, 0 AS streak, CAST(NULL AS INTEGER) AS loser FROM o WHERE n = 1
  UNION ALL SELECT o.match_id, o.n, o.event_id, CASE WHEN o.team <> holder AND streak = 2 THEN o.team ELSE holder END,
    CASE WHEN o.team = holder OR streak = 2 THEN 0 ELSE streak + 1 END, CASE WHEN o.team <> holder AND streak = 2 THEN holder END
  FROM w JOIN o ON o.match_id = w.match_id AND o.n = w.n + 1)
SELECT match_id, event_id, loser FROM w WHERE loser IS NOT NULL""", "stream")
def stream_possession_settled(spark, sf):
    """The ball changes sides with the third touch in a row by the other side."""
    return losses(spark, sf, 3)


@query("stream_pressure", f"""{STEP_SQL.replace('period, team FROM', 'period, team FROM').replace('PARTITION BY match_id, period, team', 'PARTITION BY match_id, team')},
r AS (SELECT event_id, x + CASE WHEN t - pt > 0 AND t - pt <= 10000000 THEN 0.7e0*(x-px)/((t-pt)/1e6) ELSE 0 END AS rx, y + CASE WHEN t - pt > 0 AND t - pt <= 10000000 THEN 0.7e0*(y-py)/((t-pt)/1e6) ELSE 0 END AS ry FROM st)
SELECT event_id, round(1.0e0/(1.0e0+exp(((0.7e0+sqrt(rx*rx+ry*ry)/8.0e0)-1.5e0)/0.5e0)),6) AS contribution FROM r""", "stream")
def stream_pressure(spark, sf):
    """Contribution to pressure at the centre spot from each reading and its entity's previous position."""
    d = live.in_order(source(spark, sf), ["match_id", "team"], live.PressureStep(10 * S), "event_id bigint, rx double, ry double", DELAY)
    dist = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))
    return live.drain(spark, d.select("event_id", G.intercept_chance(dist).alias("c")), "append").select("event_id", r6("c").alias("contribution"))


FRAME, LOOKBACK = 30 * S, 900 * S


@query("stream_pressure_frames", f"""p AS (SELECT *, clock_us - lag(clock_us) OVER w AS gap, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT v.*, e.user_id FROM stream_v v JOIN events e USING (event_id)) q
  WINDOW w AS (PARTITION BY match_id, team, user_id ORDER BY clock_us, event_id)),
r AS (SELECT match_id, team, user_id, clock_us // {FRAME} AS frame, x + CASE WHEN gap > 0 AND gap <= {LOOKBACK} THEN 0.7e0*(x-px)/(gap/1e6) ELSE 0 END AS rx, y + CASE WHEN gap > 0 AND gap <= {LOOKBACK} THEN 0.7e0*(y-py)/(gap/1e6) ELSE 0 END AS ry FROM p),
c AS (SELECT *, 1.0e0/(1.0e0+exp(((0.7e0+sqrt(rx*rx+ry*ry)/8.0e0)-1.5e0)/0.5e0)) AS chance FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY match_id, team, frame ORDER BY round(chance, 6) DESC, user_id) AS nth FROM c)
SELECT match_id, team, CAST(frame AS BIGINT) AS frame, count(*) AS n, round(1 - exp(sum(ln(1 - chance))), 6) AS score, min(CASE WHEN nth = 1 THEN user_id END) AS presser FROM o GROUP BY match_id, team, frame""", "stream")
def stream_pressure_frames(spark, sf):
    """Pressure of a side on the centre spot per half minute, and who presses most, from every player's previous position."""
    s = source(spark, sf).withColumn("entity", F.col("user_id"))
    d = live.in_order(s, ["match_id", "team"], live.PressureFrames(FRAME, LOOKBACK), "match_id bigint, team int, frame bigint, n bigint, score double, presser bigint", DELAY)
    return live.drain(spark, d, "append").select("match_id", "team", "frame", "n", r6("score").alias("score"), "presser")


@query("stream_resample", "SELECT match_id, team, CAST(clock_us // 1000000 AS BIGINT) AS sec, count(*) AS n, round(avg(value), 6) AS value FROM stream_v GROUP BY 1, 2, 3", "stream")
def stream_resample(spark, sf):
    """A value per side and second."""
    d = live.resampled(source(spark, sf), ["match_id", "team"], "value", "1 second", DELAY)
    d = live.drain(spark, d, "append").where("match_id IS NOT NULL")
    return d.select("match_id", "team", F.floor(F.unix_micros("start") / 1000000.0).alias("sec"), "n", r6("value").alias("value"))


@query("stream_static_join", "SELECT s.event_id, n_name AS team_name, CASE WHEN value >= 5 + n_regionkey THEN 'Engaged' ELSE 'Passive' END AS engaged FROM stream_v s JOIN nation ON n_nationkey = match_id", "stream")
def stream_static_join(spark, sf):
    dims = table(spark, sf, "nation").select(big("n_nationkey").alias("match_id"), F.col("n_name").alias("team_name"), (F.lit(5) + F.col("n_regionkey")).alias("thr"))
    d = source(spark, sf).join(dims, "match_id")  # the closing row has no match
    d = d.select("event_id", "team_name", F.when(F.col("value") >= F.col("thr"), "Engaged").otherwise("Passive").alias("engaged"))
    return live.drain(spark, d, "append").select("event_id", "team_name", "engaged")


def late_source(spark, sf):
    """The second half arrives first, in two batches, then the whole first half."""
    files = spark.sparkContext.defaultParallelism

    def write(p):
        s = stream(spark, sf).withColumn("ts", F.timestamp_micros(F.col("clock_us")))
        early = F.col("clock_us") < 4050 * S
        for n, part in enumerate(((F.col("period") == 2) & early, (F.col("period") == 2) & ~early, F.col("period") == 1)):
            s.where(part).repartition(files).write.parquet(f"{p}/{n}")

    path = once(spark, sf, "latetopic", write)
    schema = spark.read.parquet(f"{path}/0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


@query("stream_late", "SELECT match_id, CAST(floor(clock_us/300000000e0) AS BIGINT) AS bucket, count(*) AS n FROM stream_v WHERE period = 2 GROUP BY 1, 2", "stream")
def stream_late(spark, sf):
    """What comes in time: the first half is later than the watermark and is dropped.

    Lateness is judged by the watermark one batch back, hence the second half comes in two batches.
    """
    w = late_source(spark, sf).withWatermark("ts", "10 seconds").groupBy("match_id", F.window("ts", "300 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    w = w.select("match_id", F.floor(F.unix_micros(F.col("w.start")) / 300000000.0).alias("bucket"), "n")
    return live.latest(live.drain(spark, w, "update"), "match_id", "bucket")


@query("stream_late_rows", """f AS (SELECT match_id, max(clock_us) AS front FROM stream_v WHERE period = 2 GROUP BY 1)
SELECT match_id, event_id, CAST(front - clock_us AS BIGINT) AS late_us FROM stream_v JOIN f USING (match_id) WHERE period = 1 AND clock_us < front - 10000000""", "stream")
def stream_late_rows(spark, sf):
    """What comes too late, row by row, with its lateness."""
    d = live.stateful(late_source(spark, sf), ["match_id"], live.LateRows(10 * S), "match_id bigint, event_id bigint, late_us bigint")
    return live.drain(spark, d, "append").select("match_id", "event_id", "late_us")
