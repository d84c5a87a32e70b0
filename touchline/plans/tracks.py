"""Trajectories, provider alignment, detections, direction and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.functions import text as T
from touchline.operators import geometry as G
from touchline.operators import play, quality
from touchline.operators import sequences as Q
from touchline.operators.assignment import track_numbers
from touchline.operators.intervals import least_covering
from touchline.operators.smoothing import BALL_NOISE, smoothed
from touchline.operators.timeline import Timeline, asof_join, grouped_percentile, nxt, prev, scan, total, window_lowest, window_stats
from touchline.plans.frames import ASSIGNED_SQL, assignment_error
from touchline.plans.registry import big, query, r6
from touchline.sources.driver_tables import moments, per_session, stream, stream_axis, stream_frames, table

S = play.SECOND
PATH = ["match_id", "period", "user_id"]


@per_session
def trajectories(spark, sf):
    return stream(spark, sf).select(*PATH, "event_id", "clock_us", (F.col("clock_us") / 1e6).alias("t"), "x", "y", "team")


# ------------------------------------------------------------------ smoothing

#: The filter forward and the smoother backward, sample by sample; q and r are the squares of the ball's noise, the gate 4.5 deviations.
KALMAN_SQL = """RECURSIVE_o AS (SELECT match_id, period, user_id, event_id, clock_us/1e6 AS t, x, y, row_number() OVER (PARTITION BY match_id, period, user_id ORDER BY clock_us, event_id) AS n
  FROM (SELECT v.*, e.user_id FROM stream_v v JOIN events e USING (event_id)) z),
f AS (SELECT match_id, period, user_id, event_id, n, t, x AS px, y AS py, 0e0 AS vx, 0e0 AS vy, 1e0 AS a, 0e0 AS b, 25e0 AS c,
    0e0 AS h, 0e0 AS gx, 0e0 AS gy, 0e0 AS wx, 0e0 AS wy, 0e0 AS pa, 0e0 AS pb, 0e0 AS pc FROM o WHERE n = 1
  UNION ALL SELECT match_id, period, user_id, event_id, n, t, gx + ok*ga*dx, gy + ok*ga*dy, wx + ok*gk*dx, wy + ok*gk*dy, pa - ok*ga*pa, pb - ok*ga*pb, pc - ok*gk*pb, h, gx, gy, wx, wy, pa, pb, pc
  FROM (SELECT *, x - gx AS dx, y - gy AS dy, pa/(pa+1) AS ga, pb/(pa+1) AS gk, CASE WHEN ((x-gx)*(x-gx) + (y-gy)*(y-gy))/(pa+1) <= 20.25e0 THEN 1e0 ELSE 0e0 END AS ok
    FROM (SELECT q.*, px + h*vx AS gx, py + h*vy AS gy, vx AS wx, vy AS wy, a + 2*h*b + h*h*c + 36*h*h*h*h AS pa, b + h*c + 72*h*h*h AS pb, c + 144*h*h AS pc
      FROM (SELECT o.*, greatest(o.t - f.t, 1e-3) AS h, px, py, vx, vy, a, b, c FROM f JOIN o ON o.match_id = f.match_id AND o.period = f.period AND o.user_id = f.user_id AND o.n = f.n + 1) q) g) u),
m AS (SELECT match_id, period, user_id, max(n) AS n FROM o GROUP BY ALL),
s AS (SELECT match_id, period, user_id, f.n, f.event_id, px AS sx, py AS sy, vx AS ux, vy AS uy, h, gx, gy, wx, wy, pa, pb, pc FROM f JOIN m USING (match_id, period, user_id, n)
  UNION ALL SELECT match_id, period, user_id, n, event_id, px + k11*(sx-nx) + k12*(ux-mx), py + k11*(sy-ny) + k12*(uy-my), vx + k21*(sx-nx) + k22*(ux-mx), vy + k21*(sy-ny) + k22*(uy-my), h, gx, gy, wx, wy, pa, pb, pc
  FROM (SELECT f.*, sx, sy, ux, uy, s.gx AS nx, s.gy AS ny, s.wx AS mx, s.wy AS my,
      ((f.a + s.h*f.b)*s.pc - f.b*s.pb)/(s.pa*s.pc - s.pb*s.pb) AS k11, (f.b*s.pa - (f.a + s.h*f.b)*s.pb)/(s.pa*s.pc - s.pb*s.pb) AS k12,
      ((f.b + s.h*f.c)*s.pc - f.c*s.pb)/(s.pa*s.pc - s.pb*s.pb) AS k21, (f.c*s.pa - (f.b + s.h*f.c)*s.pb)/(s.pa*s.pc - s.pb*s.pb) AS k22
    FROM s JOIN f ON f.match_id = s.match_id AND f.period = s.period AND f.user_id = s.user_id AND f.n = s.n - 1) r)
SELECT event_id, round(sx, 6) AS sx, round(sy, 6) AS sy FROM s"""


@query("kalman_rts", KALMAN_SQL, "stream")
def kalman_rts(spark, sf):
    """Filtered and smoothed position at every sample of every trajectory."""
    d = smoothed(trajectories(spark, sf), PATH, stream_axis(spark, sf), *BALL_NOISE)
    return d.select("event_id", r6("sx").alias("sx"), r6("sy").alias("sy"))


SPIKE_ROUNDS, SPIKE_SPEED = 5, 0.5


def spike_sql() -> str:
    """Each round a table of its own: what the round before kept, less the samples only impossible speeds can reach."""
    speed = lambda dt, dx, dy: f"sqrt(({dx})*({dx}) + ({dy})*({dy}))/({dt})"
    at = lambda f, c: f"{f}({c}) OVER w"
    out = ["k0 AS (SELECT match_id, period, user_id, event_id, clock_us, clock_us/1e6 AS t, x, y FROM stream_v)"]
    for k in range(SPIKE_ROUNDS):
        near = ", ".join(f"{at(f, c)} AS {p}{c}" for f, p in (("lag", "p"), ("lead", "n")) for c in ("t", "x", "y"))
        bad = f"t > pt AND nt > t AND {speed('t-pt', 'x-px', 'y-py')} > {SPIKE_SPEED} AND {speed('nt-t', 'nx-x', 'ny-y')} > {SPIKE_SPEED} AND {speed('nt-pt', 'nx-px', 'ny-py')} <= {SPIKE_SPEED}"
        out.append(f"a{k} AS (SELECT *, {near} FROM k{k} WINDOW w AS (PARTITION BY match_id, period, user_id ORDER BY clock_us, event_id))")
        out.append(f"k{k + 1} AS (SELECT match_id, period, user_id, event_id, clock_us, t, x, y FROM a{k} WHERE NOT coalesce({bad}, false))")
    return ",\n".join(out) + f"\nSELECT event_id FROM k{SPIKE_ROUNDS}"


@query("spike_iterative", spike_sql(), "stream")
def spike_iterative(spark, sf):
    """Samples left after up to five rounds of spike removal; a round looks at the neighbours that the last one kept."""
    return Q.without_spikes(trajectories(spark, sf), stream_axis(spark, sf, *PATH), SPIKE_SPEED, SPIKE_ROUNDS).select("event_id")


def savgol_sql() -> str:
    """Least-squares weights of the quadratic through seven samples, then central differences over uneven steps."""
    end = {1: ((32, 15, 3, -4, -6, -3, 5), 42), 2: ((5, 4, 3, 2, 1, 0, -1), 14), 3: ((1, 3, 4, 4, 3, 1, -2), 14)}

    def shifted(c: str, k: int) -> str:
        return c if k == 0 else f"lag({c}, {-k}) OVER w" if k < 0 else f"lead({c}, {k}) OVER w"

    def weighted(c: str, weights: tuple, by: int, start: int, step: int = 1) -> str:
        return "(" + " + ".join(f"{v}e0*{shifted(c, step * (start + i))}" for i, v in enumerate(weights)) + f")/{by}"

    def smooth(c: str) -> str:
        heads = " ".join(f"WHEN i = {k} THEN {weighted(c, w, by, 1 - k)}" for k, (w, by) in end.items())
        tails = " ".join(f"WHEN n - i + 1 = {k} THEN {weighted(c, w, by, 1 - k, -1)}" for k, (w, by) in end.items())
        return f"CASE WHEN n < 7 THEN {c} {heads} {tails} ELSE {weighted(c, (-2, 3, 6, 7, 6, 3, -2), 21, -3)} END AS s{c}"

    def slope(c: str) -> str:
        one, two, b, f = f"({c} - p{c})/(t - pt)", f"(n{c} - {c})/(nt - t)", "(t - pt)", "(nt - t)"
        both = f"({b}*{b}*n{c} + ({f}*{f} - {b}*{b})*{c} - {f}*{f}*p{c})/({b}*{f}*({b} + {f}))"
        return f"greatest(-10e0, least(10e0, CASE WHEN n < 3 THEN 0e0 WHEN i = 1 THEN {two} WHEN i = n THEN {one} ELSE {both} END))"

    over = "WINDOW w AS (PARTITION BY match_id, period, user_id ORDER BY clock_us, event_id)"
    return f"""a AS (SELECT *, clock_us/1e6 AS t, row_number() OVER w AS i, count(*) OVER (PARTITION BY match_id, period, user_id) AS n FROM stream_v {over}),
b AS (SELECT *, {smooth('x')}, {smooth('y')} FROM a {over}),
c AS (SELECT *, lag(t) OVER w AS pt, lead(t) OVER w AS nt, lag(sx) OVER w AS psx, lead(sx) OVER w AS nsx, lag(sy) OVER w AS psy, lead(sy) OVER w AS nsy FROM b {over})
SELECT event_id, round(sx,6)+0e0 AS sx, round(sy,6)+0e0 AS sy, round({slope('sx')},6)+0e0 AS vx, round({slope('sy')},6)+0e0 AS vy FROM c"""


@query("savgol_tracks", savgol_sql(), "stream")
def savgol_tracks(spark, sf):
    """Seven-sample quadratic smoothing and clipped gradient velocity per track."""
    d = Q.savgol_tracks(trajectories(spark, sf), PATH, stream_axis(spark, sf), 10.0)
    return d.select("event_id", *[r6(c).alias(c) for c in ("sx", "sy", "vx", "vy")])


SAVGOL_W = (-2, 3, 6, 7, 6, 3, -2)


@query("savgol_interior", f"""w AS (SELECT event_id, {' + '.join(f'{c}e0*' + (f'lag(x,{3-i}) OVER w' if i < 3 else 'x' if i == 3 else f'lead(x,{i-3}) OVER w') for i, c in enumerate(SAVGOL_W))} AS s FROM stream_v WINDOW w AS (PARTITION BY match_id, period, user_id ORDER BY clock_us, event_id))
SELECT event_id, round(s/21,6)+0e0 AS sx FROM w WHERE s IS NOT NULL""", "stream")
def savgol_interior(spark, sf):
    """Interior points of the seven-tap smoother as a weighted sum of neighbours."""
    w = Window.partitionBy(*PATH).orderBy("clock_us", "event_id")
    taps = [(F.lag("x", 3 - i).over(w) if i < 3 else F.lead("x", i - 3).over(w) if i > 3 else F.col("x")) * float(c) for i, c in enumerate(SAVGOL_W)]
    d = stream(spark, sf).withColumn("s", sum(taps[1:], taps[0]))
    return d.where(F.col("s").isNotNull()).select("event_id", r6(F.col("s") / 21).alias("sx"))


@query("track_team_vote", """v AS (SELECT match_id, user_id, team, count(*) AS n FROM stream_v GROUP BY 1, 2, 3)
SELECT match_id, user_id, team, n FROM (SELECT *, row_number() OVER (PARTITION BY match_id, user_id ORDER BY n DESC, team) AS r FROM v) q WHERE r = 1""", "stream")
def track_team_vote(spark, sf):
    """Majority team of each track."""
    v = stream(spark, sf).groupBy("match_id", "user_id", "team").agg(F.count(F.lit(1)).alias("n"))
    b = v.groupBy("match_id", "user_id").agg(F.max(F.struct("n", (-F.col("team")).alias("t"))).alias("b"))
    return b.select("match_id", "user_id", (-F.col("b.t")).alias("team"), "b.n")


DEBOUNCE_SQL = """t AS (SELECT match_id, period, event_id, clock_us, team, lag(team) OVER w AS a, lag(team, 2) OVER w AS b FROM stream_v WHERE value <= 40 WINDOW w AS (PARTITION BY match_id, period ORDER BY clock_us, event_id)),
k AS (SELECT *, a IS NULL OR (team = a AND team = b) AS settles FROM t)
SELECT s.event_id, last_value(CASE WHEN settles THEN k.team END IGNORE NULLS) OVER (PARTITION BY s.match_id, s.period ORDER BY s.clock_us, s.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holder FROM stream_v s LEFT JOIN k ON s.event_id = k.event_id"""


@query("debounced_possession", DEBOUNCE_SQL, "stream")
def debounced_possession(spark, sf):
    """Possession that changes only after three touches in a row by the other team.

    The first touch, and every touch that is at least the third in a row, settles the holder
    whatever came before; the holder at a row is the last one settled.
    """
    tl = stream_axis(spark, sf, "match_id", "period")
    touch = F.col("value") <= 40
    d = scan(stream(spark, sf), tl, a=prev(F.col("team"), when=touch))
    d = scan(d, tl, b=prev(F.col("a"), when=touch))
    settles = touch & (F.col("a").isNull() | ((F.col("team") == F.col("a")) & (F.col("team") == F.col("b"))))
    return scan(d, tl, holder=prev(F.col("team"), when=settles, inclusive=True)).select("event_id", "holder")


# ------------------------------------------------------------------ detections

@query("detections_scan", "SELECT frame, clock_us/1e6 AS t, match_id AS run, user_id AS track, team, x, y FROM stream_v", "stream")
def detections_scan(spark, sf):
    return stream_frames(spark, sf).select("frame", (F.col("clock_us") / 1e6).alias("t"), F.col("match_id").alias("run"), F.col("user_id").alias("track"), "team", "x", "y")


@query("detections_bounds", "SELECT event_id FROM stream_v WHERE abs(x) <= 40 AND abs(y) <= 30", "stream")
def detections_bounds(spark, sf):
    return stream(spark, sf).where((F.abs("x") <= 40) & (F.abs("y") <= 30)).select("event_id")


CAMERA_SQL = """c AS (SELECT *, value > 2 AS valid FROM stream_v), v AS (SELECT *, lag(frame) OVER w AS pf FROM c WHERE valid WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
ct AS (SELECT match_id, frame FROM stream_v WHERE kind = 'SH' AND value > 100),
b AS (SELECT v.*, CASE WHEN pf IS NULL OR frame - pf > 4 OR EXISTS (SELECT 1 FROM ct WHERE ct.match_id = v.match_id AND ct.frame > v.pf AND ct.frame <= v.frame) THEN 1 ELSE 0 END AS nw FROM v),
k AS (SELECT *, sum(nw) OVER (PARTITION BY match_id ORDER BY frame) AS rid FROM b)
SELECT match_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM k GROUP BY match_id, rid HAVING count(*) >= 5"""


def usable_runs(spark, sf):
    """Usable frames with the first frame of their run as ``head``."""
    tl = stream_axis(spark, sf)
    cut = (F.col("kind") == "SH") & (F.col("value") > 100)
    d = scan(stream_frames(spark, sf), tl, cut=prev(F.col("frame"), when=cut, inclusive=True))
    d = scan(d.where(F.col("value") > 2), tl, pf=prev(F.col("frame")))
    fresh = F.col("pf").isNull() | (F.col("frame") - F.col("pf") > 4) | F.coalesce(F.col("cut") > F.col("pf"), F.lit(False))
    return scan(d, tl, head=prev(F.col("frame"), when=fresh, inclusive=True))


@query("camera_runs", CAMERA_SQL, "stream")
def camera_runs(spark, sf):
    """Runs of usable frames: split at cuts and at more than three missing frames, at least five long."""
    return usable_runs(spark, sf).groupBy("match_id", "head").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5).drop("head")


@query("camera_parameters", CAMERA_SQL[: CAMERA_SQL.index("SELECT match_id, min(frame)")].rstrip() + """,
h AS (SELECT match_id, frame, {'head': min(frame) OVER r, 'n': count(*) OVER r, 'f': frame, 'p': [x/100, y/100, value/100, (x-y)/100]} AS pt FROM k WINDOW r AS (PARTITION BY match_id, rid)),
ab AS (SELECT s.*, last_value(pt IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(pt IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM stream_v s LEFT JOIN h USING (match_id, frame)),
i AS (SELECT *, CASE WHEN b.f > a.f THEN CAST(frame - a.f AS DOUBLE) / (b.f - a.f) ELSE 0e0 END AS w FROM ab WHERE a.head = b.head AND a.n >= 5),
q AS (SELECT *, a.p[1] + (b.p[1]-a.p[1])*w AS p1, a.p[2] + (b.p[2]-a.p[2])*w AS p2, a.p[3] + (b.p[3]-a.p[3])*w AS p3, a.p[4] + (b.p[4]-a.p[4])*w AS p4 FROM i)
SELECT event_id, a.head AS run, b.f > a.f AS filled, round(p1,6) AS p1, round(p2,6) AS p2, round(p3,6) AS p3, round(p4,6) AS p4, round(((1+p1)*x + p2*y + 3*p3)/(p1*x*0.001e0 + p2*y*0.001e0 + 1 + abs(p4)),6) AS px FROM q""", "stream")
def camera_parameters(spark, sf):
    """Camera parameters on every frame of a run: as fitted, or between the fits before and after it; none across a cut or a long gap."""
    tl = stream_axis(spark, sf)
    frame, fit = F.col("frame"), F.col("value") > 2
    d = scan(stream_frames(spark, sf), tl, cut=prev(frame, when=(F.col("kind") == "SH") & (F.col("value") > 100), inclusive=True), pf=prev(frame, when=fit))
    fresh = fit & (F.col("pf").isNull() | (frame - F.col("pf") > 4) | F.coalesce(F.col("cut") > F.col("pf"), F.lit(False)))
    d = scan(d, tl, head=prev(frame, when=fresh, inclusive=True))
    known = F.struct("head", frame.alias("f"), F.array(F.col("x") / 100, F.col("y") / 100, F.col("value") / 100, (F.col("x") - F.col("y")) / 100).alias("p"))
    d = scan(d, tl, a=prev(known, when=fit, inclusive=True), b=nxt(known, when=fit, inclusive=True))
    long = d.where(fit).groupBy("match_id", F.col("head").alias("run")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 5).drop("n")
    d = d.where(F.col("a.head") == F.col("b.head")).withColumn("run", F.col("a.head")).join(long, ["match_id", "run"])
    filled = F.col("b.f") > F.col("a.f")
    w = F.when(filled, (frame - F.col("a.f")) / (F.col("b.f") - F.col("a.f"))).otherwise(F.lit(0.0))
    d = d.select("event_id", "run", filled.alias("filled"), "x", "y", F.zip_with("a.p", "b.p", lambda u, v: u + (v - u) * w).alias("p"))
    p1, p2, p3, p4 = (F.element_at("p", k) for k in (1, 2, 3, 4))
    px = ((1 + p1) * F.col("x") + p2 * F.col("y") + 3 * p3) / (p1 * F.col("x") * 0.001 + p2 * F.col("y") * 0.001 + 1 + F.abs(p4))
    return d.select("event_id", "run", "filled", *[r6(p).alias(f"p{k}") for k, p in enumerate((p1, p2, p3, p4), 1)], r6(px).alias("px"))


@query("tracker")
def tracker(spark, sf):
    """Track numbers by gated assignment inside camera runs; numbers restart with every run."""

    def body(p):
        p["track"] = track_numbers(p["i"].to_numpy(), p["slot"].to_numpy(), p[["x", "y"]].to_numpy(), gate=25.0)
        return p[["event_id", *run, "track"]]

    run = ["match_id", "team", "run"]
    s = usable_runs(spark, sf).select("match_id", "team", F.col("head").alias("run"), F.floor(F.col("clock_us") / (10 * S)).alias("slot"), "event_id", "x", "y")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select("event_id", *run).schema)
    d = Q.per_stack(s, Timeline(tuple(run), "slot", ("event_id",)), body, f"{ddl}, track bigint")
    return d.select("event_id", "match_id", "team", "run", "track")


@query("sparse_transition", """o AS (SELECT match_id, clock_us AS c0, lead(clock_us) OVER (PARTITION BY match_id ORDER BY clock_us) AS c1, team FROM (SELECT *, lag(team) OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS was FROM stream_v WHERE kind='OTB') q WHERE was IS NULL OR was <> team),
r AS (SELECT o.match_id, o.c0, v.clock_us, v.x AS d, CASE WHEN kind <> 'PA' THEN v.y END AS il FROM o JOIN stream_v v ON v.match_id=o.match_id AND v.clock_us >= o.c0 AND v.clock_us < coalesce(o.c1, 9000000000) WHERE v.value <= 40),
m AS (SELECT a.match_id, a.c0, a.clock_us, count(*) AS n, avg(b.d) AS m, count(b.il) AS n_il, avg(b.il) AS m_il FROM r a JOIN r b ON a.match_id=b.match_id AND a.c0=b.c0 AND b.clock_us BETWEEN a.clock_us AND a.clock_us + 30000000 GROUP BY 1, 2, 3),
w AS (SELECT m.match_id, m.c0, m.clock_us, any_value(n) AS n, any_value(n_il) AS n_il, max(abs(b.d - m)) AS dev, max(abs(b.il - m_il)) AS dev_il FROM m JOIN r b ON m.match_id=b.match_id AND m.c0=b.c0 AND b.clock_us BETWEEN m.clock_us AND m.clock_us + 30000000 GROUP BY 1, 2, 3)
SELECT o.match_id, o.c0 AS changed_at, coalesce(min(w.clock_us) FILTER ((n >= 5 AND dev <= 45 AND (n_il < 4 OR dev_il <= 30) AND w.clock_us - o.c0 >= 1000000) OR w.clock_us - o.c0 >= 20000000), o.c0 + 6000000) AS settled_at FROM o LEFT JOIN w ON o.match_id=w.match_id AND o.c0=w.c0 GROUP BY 1, 2""", "stream")
def sparse_transition(spark, sf):
    """End of the transition on sparse reads: the first read whose next reads, five at least, stay near their mean in depth and,
    where four are known, in the distance between lines, or that comes 20 s after the change; else 6 s after it.

    Reads are tied to their possession change by one scan; windows ahead are folds of blocks (:func:`window_stats`).
    """
    tl = stream_axis(spark, sf)
    otb = F.col("kind") == "OTB"
    d = scan(stream(spark, sf), tl, was=prev(F.col("team"), when=otb))
    turn = otb & (F.col("was").isNull() | (F.col("was") != F.col("team")))
    d = scan(d, tl, c0=prev(F.col("clock_us"), when=turn, inclusive=True)).where(F.col("c0").isNotNull())
    changes = d.where(F.col("c0") == F.col("clock_us")).select("match_id", "c0").distinct()
    r = d.where(F.col("value") <= 40).select("match_id", "c0", "clock_us", "x", F.when(F.col("kind") != "PA", F.col("y")).alias("lines"))
    spread = ("sum", "n", "min", "max")
    axis = tl.by("match_id", "c0")
    r = window_stats(r, axis, 30 * S + 1, F.col("x"), "d", spread, ahead=True)
    r = window_stats(r, axis, 30 * S + 1, F.col("lines"), "l", spread, ahead=True)

    def strays(p):
        mean = F.try_divide(f"{p}_sum", f"{p}_n")
        return F.greatest(F.col(f"{p}_max") - mean, mean - F.col(f"{p}_min"))

    since = F.col("clock_us") - F.col("c0")
    calm = (F.col("d_n") >= 5) & (strays("d") <= 45) & ((F.col("l_n") < 4) | (strays("l") <= 30))
    st = r.where((calm & (since >= S)) | (since >= 20 * S)).groupBy("match_id", "c0").agg(F.min("clock_us").alias("at"))
    return changes.join(st, ["match_id", "c0"], "left").select("match_id", F.col("c0").alias("changed_at"), F.coalesce("at", F.col("c0") + 6 * S).alias("settled_at"))


# ------------------------------------------------------------------ provider alignment

@query("event_snap", """t AS (SELECT match_id, event_id, clock_us FROM stream_v WHERE kind = 'CH'), p AS (SELECT match_id, event_id AS pid, clock_us AS pc, x, y FROM stream_v WHERE kind <> 'CH'),
c AS (SELECT t.event_id, pid, sqrt(x*x + y*y) AS dist FROM t JOIN p ON t.match_id=p.match_id AND pc BETWEEN clock_us - 6000000 AND clock_us + 6000000)
SELECT t.event_id, CASE WHEN min(dist) < 30 THEN arg_min(pid, dist) END AS snapped_to, round(min(dist),6) AS dist FROM t LEFT JOIN c ON t.event_id=c.event_id GROUP BY t.event_id""", "stream")
def event_snap(spark, sf):
    """Candidate nearest to the ball within a short time of each event, from running minima."""
    s = stream(spark, sf)
    t = s.where(F.col("kind") == "CH").select("match_id", "event_id", "clock_us")
    p = s.where(F.col("kind") != "CH").withColumn("dist", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    best = window_lowest(t, p, stream_axis(spark, sf), 6 * S, F.struct("dist", F.col("event_id").alias("pid")), "b")
    return best.select("event_id", F.when(F.col("b.dist") < 30, F.col("b.pid")).alias("snapped_to"), r6("b.dist").alias("dist"))


@query("event_lag", """t AS (SELECT match_id, period, event_id, clock_us FROM stream_v WHERE kind = 'CH'), p AS (SELECT match_id, clock_us AS pc, sqrt(x*x + y*y) AS dist FROM stream_v WHERE kind <> 'CH'),
c AS (SELECT t.match_id, t.period, t.event_id, arg_min(pc - clock_us, {'d': dist, 'c': pc}) AS lag, min(dist) AS dist FROM t JOIN p ON t.match_id=p.match_id AND pc BETWEEN clock_us - 15000000 AND clock_us + 15000000 GROUP BY 1, 2, 3)
SELECT period, count(*) AS matched, round(median(lag)/1e6,6) AS offset_s FROM c WHERE dist < 20 GROUP BY period""", "stream")
def event_lag(spark, sf):
    """Feed-to-tracking offset: median lag of each event's closest candidate, the earliest of equally close ones, over well-matched events."""
    s = stream(spark, sf)
    t = s.where(F.col("kind") == "CH").select("match_id", "period", "event_id", "clock_us")
    p = s.where(F.col("kind") != "CH").withColumn("dist", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    best = window_lowest(t, p, stream_axis(spark, sf), 15 * S, F.struct("dist", F.col("clock_us").alias("c")), "b").where(F.col("b.dist") < 20)
    lag = best.select("period", (F.col("b.c") - F.col("clock_us")).alias("lag"))
    n = lag.groupBy("period").agg(F.count(F.lit(1)).alias("matched"))
    m = grouped_percentile(lag, ["period"], "lag", {"m": 0.5})
    return n.join(m, "period").select("period", "matched", r6(F.col("m") / 1e6).alias("offset_s"))


@query("period_bounds", "SELECT match_id, period, min(clock_us) AS first_us, max(clock_us) AS last_us, round((max(clock_us)-min(clock_us))/1e6,6) AS seconds FROM stream_v GROUP BY 1, 2", "stream")
def period_bounds(spark, sf):
    a, z = F.min("clock_us"), F.max("clock_us")
    return stream(spark, sf).groupBy("match_id", "period").agg(a.alias("first_us"), z.alias("last_us"), r6((z - a) / 1e6).alias("seconds"))


@query("clock_offset", """w AS (SELECT match_id, period, clock_us - first_value(clock_us) OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id) - (row_number() OVER (PARTITION BY match_id, period ORDER BY clock_us, event_id) - 1) * 1000 AS d FROM stream_v)
SELECT match_id, period, round(avg(d)/1e6,6) AS offset_s, round((max(d)-min(d))/1e6,6) AS spread_s, max(d) - min(d) < 50000 AS constant, round(median(d)/1e6,6) AS median_s FROM w GROUP BY match_id, period""", "stream")
def clock_offset(spark, sf):
    """Offset between two clocks per period, its spread, and whether it is constant."""
    tl = stream_axis(spark, sf, "match_id", "period")
    d = scan(stream(spark, sf), tl, i=total(big(F.lit(1))))
    k = ["match_id", "period"]
    start = stream(spark, sf).groupBy(*k).agg(F.min("clock_us").alias("t0"))
    d = d.join(start, k).select(*k, (F.col("clock_us") - F.col("t0") - (F.col("i") - 1) * 1000).alias("d"))
    a = d.groupBy(*k).agg(r6(F.avg("d") / 1e6).alias("offset_s"), r6((F.max("d") - F.min("d")) / 1e6).alias("spread_s"), (F.max("d") - F.min("d") < 50000).alias("constant"))
    m = grouped_percentile(d, k, "d", {"m": 0.5})
    return a.join(m, k).select(*k, "offset_s", "spread_s", "constant", r6(F.col("m") / 1e6).alias("median_s"))


@query("attach_challenge", """sp AS (SELECT match_id, event_id AS spell_id, user_id AS pid, clock_us AS s, clock_us + 1000000 + CAST(floor(value*10000) AS BIGINT) AS e FROM stream_v WHERE kind = 'OTB'), ch AS (SELECT match_id, event_id, user_id, clock_us AS t FROM stream_v WHERE kind = 'CH'),
c AS (SELECT ch.event_id, spell_id, row_number() OVER (PARTITION BY ch.event_id ORDER BY CASE WHEN ch.user_id % 3 = sp.pid % 3 THEN 0 ELSE 1 END, abs(t - e), spell_id) AS r FROM ch JOIN sp ON ch.match_id=sp.match_id AND t BETWEEN s - 5000000 AND e + 5000000)
SELECT ch.event_id, spell_id FROM ch LEFT JOIN c ON ch.event_id=c.event_id AND r = 1""", "stream")
def attach_challenge(spark, sf):
    """Challenge to the carrier's spell: inside the widened interval, same carrier group first, then the nearest end, then the least id.

    An end that lies back is found by an as-of lookup; one ahead is the least end among the spells that cover the
    challenge, however long they are and however many overlap. Looking back, the greatest value of one end is taken, so
    ids are turned.
    """
    s, tl = stream(spark, sf), stream_axis(spark, sf)
    t, margin = F.col("clock_us"), 5 * S
    spell = F.struct("end", "spell_id")
    end = t + S + F.floor(F.col("value") * 10000)
    sp = s.where(F.col("kind") == "OTB").select("match_id", (F.col("user_id") % 3).alias("grp"), F.col("event_id").alias("spell_id"), t.alias("start"), end.alias("end"))
    d = s.where(F.col("kind") == "CH").select("match_id", (F.col("user_id") % 3).alias("grp"), "event_id", "clock_us")
    for name, keys in (("same", ["match_id", "grp"]), ("any", ["match_id"])):
        d = asof_join(d, sp.withColumn("clock_us", F.col("end")), tl.by(*keys), F.struct("end", (-F.col("spell_id")).alias("turned")), "back", "backward", margin)
        d = d.withColumn("back", F.when(F.col("back").isNotNull(), F.struct("back.end", (-F.col("back.turned")).alias("spell_id"))))
        d = least_covering(d, sp, keys, "clock_us", F.col("start") - margin, F.col("end"), spell, "on")
        gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(t - F.col(f"{c}.end")).alias("gap"), F.col(f"{c}.spell_id").alias("id")))
        d = d.withColumn(name, F.array_min(F.array(gap("back"), gap("on")))).drop("back", "back_t", "on")
    return d.select("event_id", F.coalesce("same.id", "any.id").alias("spell_id"))


@query("touch_spells", """t AS (SELECT *, lag(user_id) OVER w AS pu, lag(clock_us) OVER w AS pt, lag(kind) OVER w AS pk FROM stream_v WHERE kind <> 'OUT' WINDOW w AS (PARTITION BY match_id, period, team ORDER BY clock_us, event_id)),
b AS (SELECT *, CASE WHEN pu IS NOT NULL AND (pu % 4) = (user_id % 4) AND clock_us - pt < 40000000 AND pk IN ('OTB','CH') THEN 0 ELSE 1 END AS nw FROM t),
k AS (SELECT *, sum(nw) OVER (PARTITION BY match_id, period, team ORDER BY clock_us, event_id) AS sid FROM b)
SELECT match_id, period, team, min(clock_us) AS start, max(clock_us) AS "end", count(*) AS touches FROM k GROUP BY match_id, period, team, sid""", "stream")
def touch_spells(spark, sf):
    """Consecutive touches of one player close in time join into a spell unless the last one released the ball."""
    tl = stream_axis(spark, sf, "match_id", "period", "team")
    d = stream(spark, sf).where(F.col("kind") != "OUT").withColumn("player", F.col("user_id") % 4)
    d = scan(d, tl, p=prev(F.struct("player", "clock_us", "kind")))
    same = (F.col("p.player") == F.col("player")) & (F.col("clock_us") - F.col("p.clock_us") < 40 * S) & F.col("p.kind").isin("OTB", "CH")
    d = scan(d, tl, head=prev(F.struct("clock_us", "event_id"), when=~F.coalesce(same, F.lit(False)), inclusive=True))
    return d.groupBy("match_id", "period", "team", "head").agg(F.min("clock_us").alias("start"), F.max("clock_us").alias("end"), F.count(F.lit(1)).alias("touches")).drop("head")


@query("spell_walkback", """f AS (SELECT *, abs(x) <= 35 AS near, row_number() OVER (PARTITION BY match_id ORDER BY clock_us, event_id) AS i FROM stream_v),
n AS (SELECT *, lag(i) OVER (PARTITION BY match_id ORDER BY i) AS pi FROM f WHERE near),
k AS (SELECT *, sum(CASE WHEN pi IS NULL OR i - pi > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY i) AS rid FROM n),
s AS (SELECT event_id, kind, min(clock_us) OVER (PARTITION BY match_id, rid) AS start FROM k)
SELECT event_id, start AS spell_start FROM s WHERE kind = 'PA'""", "stream")
def spell_walkback(spark, sf):
    """Start of the close-contact stretch holding each touch, tolerating gaps of up to two rows."""
    tl = stream_axis(spark, sf)
    d = scan(stream(spark, sf), tl, i=total(big(F.lit(1)))).where(F.abs("x") <= 35)
    d = scan(d, tl, pi=prev(F.col("i")))
    fresh = F.col("pi").isNull() | (F.col("i") - F.col("pi") > 3)
    d = scan(d, tl, start=prev(F.col("clock_us"), when=fresh, inclusive=True))
    return d.where(F.col("kind") == "PA").select("event_id", F.col("start").alias("spell_start"))


@query("resample_rate", """b AS (SELECT match_id, period, CAST(floor(clock_us/20000000e0) AS BIGINT) AS i, avg(x) AS x FROM stream_v GROUP BY ALL),
r AS (SELECT match_id, period, min(i) AS a, max(i) AS z FROM b GROUP BY ALL),
g AS (SELECT match_id, period, unnest(range(CAST(ceil(a*20e0/17) AS BIGINT), CAST(floor(z*20e0/17) AS BIGINT)+1)) AS j FROM r)
SELECT g.match_id, g.period, g.j, round(p.x*(1-(j*17/20e0 - floor(j*17/20e0))) + q.x*(j*17/20e0 - floor(j*17/20e0)),6) AS x FROM g JOIN b p ON p.match_id=g.match_id AND p.period=g.period AND p.i = CAST(floor(j*17/20e0) AS BIGINT) JOIN b q ON q.match_id=g.match_id AND q.period=g.period AND q.i = CAST(floor(j*17/20e0) AS BIGINT)+1""", "stream")
def resample_rate(spark, sf):
    """Regular series onto another regular rate: each target point needs two source rows, fetched by index."""
    k = ["match_id", "period"]
    b = stream(spark, sf).groupBy(*k, F.floor(F.col("clock_us") / 20000000.0).alias("i")).agg(F.avg("x").alias("x"))
    r = b.groupBy(*k).agg(F.min("i").alias("a"), F.max("i").alias("z"))
    g = r.select(*k, F.explode(F.sequence(F.ceil(F.col("a") * 20.0 / 17), F.floor(F.col("z") * 20.0 / 17))).alias("j"))
    at = F.col("j") * 17 / F.lit(20.0)
    g = g.withColumn("i", F.floor(at)).withColumn("w", at - F.floor(at))
    ends = b.select(*k, F.explode(F.array(F.struct(F.col("i").alias("i"), F.lit(0).alias("e")), F.struct((F.col("i") - 1).alias("i"), F.lit(1).alias("e")))).alias("q"), "x")
    ends = ends.groupBy(*k, F.col("q.i").alias("i")).agg(F.max(F.when(F.col("q.e") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("q.e") == 1, F.col("x"))).alias("x1"))
    d = g.join(ends, [*k, "i"]).where(F.col("x0").isNotNull() & F.col("x1").isNotNull())
    return d.select(*k, "j", r6(F.col("x0") * (1 - F.col("w")) + F.col("x1") * F.col("w")).alias("x"))


# ------------------------------------------------------------------ direction and quality

@query("direction_inference", """sh AS (SELECT match_id, period, sum(sign(CASE WHEN team=0 THEN x ELSE -x END)) AS net, count(*) AS n FROM stream_v WHERE kind = 'SH' GROUP BY 1, 2),
kp AS (SELECT match_id, period, avg(x) FILTER (user_id % 5 = 0) AS kx FROM stream_v GROUP BY 1, 2)
SELECT kp.match_id, kp.period, CASE WHEN n >= 2 AND abs(net) >= 0.1e0*n THEN CASE WHEN net > 0 THEN -1 ELSE 1 END END AS shot_dir, CASE WHEN kp.match_id % 4 = 0 THEN NULL WHEN kp.period = 1 THEN -1 ELSE 1 END AS metadata_dir, CASE WHEN kx > 0 THEN 1 ELSE -1 END AS keeper_dir,
 coalesce(CASE WHEN n >= 2 AND abs(net) >= 0.1e0*n THEN CASE WHEN net > 0 THEN -1 ELSE 1 END END, CASE WHEN kp.match_id % 4 = 0 THEN NULL WHEN kp.period = 1 THEN -1 ELSE 1 END, CASE WHEN kx > 0 THEN 1 ELSE -1 END) AS dir FROM kp LEFT JOIN sh ON sh.match_id=kp.match_id AND sh.period=kp.period""", "stream")
def direction_inference(spark, sf):
    return directions(spark, sf)


@per_session
def directions(spark, sf):
    """Defended end per period: where the shots went, else the start sides, else where the keeper stands."""
    shot = F.col("kind") == "SH"
    a = stream(spark, sf).groupBy("match_id", "period").agg(
        F.sum(F.when(shot, F.signum(F.col("x") * P.flip(F.col("team"))))).alias("net"), F.count_if(shot).alias("n"), F.avg(F.when(F.col("user_id") % 5 == 0, F.col("x"))).alias("kx")
    )
    by_shot = F.when((F.col("n") >= 2) & (F.abs("net") >= 0.1 * F.col("n")), F.when(F.col("net") > 0, -1).otherwise(1))
    by_meta = F.when(F.col("match_id") % 4 == 0, None).when(F.col("period") == 1, -1).otherwise(1)
    by_keeper = F.when(F.col("kx") > 0, 1).otherwise(-1)
    return a.select(
        "match_id", "period", by_shot.alias("shot_dir"), by_meta.alias("metadata_dir"), by_keeper.alias("keeper_dir"), F.coalesce(by_shot, by_meta, by_keeper).alias("dir")
    )


@query("keeper_swap_check", """sh AS (SELECT match_id, period, sum(sign(CASE WHEN team=0 THEN x ELSE -x END)) AS net, count(*) AS n FROM stream_v WHERE kind = 'SH' GROUP BY 1, 2),
kp AS (SELECT match_id, period, avg(x) FILTER (user_id % 5 = 0) AS kx FROM stream_v GROUP BY 1, 2),
d AS (SELECT kp.match_id, kp.period, CASE WHEN n >= 2 AND abs(net) >= 0.1e0*n THEN CASE WHEN net > 0 THEN -1 ELSE 1 END END AS sd, CASE WHEN kx > 0 THEN 1 ELSE -1 END AS kd FROM kp LEFT JOIN sh ON sh.match_id=kp.match_id AND sh.period=kp.period)
SELECT match_id, count(*) AS swapped, string_agg(CAST(period AS VARCHAR), ',' ORDER BY period) AS periods FROM d WHERE sd IS NOT NULL AND sd <> kd GROUP BY match_id""", "stream")
def keeper_swap_check(spark, sf):
    """Periods in which the labelled keeper stands at the end the shots say the other team defends."""
    d = directions(spark, sf).where(F.col("shot_dir") != F.col("keeper_dir"))
    return d.groupBy("match_id").agg(F.count(F.lit(1)).alias("swapped"), F.array_join(F.array_sort(F.collect_list(F.col("period").cast("string"))), ",").alias("periods"))


@query("keeper_swap_fix", """SELECT frame, entity, CAST(CASE WHEN label >= 5 AND is_gk THEN CASE WHEN entity = 0 THEN 11 ELSE 0 END ELSE entity END AS INTEGER) AS true_entity, CAST(CASE WHEN label >= 5 AND is_gk THEN 1 - team ELSE team END AS INTEGER) AS true_team FROM positions_v WHERE entity < 22""", "positions")
def keeper_swap_fix(spark, sf):
    """Keeper labels swapped back in the flagged groups; everyone else is left alone."""
    p = moments(spark, sf).select("frame", "label", F.inline("players"))
    bad = (F.col("label") >= 5) & F.col("gk")
    return p.select(
        "frame", "entity", F.when(bad, F.when(F.col("entity") == 0, 11).otherwise(0)).otherwise(F.col("entity")).alias("true_entity"), F.when(bad, 1 - F.col("team")).otherwise(F.col("team")).alias("true_team")
    )


@query("quality_rules", """f AS (SELECT match_id, period, count(*) AS frames, 100e0*avg((kind <> 'OUT')::INT) AS ball_pct, count(DISTINCT user_id) AS players, count(*) FILTER (kind='SH') AS shots, count(*) FILTER (kind='SH' AND team=0) AS home_shots FROM stream_v GROUP BY 1, 2)
SELECT match_id, period, 'few frames' AS rule, 'problem' AS severity FROM f WHERE frames < 410 UNION ALL SELECT match_id, period, 'ball often missing', 'warning' FROM f WHERE ball_pct < 80 UNION ALL SELECT match_id, period, 'one-sided shots', 'warning' FROM f WHERE abs(2*home_shots - shots) > 0.1*shots""", "stream")
def quality_rules(spark, sf):
    """Every broken rule per match and period with its severity; one profile row feeds all rules."""
    f = profile(spark, sf)
    rule = lambda cond, name, sev: F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity")))
    rules = F.array(
        rule(F.col("frames") < 410, "few frames", "problem"), rule(F.col("ball_pct") < 80, "ball often missing", "warning"),
        rule(F.abs(2 * F.col("home_shots") - F.col("shots")) > 0.1 * F.col("shots"), "one-sided shots", "warning"),
    )
    return f.select("match_id", "period", F.inline(F.filter(rules, lambda r: r.isNotNull())))


@per_session
def profile(spark, sf):
    shot = F.col("kind") == "SH"
    return stream(spark, sf).groupBy("match_id", "period").agg(
        F.count(F.lit(1)).alias("frames"), (100.0 * F.avg((F.col("kind") != "OUT").cast("int"))).alias("ball_pct"), F.count_distinct("user_id").alias("players"),
        F.count_if(shot).alias("shots"), F.count_if(shot & (F.col("team") == 0)).alias("home_shots"),
    )


@query("validation_profile", "SELECT match_id, period, count(*) AS frames, round(100e0*avg((kind <> 'OUT')::INT),6) AS ball_pct, count(DISTINCT user_id) AS players, count(*) FILTER (kind='SH') AS shots, count(*) FILTER (kind='SH' AND team=0) AS home_shots FROM stream_v GROUP BY 1, 2", "stream")
def validation_profile(spark, sf):
    return profile(spark, sf).withColumn("ball_pct", r6("ball_pct"))


FAULTS_SQL = """m AS (SELECT match_id, 2*match_id AS home_id, 2*match_id+1 AS away_id, 2*match_id + CASE WHEN count(*) % 5 = 0 THEN 1 ELSE 0 END AS meta_home_id,
  CASE WHEN count(*) % 7 > 0 THEN 103e0 + count(*) % 4 END AS length, 68e0 AS width FROM stream_v GROUP BY match_id),
p AS (SELECT match_id, 2*match_id+team AS team_id, user_id, count(*) AS n, user_id % 97 = 0 AS gk FROM stream_v WHERE user_id % 5 <> match_id % 5 GROUP BY 1, 2, 3, team),
r AS (SELECT match_id, team_id, count(*) AS players, count(*) FILTER (gk) AS keepers, count(*) FILTER (n >= 3) AS starters FROM p GROUP BY 1, 2),
t AS (SELECT m.match_id, part, coalesce(players, 0) AS players, coalesce(keepers, 0) AS keepers, coalesce(starters, 0) AS starters
  FROM (SELECT match_id, 'home' AS part, home_id AS team_id FROM m UNION ALL SELECT match_id, 'away', away_id FROM m) m LEFT JOIN r ON m.match_id = r.match_id AND m.team_id = r.team_id),
d AS (SELECT match_id, period, CASE WHEN match_id % 3 > 0 THEN CASE WHEN (match_id + period) % 2 = 0 THEN 1 ELSE -1 END END AS a,
  nullif(CAST(sign(sum(CASE WHEN kind = 'SH' THEN CASE WHEN (x > 0) = (team = 0) THEN 1 ELSE -1 END ELSE 0 END)) AS INT), 0) AS b,
  nullif(CAST(sign(sum(CASE WHEN user_id % 97 = 0 THEN CASE WHEN (x > 0) = (team = 1) THEN 1 ELSE -1 END ELSE 0 END)) AS INT), 0) AS c FROM stream_v GROUP BY 1, 2)
SELECT match_id, 'match' AS part, 'home team of the metadata differs' AS rule, 'problem' AS severity FROM m WHERE meta_home_id <> home_id
UNION ALL SELECT match_id, 'match', 'pitch size missing', 'warning' FROM m WHERE length IS NULL
UNION ALL SELECT match_id, 'match', 'pitch of other size', 'warning' FROM m WHERE abs(length - 105) > 0.5
UNION ALL SELECT match_id, part, 'no roster', 'problem' FROM t WHERE players = 0
UNION ALL SELECT match_id, part, 'no keeper in the roster', 'problem' FROM t WHERE keepers = 0
UNION ALL SELECT match_id, part, 'not eleven starters', 'warning' FROM t WHERE starters <> 11
UNION ALL SELECT match_id, period::VARCHAR, 'no direction of play', 'problem' FROM d WHERE coalesce(a, b, c) IS NULL
UNION ALL SELECT match_id, period::VARCHAR, 'start sides disagree with shots', 'warning' FROM d WHERE a <> b
UNION ALL SELECT match_id, period::VARCHAR, 'keepers at the other goal', 'warning' FROM d WHERE c <> b"""


@query("match_faults", FAULTS_SQL, "stream")
def match_faults(spark, sf):
    """Broken rules of metadata, rosters and directions; the adapter derives all three, some of them wrong, from the stream."""
    s = stream(spark, sf)
    mid, n = F.col("match_id"), F.count(F.lit(1))
    matches = s.groupBy("match_id").agg(n.alias("n")).select(
        "match_id", (2 * mid).alias("home_id"), (2 * mid + 1).alias("away_id"), (2 * mid + F.when(F.col("n") % 5 == 0, 1).otherwise(0)).alias("meta_home_id"),
        F.when(F.col("n") % 7 > 0, 103.0 + F.col("n") % 4).alias("length"), F.lit(68.0).alias("width"),
    )
    listed = s.where(F.col("user_id") % 5 != mid % 5).groupBy("match_id", "team", "user_id").agg(n.alias("n"))
    roster = listed.select("match_id", (2 * mid + F.col("team")).alias("team_id"), F.col("user_id").alias("player"), (F.col("n") >= 3).alias("started"), F.when(F.col("user_id") % 97 == 0, "GK").alias("position"))

    def majority(rows, ahead):
        total = F.sum(F.when(rows, F.when((F.col("x") > 0) == ahead, 1).otherwise(-1)).otherwise(0))
        return F.nullif(F.signum(total).cast("int"), F.lit(0))

    directions = s.groupBy("match_id", "period").agg(
        majority(F.col("kind") == "SH", F.col("team") == 0).alias("by_shots"), majority(F.col("user_id") % 97 == 0, F.col("team") == 1).alias("by_keepers")
    ).withColumn("by_meta", F.when(mid % 3 > 0, F.when((mid + F.col("period")) % 2 == 0, 1).otherwise(-1)))
    return quality.match_faults(matches, roster, directions)


# ------------------------------------------------------------------ chapters and coverage

CHAP_SQL = """b AS (SELECT match_id, period, min(clock_us) AS lo, max(clock_us) AS hi, greatest(1, CAST(round_even((max(clock_us)-min(clock_us))/300000000e0,0) AS BIGINT)) AS n FROM stream_v GROUP BY 1, 2),
tg AS (SELECT match_id, period, n, k, lo + CAST(floor((hi-lo)*k/n) AS BIGINT) AS clock_us FROM b, range(1,19) g(k) WHERE k < n),
sn AS (SELECT tg.match_id, tg.period, max(tg.k) AS k, s.clock_us AS cut FROM tg ASOF JOIN stream_v s ON tg.match_id=s.match_id AND tg.period=s.period AND tg.clock_us <= s.clock_us GROUP BY 1, 2, 4),
cc AS (SELECT s.*, coalesce(c.k, 0) AS chapter FROM stream_v s ASOF LEFT JOIN sn c ON s.match_id=c.match_id AND s.period=c.period AND s.clock_us > c.cut)"""


@per_session
def chaptered(spark, sf):
    """Every row with its chapter: equal slices of about five minutes whose cuts snap to real rows."""
    tl = stream_axis(spark, sf, "match_id", "period")
    s = stream(spark, sf)
    b = s.groupBy("match_id", "period").agg(F.min("clock_us").alias("lo"), F.max("clock_us").alias("hi"))
    b = b.withColumn("n", F.greatest(big(F.lit(1)), F.bround((F.col("hi") - F.col("lo")) / 300000000.0).cast("bigint")))
    span = F.col("hi") - F.col("lo")
    tg = b.where(F.col("n") > 1).withColumn("k", F.explode(F.sequence(big(F.lit(1)), F.col("n") - 1)))
    tg = tg.select("match_id", "period", "k", (F.col("lo") + F.floor(span * F.col("k") / F.col("n"))).alias("clock_us"))
    cut = asof_join(tg, s.select("match_id", "period", "clock_us"), tl, F.lit(1), "hit", "forward")
    # two cuts can snap to one row; the slice between them is empty
    cut = cut.groupBy("match_id", "period", F.col("hit_t").alias("clock_us")).agg(F.max("k").alias("k"))
    rows = s.select("match_id", "period", "kind", F.col("clock_us").alias("at"), (F.col("clock_us") - 1).alias("clock_us"))
    return asof_join(rows, cut, tl, F.col("k"), "chapter").withColumn("clock_us", F.col("at")).withColumn("chapter", F.coalesce("chapter", big(F.lit(0))))


@query("chapters", f"{CHAP_SQL} SELECT match_id, period, chapter, min(clock_us) AS lo, max(clock_us) AS hi, count(*) AS frames, printf('%d:%02d', CAST(round_even(min(clock_us)/1e6,0) AS BIGINT)//60, CAST(round_even(min(clock_us)/1e6,0) AS BIGINT)%60) AS starts FROM cc GROUP BY 1, 2, 3", "stream")
def chapters(spark, sf):
    return chaptered(spark, sf).groupBy("match_id", "period", "chapter").agg(
        F.min("clock_us").alias("lo"), F.max("clock_us").alias("hi"), F.count(F.lit(1)).alias("frames"), T.clock(F.min("clock_us") / 1e6).alias("starts")
    )


@query("coverage", f"{CHAP_SQL} SELECT match_id, period, chapter, round(100e0*avg((kind <> 'OUT')::INT),6) AS ball_pct, count(*) AS frames FROM cc GROUP BY GROUPING SETS ((match_id, period, chapter), (match_id))", "stream")
def coverage(spark, sf):
    """Share of rows with the ball known per chapter, and per match (empty period and chapter)."""
    k = ["match_id", "period", "chapter"]
    d = chaptered(spark, sf).select(*k, (F.col("kind") != "OUT").cast("int").alias("ok"))
    return d.groupingSets([k, ["match_id"]], *k).agg(r6(100.0 * F.avg("ok")).alias("ball_pct"), F.count(F.lit(1)).alias("frames"))


@query("longest_gap", """b AS (SELECT match_id, period, min(clock_us) AS lo, max(clock_us) AS hi FROM stream_v GROUP BY 1, 2), k AS (SELECT match_id, period, clock_us FROM stream_v WHERE kind = 'PA' UNION ALL SELECT match_id, period, lo FROM b UNION ALL SELECT match_id, period, hi FROM b),
g AS (SELECT match_id, period, clock_us - lag(clock_us) OVER (PARTITION BY match_id, period ORDER BY clock_us) AS gap FROM k) SELECT match_id, period, max(gap) AS longest_us, round(max(gap)/1e6,6) AS longest_s FROM g GROUP BY 1, 2""", "stream")
def longest_gap(spark, sf):
    """Longest stretch without a known ball, the edges of the period included."""
    k = ["match_id", "period"]
    known = F.col("kind") == "PA"
    d = scan(stream(spark, sf), stream_axis(spark, sf, *k), p=prev(F.col("clock_us"), when=known))
    a = d.groupBy(*k).agg(
        F.max(F.when(known, F.col("clock_us") - F.col("p"))).alias("inner"), F.min("clock_us").alias("lo"), F.max("clock_us").alias("hi"),
        F.min(F.when(known, F.col("clock_us"))).alias("first"), F.max(F.when(known, F.col("clock_us"))).alias("last"),
    )
    gap = F.greatest("inner", F.col("first") - F.col("lo"), F.col("hi") - F.col("last"))
    return a.select(*k, F.coalesce(gap, F.col("hi") - F.col("lo")).alias("longest_us")).withColumn("longest_s", r6(F.col("longest_us") / 1e6))


@query("polar_area", """q AS (SELECT label, CAST(least(floor(sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy))/5e0),11) AS BIGINT) AS ri, CAST(floor((atan2(y-qy, x-qx)+pi())/(2*pi())*30) AS BIGINT) % 30 AS pi_ FROM def_v),
n AS (SELECT label, ri, pi_, count(*) AS n FROM q GROUP BY 1, 2, 3), r AS (SELECT ri, CASE WHEN ri=0 THEN 0e0 ELSE ri*5e0-2.5e0 END AS lo, CASE WHEN ri=11 THEN 55e0 ELSE ri*5e0+2.5e0 END AS hi FROM range(0,12) g(ri))
SELECT label, n.ri AS ri, count(*) AS cells, CAST(sum(n) AS BIGINT) AS players, round((hi*hi-lo*lo)*pi()/30,6) AS area, round(sum(n)/((hi*hi-lo*lo)*pi()/30),6) AS density FROM n JOIN r ON n.ri=r.ri GROUP BY label, n.ri, hi, lo""", "positions")
def polar_area(spark, sf):
    """Players per polar cell around the ball and its area element (edges halfway between grid nodes)."""
    m = moments(spark, sf).withColumn("p", F.explode(G.outfield(F.col("players"), 1 - F.col("poss"))))
    dx, dy = F.col("p.x") - F.col("ball_x"), F.col("p.y") - F.col("ball_y")
    ri = F.least(F.floor(F.sqrt(dx * dx + dy * dy) / 5.0), big(F.lit(11)))
    pi_ = F.floor((F.atan2(dy, dx) + F.pi()) / (2 * F.pi()) * 30) % 30
    n = m.groupBy("label", ri.alias("ri"), pi_.alias("phi")).agg(F.count(F.lit(1)).alias("n"))
    lo = F.when(F.col("ri") == 0, 0.0).otherwise(F.col("ri") * 5.0 - 2.5)
    hi = F.when(F.col("ri") == 11, 55.0).otherwise(F.col("ri") * 5.0 + 2.5)
    area = (hi * hi - lo * lo) * F.pi() / 30
    return n.groupBy("label", "ri").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("players")).withColumn("a", area).select(
        "label", "ri", "cells", "players", r6("a").alias("area"), r6(F.col("players") / F.col("a")).alias("density")
    )


@query("position_accuracy", f"""{ASSIGNED_SQL},
l AS (SELECT vec_id AS frame, label FROM embeddings), n AS (SELECT label, count(*) * 10 AS seen FROM l GROUP BY 1)
SELECT label, count(*) AS points, round(quantile_cont(err, 0.5), 6) AS median, round(quantile_cont(err, 0.75), 6) AS p75, round(quantile_cont(err, 0.9), 6) AS p90,
  round(100.0e0 * avg(CASE WHEN err <= 1 THEN 1 ELSE 0 END), 6) AS within_1m, round(100.0e0 * avg(CASE WHEN err <= 2 THEN 1 ELSE 0 END), 6) AS within_2m,
  round(100.0e0 * count(*) FILTER (err <= 3) / any_value(seen), 6) AS coverage FROM e JOIN l USING (frame) JOIN n USING (label) GROUP BY label""", "positions")
def position_accuracy(spark, sf):
    """Error percentiles and hit shares of the optimal matching, with coverage, per label."""
    e = assignment_error(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), "label"), "frame")
    p = grouped_percentile(e, ["label"], "err", {"median": 0.5, "p75": 0.75, "p90": 0.9})
    share = lambda m: r6(100.0 * F.avg((F.col("err") <= m).cast("int")))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("points"), share(1.0).alias("within_1m"), share(2.0).alias("within_2m"), (100.0 * F.count_if(F.col("err") <= 3.0)).alias("hit"))
    seen = table(spark, sf, "embeddings").groupBy("label").agg((F.count(F.lit(1)) * 10).alias("seen"))
    return n.join(p, "label").join(seen, "label").select("label", "points", r6("median").alias("median"), r6("p75").alias("p75"), r6("p90").alias("p90"), "within_1m", "within_2m", r6(F.col("hit") / F.col("seen")).alias("coverage"))


@query("ball_accuracy", """p AS (SELECT b.label, sqrt((v.x-qx)*(v.x-qx) + (v.y-qy)*(v.y-qy)) AS err, v.team = b.poss_team AS agree FROM ball_v b JOIN stream_v v ON v.event_id = b.frame)
SELECT label, count(*) AS n, round(median(err), 6) AS ball_err, round(100.0e0 * avg(CASE WHEN agree THEN 1 ELSE 0 END), 6) AS possession_agreed FROM p GROUP BY label""", "positions stream")
def ball_accuracy(spark, sf):
    """Distance of the ball from its place in the event feed and agreement on the side in possession, per label."""
    b = moments(spark, sf).select(big("frame").alias("event_id"), "label", "poss", "ball_x", "ball_y")
    dx, dy = F.col("x") - F.col("ball_x"), F.col("y") - F.col("ball_y")
    d = stream(spark, sf).join(b, "event_id").select("label", F.sqrt(dx * dx + dy * dy).alias("err"), (F.col("team") == F.col("poss")).alias("agree"))
    n = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(100.0 * F.avg(F.col("agree").cast("int"))).alias("possession_agreed"))
    return n.join(grouped_percentile(d, ["label"], "err", {"ball_err": 0.5}), "label").select("label", "n", r6("ball_err").alias("ball_err"), "possession_agreed")


@query("offset_search", """a AS (SELECT match_id, CAST(floor(clock_us/10000000e0) AS BIGINT) AS s, avg(x) AS x FROM stream_v WHERE team=0 GROUP BY 1, 2), b AS (SELECT match_id, CAST(floor(clock_us/10000000e0) AS BIGINT) AS s, avg(x) AS x FROM stream_v WHERE team=1 GROUP BY 1, 2),
e AS (SELECT o, median(abs(a.x-b.x)) AS m FROM a, range(-5,6) g(o), b WHERE a.match_id=b.match_id AND b.s = a.s + o GROUP BY o)
SELECT CAST(o AS INTEGER) AS "offset", round(m,6) AS median_err, m = (SELECT min(m) FROM e) AS best FROM e""", "stream")
def offset_search(spark, sf):
    """Clock offset with the smallest median error among candidates."""
    slot = F.floor(F.col("clock_us") / 10000000.0).alias("s")
    one = lambda t, n: stream(spark, sf).where(F.col("team") == t).groupBy("match_id", slot).agg(F.avg("x").alias(n))
    a = one(0, "xa").withColumn("offset", F.explode(F.sequence(F.lit(-5), F.lit(5)))).withColumn("s", F.col("s") + F.col("offset"))
    e = a.join(one(1, "xb"), ["match_id", "s"]).select("offset", F.abs(F.col("xa") - F.col("xb")).alias("err"))
    m = grouped_percentile(e, ["offset"], "err", {"m": 0.5})
    low = m.agg(F.min("m").alias("low"))  # one row
    return m.join(F.broadcast(low)).select("offset", r6("m").alias("median_err"), (F.col("m") == F.col("low")).alias("best"))
