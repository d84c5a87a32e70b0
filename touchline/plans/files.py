"""Readers and writers exercised on files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import feed as views
from touchline.operators import raster as R
from touchline.plans.boards import BOARD_SQL
from touchline.plans.events import CHANCE_SQL, PRESS_SQL, SETTLE_SQL, TURN_SQL
from touchline.plans.frames import label_histogram
from touchline.plans.registry import big, query, r6
from touchline.sources import feeds, match_files, sinks, tracking
from touchline.sources.driver_tables import feed, moments, per_session, stream, table
from touchline.sources.scratch import scratch

_written: dict[tuple, str] = {}


def once(spark, sf, name, write):
    """Write a file set once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = scratch(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


# ------------------------------------------------------------------ tracking files

def tracking_lines(spark, sf):
    """Frames as tracking lines, in the order of their numbers: some without smoothed players, the ball as object, list or only raw."""
    m = moments(spark, sf).sort("frame")

    def side(team, shift, speed):
        ps = F.filter(F.col("players"), lambda p: p["team"] == team)
        extra = [F.lit(2.5).alias("speed")] if speed else []
        return F.transform(
            ps, lambda p: F.struct(
                p["entity"].cast("string").alias("jerseyNum"), F.round(p["x"] + shift, 3).alias("x"), F.round(p["y"], 3).alias("y"), *extra,
                F.lit("HIGH").alias("confidence"), F.lit("VISIBLE").alias("visibility"),
            )
        )

    b = F.struct(F.round("ball_x", 3).alias("x"), F.round("ball_y", 3).alias("y"), F.round(F.col("ball_x") / 10, 3).alias("z"), F.lit("VISIBLE").alias("visibility"))
    smooth = lambda t: F.when(F.col("label") == 4, F.array().cast("array<struct<jerseyNum:string,x:double,y:double,confidence:string,visibility:string>>")).otherwise(side(t, 0.0, False))
    kind = F.when(F.col("label") == 7, "SH").otherwise("PA")
    d = m.select(
        "label", b.alias("b"), F.col("frame").alias("frameNum"), F.lit(1).alias("period"), (F.col("frame") / 29.97).alias("periodElapsedTime"),
        side(0, 0.5, True).alias("homePlayers"), side(1, 0.5, True).alias("awayPlayers"), smooth(0).alias("homePlayersSmoothed"), smooth(1).alias("awayPlayersSmoothed"),
        F.array(b.withField("x", b["x"] + 1)).alias("balls"), F.floor(F.col("frame") / 5).cast("double").alias("game_event_id"),
        F.struct(
            F.lit("OTB").alias("game_event_type"), F.col("poss").cast("string").alias("team_id"), F.concat(F.lit("P"), F.col("label")).alias("player_name"),
            (F.col("frame") % 23).cast("string").alias("shirt_number"), F.when(F.col("label") == 0, "GK").otherwise("CM").alias("position_group_type"),
            (F.col("poss") == 0).alias("home_ball"), F.col("frame").alias("start_frame"), F.when(F.col("label") != 1, F.col("frame") + 3).alias("end_frame"),
        ).alias("game_event"),
        F.when(F.col("label") != 9, F.floor(F.col("frame") / 3).cast("double")).alias("possession_event_id"),
        F.struct(
            kind.alias("possession_event_type"), F.floor(F.col("frame") / 5).alias("game_event_id"), F.when(F.col("label") % 2 == 0, F.col("frame")).alias("start_frame")
        ).alias("possession_event"),
    )
    body = F.to_json(F.struct(*[c for c in d.columns if c not in ("label", "b")]))
    js = F.to_json("b")
    smoothed = F.when(F.col("label") % 3 == 0, js).when(F.col("label") % 3 == 1, F.concat(F.lit("["), js, F.lit("]"))).otherwise(F.lit("null"))
    return d.withColumn("b0", body).select(
        F.concat(F.expr("substring(b0, 1, length(b0) - 1)"), F.lit(',"ballsSmoothed":'), smoothed, F.lit("}")).alias("value")
    )


def tracking_path(spark, sf):
    return once(spark, sf, "tracking", lambda p: tracking_lines(spark, sf).write.option("compression", "bzip2").text(p))


@query("scan_tracking_json", "SELECT frame, CASE WHEN team=0 THEN 'home' ELSE 'away' END AS side, CAST(entity AS VARCHAR) AS jersey, round(CASE WHEN label=4 THEN x+0.5e0 ELSE x END,3)+0e0 AS x, round(y,3)+0e0 AS y FROM positions_v WHERE entity < 22", "positions")
def scan_tracking_json(spark, sf):
    """bzip2 JSON lines to one row per frame, side and jersey, with the raw players where nothing is smoothed."""
    t = tracking.unique_frames(tracking.read_tracking(spark, tracking_path(spark, sf)))
    return tracking.positions(t).select(F.col("frameNum").alias("frame"), "side", "jersey", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


@query("ball_fallback", "SELECT frame, round(CASE WHEN label % 3 = 2 THEN round(qx,3)+1 ELSE qx END,3)+0e0 AS x, round(qy,3)+0e0 AS y, greatest(round(qx/10,3),0)+0e0 AS z FROM ball_v", "positions")
def ball_fallback(spark, sf):
    t = tracking.ball(tracking.read_tracking(spark, tracking_path(spark, sf)))
    return t.select(F.col("frameNum").alias("frame"), r6("ball.x", 3).alias("x"), r6("ball.y", 3).alias("y"), r6("ball.z", 3).alias("z"))


@query("players_fallback", "SELECT label, count(*) AS frames, round(avg(x),6) AS mean_x FROM (SELECT frame, label, round(CASE WHEN label=4 THEN x+0.5e0 ELSE x END,3) AS x FROM positions_v WHERE entity < 11) q GROUP BY label", "positions")
def players_fallback(spark, sf):
    t = tracking.read_tracking(spark, tracking_path(spark, sf))
    p = tracking.positions(t).where(F.col("side") == "home")
    lab = moments(spark, sf).select(F.col("frame").alias("frameNum"), "label")
    return p.join(lab, "frameNum").groupBy("label").agg(F.count(F.lit(1)).alias("frames"), r6(F.avg("x")).alias("mean_x"))


@query("embedded_events", "SELECT CAST(floor(frame/5e0) AS BIGINT) AS id, min(frame) AS first_frame, 'OTB' AS kind, CAST(arg_min(poss_team, frame) AS VARCHAR) AS team_id FROM ball_v GROUP BY 1", "positions")
def embedded_events(spark, sf):
    return tracking.embedded_events(tracking.read_tracking(spark, tracking_path(spark, sf)))


@query("embedded_game_events", """f AS (SELECT CAST(floor(frame/5e0) AS BIGINT) AS id, min(frame) AS f, arg_min(label, frame) AS label, arg_min(poss_team, frame) AS poss FROM ball_v GROUP BY 1)
SELECT id, 'OTB' AS kind, CAST(poss AS VARCHAR) AS team_id, 'P' || label AS player, CAST(f % 23 AS VARCHAR) AS shirt, CASE WHEN label = 0 THEN 'GK' ELSE 'CM' END AS position, poss = 0 AS home_ball,
 f AS start_frame, CASE WHEN label <> 1 THEN f + 3 END AS end_frame, CAST(1 AS INTEGER) AS period FROM f""", "positions")
def embedded_game_events(spark, sf):
    """Every field of the game events on the tracking lines, first mention of an event counts."""
    return tracking.game_events(tracking.read_tracking(spark, tracking_path(spark, sf)))


@query("embedded_possession_events", """SELECT CAST(floor(frame/3e0) AS BIGINT) AS id, CASE WHEN arg_min(label, frame) = 7 THEN 'SH' ELSE 'PA' END AS kind, CAST(floor(min(frame)/5e0) AS BIGINT) AS game_event_id, min(frame) AS frame
FROM ball_v WHERE label <> 9 GROUP BY 1""", "positions")
def embedded_possession_events(spark, sf):
    """Possession events on the tracking lines with the game event they belong to; without a frame of its own, the line's counts."""
    return tracking.possession_events(tracking.read_tracking(spark, tracking_path(spark, sf)))


@query("scan_strided", "SELECT frame, label = 7 AS is_shot FROM ball_v WHERE frame % 30 = 0 OR label = 7", "positions")
def scan_strided(spark, sf):
    return tracking.strided(spark, tracking_path(spark, sf), 30).select(F.col("frameNum").alias("frame"), "is_shot")


# ------------------------------------------------------------------ feeds and dimensions

def events_path(spark, sf):
    def write(p):
        s = stream(spark, sf)
        sec = F.col("clock_us") / 1e6
        e = s.select(
            F.col("match_id").alias("gameId"), F.col("event_id").alias("gameEventId"), sec.alias("startTime"), (sec + 1).alias("endTime"),
            F.struct(F.when(F.col("kind") == "OUT", "OUT").otherwise("OTB").alias("gameEventType"), "period", big("team").alias("teamId"), F.col("user_id").alias("playerId")).alias("gameEvents"),
            F.struct(F.when(F.col("value") > 20, "P").otherwise("N").alias("initialPressureType")).alias("initialTouch"),
            F.when(F.col("kind") != "OUT", F.struct(F.col("kind").alias("possessionEventType"))).alias("possessionEvents"),
            F.array(F.struct("x", "y", F.lit(0.0).alias("z"))).alias("ball"),
        )
        sinks.write_json_arrays(e, p)

    return once(spark, sf, "events", write)


@query("scan_events_json", "SELECT match_id AS game, event_id, period, CAST(team AS BIGINT) AS team, CASE WHEN kind='OUT' THEN NULL ELSE kind END AS kind, CASE WHEN value > 20 THEN 'P' ELSE 'N' END AS tag, x, y FROM stream_v", "stream")
def scan_events_json(spark, sf):
    e = feeds.read_events(spark, events_path(spark, sf))
    b = F.get("ball", F.lit(0))
    return e.select(
        F.col("gameId").alias("game"), F.col("gameEventId").alias("event_id"), "gameEvents.period", F.col("gameEvents.teamId").alias("team"),
        F.col("possessionEvents.possessionEventType").alias("kind"), F.col("initialTouch.initialPressureType").alias("tag"), b["x"].alias("x"), b["y"].alias("y"),
    )


@query("scan_roster_json", "SELECT CAST(c_nationkey AS VARCHAR) AS team_id, CAST(c_custkey AS VARCHAR) AS player_id, c_name AS name, c_mktsegment = 'BUILDING' AS gk, c_acctbal > 0 AS started FROM customer")
def scan_roster_json(spark, sf):
    def write(p):
        c = table(spark, sf, "customer")
        sinks.write_json_lines(
            c.select(
                F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("nickname")).alias("player"), F.when(F.col("c_mktsegment") == "BUILDING", "GK").otherwise("CM").alias("positionGroupType"),
                (F.col("c_custkey") % 99).cast("string").alias("shirtNumber"), (F.col("c_acctbal") > 0).alias("started"), F.struct(F.col("c_nationkey").cast("string").alias("id")).alias("team"),
            ), p,
        )

    return feeds.read_roster(spark, once(spark, sf, "roster", write)).select("team_id", "player_id", "name", "gk", "started")


@query("scan_metadata_json", """SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_acctbal < 0 THEN 29.97e0 ELSE 25e0 END AS fps, CASE WHEN s_nationkey > 20 THEN 105e0 ELSE 100e0 + s_nationkey/10e0 END AS length, s_acctbal > 5000 AS home_right_2, CASE WHEN s_nationkey > 10 THEN NOT (s_acctbal > 5000) ELSE NOT (s_acctbal > 2000) END AS home_right_3 FROM supplier""")
def scan_metadata_json(spark, sf):
    """Match metadata with defaults, and the defended end of each period from the start sides."""

    def write(p):
        s = table(spark, sf, "supplier")
        pitch = F.when(F.col("s_nationkey") <= 20, F.array(F.struct((100 + F.col("s_nationkey") / 10).alias("length"), F.lit(68.0).alias("width"))))
        sinks.write_json_lines(
            s.select(
                F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_acctbal") >= 0, 25.0).alias("fps"), (F.col("s_acctbal") > 5000).alias("homeTeamStartLeft"),
                F.when(F.col("s_nationkey") <= 10, F.col("s_acctbal") > 2000).alias("homeTeamStartLeftExtraTime"), F.struct(pitch.alias("pitches")).alias("stadium"),
            ), p,
        )

    m = feeds.read_metadata(spark, once(spark, sf, "metadata", write))
    return m.select("id", "fps", "length", feeds.home_defends_right(F.lit(2)).alias("home_right_2"), feeds.home_defends_right(F.lit(3)).alias("home_right_3"))


@query("scan_registry_json", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(g.k AS INTEGER) AS "no", CASE WHEN g.k = 0 THEN 'H' ELSE 'A' END AS team, CAST(o_custkey % 90 + g.k AS INTEGER) AS minute, o_orderstatus AS kind FROM orders, range(0,2) g(k) WHERE g.k < CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END""")
def scan_registry_json(spark, sf):
    """Match registry documents to a goals dimension; matches without goals give no row."""

    def write(p):
        o = table(spark, sf, "orders")
        goal = lambda t, k: F.array(F.lit(t), (F.col("o_custkey") % 90 + k).cast("string"), F.col("o_orderstatus"))
        goals = F.when(F.col("o_orderstatus") == "F", F.array(goal("H", 0), goal("A", 1))).when(F.col("o_orderstatus") == "O", F.array(goal("H", 0)))
        sinks.write_json_lines(o.select(F.array(F.struct(F.col("o_orderkey").cast("string").alias("id"), goals.alias("goals"))).alias("matches")), p)

    return feeds.registry_goals(feeds.read_registry(spark, once(spark, sf, "registry", write)))


def registry_path(spark, sf):
    """Matches with both teams, quirks, and a press threshold of their own, and what validation has found out about each."""
    def write(p):
        o, k = table(spark, sf, "orders"), F.col("o_orderkey")
        team = lambda name, step: F.struct(((F.col("o_custkey") + step) * 10).cast("string").alias("id"), F.concat(F.lit(name), F.col("o_custkey")).alias("name"))
        swap = F.when(k % 5 == 0, F.create_map(F.lit("keeper_swap"), F.lit("quirk"))).when(k % 5 == 1, F.create_map(F.lit("note"), F.lit("none")))
        match = F.struct(
            k.cast("string").alias("id"), team("Home ", 0).alias("home"), team("Away ", 1).alias("away"), swap.alias("quirks"),
            F.when(k % 3 == 0, F.round(k % 100 / 100.0, 2)).alias("press_threshold_override"),
        )
        sinks.write_json_lines(o.select(F.array(match).alias("matches")), f"{p}/registry")
        found = o.where(k % 7 != 0).select(k.cast("string").alias("id"), F.when(k % 2 == 0, F.lit("found")).alias("keeper_swap"), F.round(k % 50 / 100.0, 2).alias("threshold"))
        sinks.write_json_lines(found, f"{p}/found")

    return once(spark, sf, "dimensions", write)


@query("registry_matches", """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Home ' || o_custkey AS home, 'Away ' || o_custkey AS away,
 CASE WHEN o_orderkey % 5 = 0 THEN 'quirk' WHEN o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0 THEN 'found' END AS keeper_swap,
 CASE WHEN o_orderkey % 3 = 0 THEN round(o_orderkey % 100 / 100e0, 2) WHEN o_orderkey % 7 <> 0 THEN round(o_orderkey % 50 / 100e0, 2) END AS press_threshold FROM orders""")
def registry_matches(spark, sf):
    """Match dimension: a quirk or threshold set by hand counts before what was found out."""
    p = registry_path(spark, sf)
    found = spark.read.schema("id STRING, keeper_swap STRING, threshold DOUBLE").json(f"{p}/found")
    return feeds.registry_matches(feeds.read_registry(spark, f"{p}/registry"), found)


@query("registry_teams", """SELECT CAST(o_orderkey AS VARCHAR) AS id, a.side, CAST((o_custkey + CASE a.side WHEN 'home' THEN 0 ELSE 1 END) * 10 AS VARCHAR) AS team_id, CASE a.side WHEN 'home' THEN 'Home ' ELSE 'Away ' END || o_custkey AS name
FROM orders, (VALUES ('home'), ('away')) a(side) WHERE CASE o_orderkey % 4 WHEN 0 THEN a.side = 'home' WHEN 1 THEN a.side = 'away' WHEN 2 THEN a.side = 'away' ELSE false END""")
def registry_teams(spark, sf):
    """Teams looked up by side, by name and by id; an unknown mention finds none."""
    k = F.col("o_orderkey")
    said = F.when(k % 4 == 0, "home").when(k % 4 == 1, F.concat(F.lit("Away "), "o_custkey")).when(k % 4 == 2, ((F.col("o_custkey") + 1) * 10).cast("string")).otherwise("nobody")
    asked = table(spark, sf, "orders").select(k.cast("string").alias("id"), said.alias("mention"))
    teams = feeds.registry_teams(feeds.read_registry(spark, f"{registry_path(spark, sf)}/registry"))
    return feeds.resolve_teams(asked, teams).where(F.col("side").isNotNull()).select("id", "side", "team_id", "name")


@query("scan_reports_json", "SELECT n_name AS team, 'Report on ' || n_name AS headline, r_name AS \"group\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_reports_json(spark, sf):
    """Hand-written report texts as JSON arrays."""

    def write(p):
        sinks.write_json_arrays(table(spark, sf, "nation").select(F.col("n_name").alias("team"), F.concat(F.lit("Report on "), "n_name").alias("headline"), F.col("n_regionkey").alias("rk")), p)

    r = spark.read.schema("team STRING, headline STRING, rk INT").option("multiLine", True).json(once(spark, sf, "reports", write))
    return r.join(table(spark, sf, "region"), F.col("rk") == F.col("r_regionkey")).select("team", "headline", F.col("r_name").alias("group"))


@query("frame_clock_join", "SELECT match_id, CAST(floor(clock_us/300000000e0) AS BIGINT) AS bucket, round(avg(clock_us/1e6 - CASE period WHEN 1 THEN 0 WHEN 2 THEN 2700 WHEN 3 THEN 5400 ELSE 6300 END),6) AS mean_elapsed FROM stream_v GROUP BY 1, 2", "stream")
def frame_clock_join(spark, sf):
    """Events given their period clock by joining the frame-to-clock map on the frame key."""
    s = stream(spark, sf)
    clock = s.select("event_id", (F.col("clock_us") / 1e6 - F.element_at(feeds.code_map(feeds.CLOCK_START), F.col("period").cast("int"))).alias("elapsed"))
    j = s.select("event_id", "match_id", "clock_us").join(clock, "event_id")
    return j.groupBy("match_id", F.floor(F.col("clock_us") / 300000000.0).alias("bucket")).agg(r6(F.avg("elapsed")).alias("mean_elapsed"))


# ------------------------------------------------------------------ second provider

def sets_path(spark, sf):
    def write(p):
        m = moments(spark, sf)
        frame = F.transform(
            "players", lambda q: F.struct(
                (q["entity"] + 10000).cast("bigint").alias("_N"), F.date_format(F.timestamp_micros(F.lit(1672000000000000) + q["entity"].cast("bigint") * 40000), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("_T"),
                F.round(q["x"], 2).alias("_X"), F.round(q["y"], 2).alias("_Y"), F.round(F.abs(q["x"]) / 2, 2).alias("_S"),
            )
        )
        sinks.write_xml(
            m.select(F.when(F.col("label") < 5, "firstHalf").otherwise("secondHalf").alias("_GameSection"), F.concat(F.lit("T-"), F.col("poss").cast("string")).alias("_TeamId"), F.concat(F.lit("OBJ-"), F.conv(F.col("frame").cast("string"), 10, 36)).alias("_PersonId"), frame.alias("Frame")),
            p, "FrameSet", "Positions",
        )

    return once(spark, sf, "sets", write)


@query("xml_positions", "SELECT frame AS person, CASE WHEN label < 5 THEN 1 ELSE 2 END AS period, CAST(entity + 10000 AS BIGINT) AS n, round(x,2)+0e0 AS x, round(y,2)+0e0 AS y, round(round(abs(x)/2,2)/3.6e0,6) AS speed FROM positions_v WHERE entity < 22", "positions")
def xml_positions(spark, sf):
    p = feeds.read_position_sets(spark, sets_path(spark, sf))
    return p.select(feeds.short_id(F.col("person")).alias("person"), "period", "n", r6("x", 2).alias("x"), r6("y", 2).alias("y"), r6("speed").alias("speed"))


@query("xml_grid_check", "SELECT frame AS person, count(*) AS frames, true AS regular FROM positions_v WHERE entity < 22 GROUP BY frame", "positions")
def xml_grid_check(spark, sf):
    """Whether every person's frames lie on the regular 25 Hz grid."""
    g = feeds.grid_error(feeds.read_position_sets(spark, sets_path(spark, sf)))
    return g.select(feeds.short_id(F.col("person")).alias("person"), "frames", (F.col("max_error") < 1e-3).alias("regular"))


@query("xml_match_info", "SELECT c_custkey AS player_id, CAST(c_custkey % 99 AS VARCHAR) AS shirt, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'GK' WHEN 'AUTOMOBILE' THEN 'LCB' WHEN 'MACHINERY' THEN 'AM' ELSE 'CM' END AS position, c_acctbal > 0 AS started FROM customer")
def xml_match_info(spark, sf):
    """Team lists with nested players; squads are written in groups of at most fifty."""

    def write(p):
        c = table(spark, sf, "customer")
        code = F.when(F.col("c_mktsegment") == "BUILDING", "TW").when(F.col("c_mktsegment") == "AUTOMOBILE", "IVL").when(F.col("c_mktsegment") == "MACHINERY", "ZO").otherwise("XX")
        pl = F.struct(
            F.concat(F.lit("OBJ-"), F.conv(F.col("c_custkey").cast("string"), 10, 36)).alias("_PersonId"), (F.col("c_custkey") % 99).cast("string").alias("_ShirtNumber"), F.col("c_name").alias("_Shortname"),
            code.alias("_PlayingPosition"), F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("_Starting"),
        )
        t = c.groupBy(F.floor(F.col("c_custkey") / 50).alias("squad")).agg(F.collect_list(pl).alias("Player"))
        sinks.write_xml(t.select(F.lit("home").alias("_Role"), F.concat(F.lit("CLU-"), F.col("squad").cast("string")).alias("_TeamId"), "Player"), p, "Team", "Teams")

    return feeds.read_teams(spark, once(spark, sf, "teams", write)).select("player_id", "shirt", "name", "position", "started")


@query("xml_events", "SELECT CAST(event_id AS VARCHAR) AS event_id, CASE kind WHEN 'OTB' THEN 'BC' WHEN 'OUT' THEN 'CLAIM' ELSE kind END AS kind, CASE WHEN kind='CH' AND value <= 5 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS player, CASE WHEN kind='PA' THEN CASE WHEN value > 10 THEN 'C' ELSE 'D' END END AS outcome FROM stream_v", "stream")
def xml_events(spark, sf):
    def write(p):
        u = F.col("user_id").cast("string")
        on = lambda k, s: F.when(F.col("kind") == k, s)
        e = stream(spark, sf).select(
            F.date_format(F.timestamp_micros(F.col("clock_us")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("_EventTime"), F.col("event_id").cast("string").alias("_EventId"),
            on("SH", F.struct(u.alias("_Player"), F.lit(0.1).alias("_xG"))).alias("ShotAtGoal"),
            on("PA", F.struct(u.alias("_Player"), F.when(F.col("value") > 10, "successful").otherwise("failed").alias("_Evaluation"))).alias("Play"),
            on("OTB", F.struct(u.alias("_Player"))).alias("OtherBallAction"), on("OUT", F.struct(u.alias("_Player"))).alias("BallClaiming"),
            on("CH", F.struct(u.alias("_Winner"), F.when(F.col("value") > 5, "withoutBallControl").otherwise("withBallControl").alias("_WinnerRole"))).alias("TacklingGame"),
        )
        sinks.write_xml(e, p, "Event", "Events")

    return feeds.read_provider_events(spark, once(spark, sf, "xmlevents", write)).select("event_id", "kind", "player", "outcome")


@query("normalised_writer", "SELECT frame, CASE WHEN label < 5 THEN 1 ELSE 2 END AS period, count(*) AS players, round(avg(round(x,2)),6)+0e0 AS mean_x FROM positions_v WHERE entity < 22 GROUP BY frame, label", "positions")
def normalised_writer(spark, sf):
    """Provider XML rewritten as compressed tracking lines, and read back through the tracking reader."""

    def write(p):
        pos = feeds.read_position_sets(spark, sets_path(spark, sf))
        pl = F.struct(F.col("n").cast("string").alias("jerseyNum"), "x", "y", "speed")
        # a person's frames become one line here, so each list holds at most 22 entries
        d = pos.groupBy(feeds.short_id(F.col("person")).alias("frameNum"), "period").agg(F.collect_list(pl).alias("homePlayers"))
        sinks.write_json_lines(d, p)

    t = tracking.read_tracking(spark, once(spark, sf, "normalised", write))
    p = t.select(F.col("frameNum").alias("frame"), "period", F.explode("homePlayers").alias("p"))
    return p.groupBy("frame", "period").agg(F.count(F.lit(1)).alias("players"), r6(F.avg("p.x")).alias("mean_x"))


# ------------------------------------------------------------------ round trips

@query("io_parquet", "SELECT match_id, period, count(*) AS n, round(sum(value),4) AS total FROM stream_v WHERE match_id >= 6 GROUP BY 1, 2", "stream")
def io_parquet(spark, sf):
    """Feature table partitioned by match and period; the filter on match reads only its folders."""
    path = once(spark, sf, "features", lambda p: sinks.write_table(stream(spark, sf), p, "match_id", "period"))
    d = spark.read.parquet(path).where(F.col("match_id") >= 6)
    return d.groupBy(big("match_id").alias("match_id"), "period").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))


@query("io_csv", "SELECT event_id, kind, x, y FROM stream_v", "stream")
def io_csv(spark, sf):
    path = once(spark, sf, "csv", lambda p: stream(spark, sf).select("event_id", "kind", "x", "y").write.option("header", True).csv(p))
    return spark.read.schema("event_id BIGINT, kind STRING, x DOUBLE, y DOUBLE").option("header", True).csv(path)


@query("io_view_json", "SELECT match_id, 'team ' || team AS team, count(*) AS n, count(*) FILTER (kind='SH') AS shots FROM stream_v GROUP BY 1, 2", "stream")
def io_view_json(spark, sf):
    """View document keyed by team name: one JSON map per match, details stay in their own table."""

    def write(p):
        s = stream(spark, sf).groupBy("match_id", F.concat(F.lit("team "), F.col("team").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "SH").alias("shots"))
        doc = s.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("n", "shots").alias("v")))).alias("doc"))
        doc.select("match_id", F.to_json("doc").alias("doc")).write.json(p)

    d = spark.read.schema("match_id BIGINT, doc STRING").json(once(spark, sf, "views", write))
    m = d.select("match_id", F.explode(F.from_json("doc", "MAP<STRING, STRUCT<n:BIGINT, shots:BIGINT>>")).alias("team", "v"))
    return m.select("match_id", "team", "v.n", "v.shots")


@query("io_chapter_json", "SELECT frame, CAST(floor(frame/100e0) AS BIGINT) AS chapter, round(frame/29.97e0,2) AS t, CASE WHEN poss_team=0 THEN 'home' ELSE 'away' END AS possession, 22 AS players, 'H0' AS first_id, round(qx,2)+0e0 AS ball_x FROM ball_v", "positions")
def io_chapter_json(spark, sf):
    """Nested frames by chapter folder: rounded positions, side-coded ids, null-safe ball."""

    def write(p):
        m = moments(spark, sf)
        pl = F.transform(
            "players", lambda q: F.struct(F.concat(F.when(q["team"] == 0, "H").otherwise("A"), q["entity"].cast("string")).alias("id"), F.round(q["x"], 2).alias("x"), F.round(q["y"], 2).alias("y"))
        )
        d = m.select(
            "frame", F.floor(F.col("frame") / 100.0).alias("chapter"), F.round(F.col("frame") / 29.97, 2).alias("t"), F.when(F.col("poss") == 0, "home").otherwise("away").alias("possession"),
            pl.alias("players"), F.struct(F.round("ball_x", 2).alias("x"), F.round("ball_y", 2).alias("y")).alias("ball"),
        )
        d.write.partitionBy("chapter").option("maxRecordsPerFile", 20000).json(p)

    d = spark.read.schema("frame BIGINT, t DOUBLE, possession STRING, players ARRAY<STRUCT<id:STRING, x:DOUBLE, y:DOUBLE>>, ball STRUCT<x:DOUBLE, y:DOUBLE>, chapter BIGINT").json(once(spark, sf, "chapterjson", write))
    return d.select("frame", "chapter", "t", "possession", F.size("players").alias("players"), F.get("players", F.lit(0))["id"].alias("first_id"), (F.col("ball.x") + 0.0).alias("ball_x"))


@query("io_manifest", "SELECT match_id, period, 'old-' || match_id AS url, count(*) AS frames FROM stream_v GROUP BY 1, 2", "stream")
def io_manifest(spark, sf):
    """Chapter manifest that carries one field of the manifest published before."""
    fresh = stream(spark, sf).groupBy("match_id", "period").agg(F.count(F.lit(1)).alias("frames"))
    old = lambda p: stream(spark, sf).select("match_id", "period").distinct().withColumn("url", F.concat(F.lit("old-"), F.col("match_id").cast("string"))).write.json(p)
    prior = spark.read.schema("match_id BIGINT, period INT, url STRING").json(once(spark, sf, "manifest", old))
    return sinks.carry_manifest(fresh, prior, ["match_id", "period"], "url").select("match_id", "period", "url", "frames")


@query("io_raster", """hist AS (SELECT label, CAST(least(floor((x+52.5e0)/(105.0e0/52)),51) AS INTEGER) AS ix, CAST(least(floor((y+34e0)/(68.0e0/34)),33) AS INTEGER) AS iy, count(*) AS v FROM positions_v WHERE entity < 22 AND NOT is_gk GROUP BY ALL)
SELECT label, count(*) FILTER (v > 0) AS cells, CAST(sum(least(v,255)) AS BIGINT) AS total, CAST(2360 AS INTEGER) AS chars FROM hist GROUP BY label""", "positions")
def io_raster(spark, sf):
    """Byte grids as base64, one per key, decoded again after the round trip."""

    def write(p):
        h = label_histogram(spark, sf).select("label", "ix", "iy", F.least(F.col("v").cast("int"), F.lit(255)).alias("q"))
        R.encode(h, ["label"]).write.json(p)

    d = spark.read.schema("label INT, grid STRING").json(once(spark, sf, "raster", write))
    hexed = F.hex(F.unbase64("grid"))
    vals = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(hexed.substr(i, F.lit(2)), 16, 10).cast("bigint"))
    d = d.select("label", F.length("grid").alias("chars"), vals.alias("v"))
    return d.select("label", big(F.size(F.filter("v", lambda v: v > 0))).alias("cells"), F.aggregate("v", big(F.lit(0)), lambda a, v: a + v).alias("total"), "chars")


@query("io_only_missing", "SELECT match_id, CASE WHEN match_id < 4 THEN 'published' ELSE 'new' END AS src, count(*) AS n FROM stream_v GROUP BY 1, 2", "stream")
def io_only_missing(spark, sf):
    """Second run writes only the match partitions that are not there yet."""

    def write(p):
        s = stream(spark, sf).select("match_id", "event_id", "value")
        sinks.write_table(s.where(F.col("match_id") < 4).withColumn("src", F.lit("published")), p, "match_id")
        sinks.write_missing(s.withColumn("src", F.lit("new")), p, "match_id")

    d = spark.read.parquet(once(spark, sf, "missing", write))
    return d.groupBy(big("match_id").alias("match_id"), "src").agg(F.count(F.lit(1)).alias("n"))


@query("io_changed", "SELECT match_id, CASE WHEN match_id IN (3, 5) THEN 'second' ELSE 'first' END AS run, count(*) AS n, round(sum(CASE WHEN match_id IN (3, 5) THEN value + 1 ELSE value END), 6) AS total FROM stream_v WHERE match_id <> 7 GROUP BY 1, 2", "stream")
def io_changed(spark, sf):
    """A second run over inputs of which two matches changed and one is gone: the others' partitions stay as the first run left them."""

    def write(p):
        s = stream(spark, sf).select("match_id", "event_id", "value")
        changed = s.where(F.col("match_id") != 7).withColumn("value", F.when(F.col("match_id").isin(3, 5), F.col("value") + 1).otherwise(F.col("value")))
        for run, inputs in (("first", s), ("second", changed)):
            sinks.write_changed(inputs, lambda d, run=run: d.withColumn("run", F.lit(run)), p, "match_id")

    d = spark.read.parquet(once(spark, sf, "changed", write))
    return d.groupBy(big("match_id").alias("match_id"), "run").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


# ------------------------------------------------------------------ one path from files to views

@per_session
def feed_from_files(spark, sf):
    """The stream written as match files, teams changing ends, read back and stored once for all views."""
    def write(p):
        s = stream(spark, sf).groupBy("match_id").count()
        left = F.col("match_id") % 2 == 0
        match_files.write_feed(feed(spark, sf), s.select("match_id", left.alias("homeTeamStartLeft"), (~left).alias("startLeftExtra")), f"{p}/events", f"{p}/metadata")

    p = once(spark, sf, "match", write)
    return match_files.read_feed(spark, f"{p}/events", f"{p}/metadata").kept()


@query("files_presses", f"{PRESS_SQL} SELECT match_id, team, start, \"end\", presser, round(x,6)+0e0 AS x, round(y,6)+0e0 AS y, won, trigger FROM pf", "stream")
def files_presses(spark, sf):
    d = views.presses(feed_from_files(spark, sf))
    return d.withColumn("x", r6("x")).withColumn("y", r6("y"))


@query("files_turnovers", f"{TURN_SQL} SELECT match_id, team, start, period, round(x,6)+0e0 AS x, round(y,6)+0e0 AS y, fast, shot FROM tn", "stream")
def files_turnovers(spark, sf):
    d = views.turnovers(feed_from_files(spark, sf))
    return d.withColumn("x", r6("x")).withColumn("y", r6("y"))


@query("files_chances", f"{CHANCE_SQL} SELECT match_id, event_id, team, start, kind, third, passes FROM ct", "stream")
def files_chances(spark, sf):
    return views.chances(feed_from_files(spark, sf)).select("match_id", "event_id", "team", "start", "kind", "third", "passes")


@query("files_settling", f"{SETTLE_SQL} SELECT match_id, loss_id, dteam, CAST(dur_us AS BIGINT) AS dur_us, settled FROM dur", "stream")
def files_settling(spark, sf):
    return views.settling(feed_from_files(spark, sf)).select("match_id", "loss_id", "dteam", "dur_us", "settled")


@query("files_board", f"{BOARD_SQL} SELECT * FROM board", "stream")
def files_board(spark, sf):
    """The board of every match, from event arrays and metadata on disk."""
    return views.board(feed_from_files(spark, sf))
