"""Views over feeds, and feeds read from match files."""

import json

import pytest

from touchline.operators import feed as views
from touchline.operators.feed import COLUMNS, Feed
from touchline.sources.match_files import read_feed, write_feed

KIND = "match_id long, event_id long, user_id long, team int, kind string, period int, clock_us long, end_us long, x double, y double, pressed boolean"
S = 1_000_000


def event(game, eid, start, team, period=1, kind=None, x=10.0, y=1.0, **more):
    e = {
        "gameId": game, "gameEventId": eid, "startTime": start, "endTime": None if start is None else start + 1,
        "gameEvents": {"gameEventType": "OTB", "period": period, "teamId": team, "playerId": 7},
        "possessionEvents": kind and {"possessionEventType": kind}, "ball": [{"x": x, "y": y, "z": 0.0}, {"x": 99.0, "y": 99.0, "z": 0.0}],
    }
    e.update(more)
    return e


def test_read_feed_cases(spark, tmp_path):
    rows = [
        event(1, 1, 2.5, 100, kind="PA", initialTouch={"initialPressureType": "P"}),
        event(1, 2, 2700.0, 200, period=2, kind="XX"),                       # an unknown code is a touch, ends are changed
        event(1, 3, 3.0, None),                                              # no side: left out
        event(1, 4, None, 100),                                              # no clock: left out
        event(1, 5, 4.0, 100, gameEvents={"gameEventType": "OUT", "period": 1, "homeTeam": False, "teamId": 100}, ball=[], endTime=None, duration=0.5),
        event(2, 6, 1.0, 5, gameEvents={"gameEventType": "OTB", "period": 1, "homeTeam": True}, endTime=None),  # no metadata
    ]
    (tmp_path / "e").mkdir()
    (tmp_path / "m").mkdir()
    (tmp_path / "e" / "1.json").write_text(json.dumps(rows))
    line = json.dumps({"id": "1", "homeTeam": {"id": "100"}, "awayTeam": {"id": "200"}, "homeTeamStartLeft": False})
    (tmp_path / "m" / "1.json").write_text(line + "\n" + line + "\n")
    got = {r.event_id: r for r in read_feed(spark, f"{tmp_path}/e", f"{tmp_path}/m").rows.collect()}
    assert set(got) == {1, 2, 5, 6}
    assert (got[1].team, got[1].kind, got[1].pressed, got[1].clock_us, got[1].end_us, got[1].x, got[1].y) == (0, "PA", True, 2500000, 3500000, -10.0, -1.0)
    assert (got[2].team, got[2].kind, got[2].pressed, got[2].x) == (1, "OTB", False, 10.0)
    assert (got[5].team, got[5].kind, got[5].end_us, got[5].x, got[5].user_id) == (1, "OUT", 4500000, None, None)
    assert (got[6].team, got[6].x, got[6].end_us) == (0, 10.0, 1000000)


def made(spark):
    rows = []
    for m in (1, 2, 3):
        for i in range(60):
            team = (i // (4 + m)) % 2
            kind = "SH" if i % 17 == 16 else "PA" if i % 3 == 1 else "OTB"
            t = i * 2 * S
            rows.append((m, m * 100 + i, i % 5, team, kind, 1 if i < 30 else 2, t, t + S, float((i * 7 * m) % 90 - 45), float(i % 60 - 30), i % 6 in (2, 3)))
    return spark.createDataFrame(rows, KIND)


def test_files_round_trip_keeps_every_column(spark, tmp_path):
    f = Feed(made(spark))
    sides = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, None)], "match_id long, homeTeamStartLeft boolean, startLeftExtra boolean")
    write_feed(f, sides, f"{tmp_path}/e", f"{tmp_path}/m")
    back = read_feed(spark, f"{tmp_path}/e", f"{tmp_path}/m")
    assert sorted(map(tuple, back.rows.select(*COLUMNS).collect())) == sorted(map(tuple, f.rows.select(*COLUMNS).collect()))


@pytest.mark.parametrize("view", [views.presses, views.turnovers, views.chances, views.settling])
def test_a_match_alone_gives_its_rows_of_all(spark, view):
    f = Feed(made(spark)).kept()
    every = view(f)
    alone = view(f.only(2))
    rows = sorted(map(str, every.where("match_id = 2").collect()))
    assert rows and rows == sorted(map(str, alone.collect()))


def test_thresholds_are_parameters(spark):
    f = Feed(made(spark))
    few, many = views.presses(f, minimum=60 * S).count(), views.presses(f, merge=0, minimum=0).count()
    assert few == 0 < many


def test_feed_names_what_it_lacks_and_takes_no_rows(spark):
    with pytest.raises(ValueError, match="pressed"):
        Feed(made(spark).drop("pressed"))
    none = Feed(made(spark).limit(0))
    assert views.board(none).count() == views.presses(none).count() == views.chances(none).count() == 0


def test_press_spells_by_hand(spark):
    from touchline.plans.frames import press_spells

    #         frames of one press: 0-3, joined with 6-9 (a gap of 3), too short at 20-21, and a second side's 0-9
    scores = {0: .5, 1: .9, 2: .9, 3: .4, 4: .39, 5: 0., 6: .6, 9: .5, 13: .1, 20: .8, 21: .8, 30: None}
    rows = [(1, 0, f, s, f % 11) for f, s in scores.items()] + [(1, 1, f, .5, 3) for f in range(10)] + [(2, 0, 5, .1, 1)]
    d = spark.createDataFrame(rows, "m int, team int, frame long, score double, presser int")
    got = press_spells(d, "m", 0.4, 4, 5).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 9, .9, 1, 1), (1, 1, 0, 9, .5, 3, 0)]


def test_registry_dimensions(spark):
    from touchline.schema import REGISTRY
    from touchline.sources import feeds

    docs = [json.dumps({"matches": [
        {"id": "1", "home": {"id": "10", "name": "A"}, "away": {"id": "11", "name": "A"}, "quirks": {"keeper_swap": {"periods": [1]}}, "press_threshold_override": 0.0},
        {"id": "2", "home": {"id": "home", "name": None}, "away": {"id": "12", "name": "home"}, "quirks": {"keeper_swap": ""}},
        {"id": "3"},
    ]})]
    from pyspark.sql import functions as F
    reg = spark.createDataFrame([(d,) for d in docs], "value string").select(F.from_json("value", REGISTRY).alias("j")).select(F.explode("j.matches").alias("m")).select("m.*")
    found = spark.createDataFrame([("1", "x", 0.5), ("2", "y", 0.6)], "id string, keeper_swap string, threshold double")
    rows = {r.id: r for r in feeds.registry_matches(reg, found).collect()}
    assert (rows["1"].keeper_swap, rows["1"].press_threshold) == ('{"periods":[1]}', 0.0)
    assert (rows["2"].keeper_swap, rows["2"].press_threshold, rows["3"].press_threshold, rows["3"].home) == ("y", 0.6, None, None)
    asked = spark.createDataFrame([("1", "A"), ("1", "11"), ("2", "home"), ("2", "12"), ("2", "away"), ("3", "away"), ("9", "A"), (None, None)], "id string, mention string")
    got = {(r.id, r.mention): r.side for r in feeds.resolve_teams(asked, feeds.registry_teams(reg)).collect()}
    assert got == {("1", "A"): "home", ("1", "11"): "away", ("2", "home"): "home", ("2", "12"): "away", ("2", "away"): "away", ("3", "away"): "away", ("9", "A"): None, (None, None): None}


def test_embedded_events_by_hand(spark, tmp_path):
    from touchline.sources import tracking

    lines = [
        {"frameNum": 1, "period": None, "game_event_id": 5.0, "game_event": {"game_event_type": "OTB"}},       # no period: not yet
        {"frameNum": 2, "period": 1, "game_event_id": 5.0, "game_event": {"game_event_type": "OTB", "team_id": "31.0", "shirt_number": "9"}},
        {"frameNum": 3, "period": 2, "game_event_id": 5.0, "game_event": {"game_event_type": "OUT"}},          # mentioned before
        {"frameNum": 4, "period": 1, "game_event_id": 6.0, "game_event": None},                               # no event
        {"frameNum": 5, "period": 1, "possession_event_id": 8.0, "possession_event": {"possession_event_type": "PA", "game_event_id": 5}},
        {"frameNum": 6, "period": 1, "possession_event_id": 9.0, "possession_event": {"possession_event_type": "SH", "start_frame": 4}},
    ]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    t = tracking.read_tracking(spark, str(tmp_path / "t.json"))
    g = tracking.game_events(t).collect()
    assert [(r.id, r.kind, r.team_id, r.shirt, r.player, r.period) for r in g] == [(5, "OTB", "31", "9", None, 1)]
    assert sorted(map(tuple, tracking.possession_events(t).collect())) == [(8, "PA", 5, 5), (9, "SH", None, 4)]
