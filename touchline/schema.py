"""Explicit schemas of the files the readers expect; nothing is inferred."""

# Field names of the input files.
PLAYER = "ARRAY<STRUCT<jerseyNum:STRING, x:DOUBLE, y:DOUBLE, speed:DOUBLE, confidence:STRING, visibility:STRING>>"
SMOOTHED = "ARRAY<STRUCT<jerseyNum:STRING, x:DOUBLE, y:DOUBLE, confidence:STRING, visibility:STRING>>"
BALL = "STRUCT<x:DOUBLE, y:DOUBLE, z:DOUBLE, visibility:STRING>"
GAME_EVENT = (
    "STRUCT<game_event_type:STRING, team_id:STRING, player_id:STRING, player_name:STRING, shirt_number:STRING, "
    "position_group_type:STRING, home_ball:BOOLEAN, start_time:DOUBLE, end_time:DOUBLE, start_frame:BIGINT, end_frame:BIGINT>"
)
POSSESSION_EVENT = "STRUCT<possession_event_type:STRING, game_event_id:BIGINT, start_time:DOUBLE, start_frame:BIGINT>"
TRACKING = (
    "frameNum BIGINT, period INT, periodElapsedTime DOUBLE, periodGameClockTime DOUBLE, videoTimeMs DOUBLE, "
    f"homePlayers {PLAYER}, awayPlayers {PLAYER}, homePlayersSmoothed {SMOOTHED}, awayPlayersSmoothed {SMOOTHED}, "
    f"balls ARRAY<{BALL}>, ballsSmoothed STRING, game_event_id DOUBLE, possession_event_id DOUBLE, "
    f"game_event {GAME_EVENT}, possession_event {POSSESSION_EVENT}"
)
EVENTS = (
    "gameId BIGINT, gameEventId BIGINT, possessionEventId BIGINT, startTime DOUBLE, endTime DOUBLE, eventTime DOUBLE, duration DOUBLE, "
    "gameEvents STRUCT<gameEventType:STRING, period:INT, teamId:BIGINT, teamName:STRING, homeTeam:BOOLEAN, playerId:BIGINT, playerName:STRING, setpieceType:STRING>, "
    "initialTouch STRUCT<initialPressureType:STRING>, "
    "possessionEvents STRUCT<possessionEventType:STRING, passOutcomeType:STRING, shotOutcomeType:STRING, shooterPlayerName:STRING, challengerPlayerId:BIGINT, clearerPlayerId:BIGINT>, "
    "ball ARRAY<STRUCT<x:DOUBLE, y:DOUBLE, z:DOUBLE>>"
)
ROSTER = (
    "player STRUCT<id:STRING, nickname:STRING>, positionGroupType:STRING, shirtNumber STRING, started BOOLEAN, team STRUCT<id:STRING, name:STRING>"
).replace("positionGroupType:STRING", "positionGroupType STRING")
METADATA = (
    "id STRING, homeTeam STRUCT<id:STRING, name:STRING, shortName:STRING>, awayTeam STRUCT<id:STRING, name:STRING, shortName:STRING>, fps DOUBLE, "
    "homeTeamStartLeft BOOLEAN, homeTeamStartLeftExtraTime BOOLEAN, stadium STRUCT<pitches:ARRAY<STRUCT<length:DOUBLE, width:DOUBLE>>>"
)
REGISTRY = (
    "matches ARRAY<STRUCT<id:STRING, slug:STRING, provider:STRING, title:STRING, competition:STRING, home:STRUCT<id:STRING, name:STRING>, "
    "away:STRUCT<id:STRING, name:STRING>, goals:ARRAY<ARRAY<STRING>>, quirks:MAP<STRING,STRING>, press_threshold_override:DOUBLE>>"
)
FRAME_SET = "_GameSection STRING, _TeamId STRING, _PersonId STRING, Frame ARRAY<STRUCT<_N:BIGINT, _T:STRING, _X:DOUBLE, _Y:DOUBLE, _Z:DOUBLE, _S:DOUBLE, _BallStatus:INT>>"
TEAM = "_Role STRING, _TeamId STRING, _TeamName STRING, Player ARRAY<STRUCT<_PersonId:STRING, _ShirtNumber:STRING, _Shortname:STRING, _PlayingPosition:STRING, _Starting:STRING>>"
PROVIDER_EVENT = (
    "_EventTime STRING, _EventId STRING, ShotAtGoal STRUCT<_Player:STRING, _xG:DOUBLE>, Play STRUCT<_Player:STRING, _Evaluation:STRING, _Recipient:STRING>, "
    "OtherBallAction STRUCT<_Player:STRING>, BallClaiming STRUCT<_Player:STRING>, TacklingGame STRUCT<_Winner:STRING, _WinnerRole:STRING, _Loser:STRING, _LoserRole:STRING>"
)
