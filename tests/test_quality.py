"""Every rule of the match checks on a hand-made match each."""

from touchline.operators.quality import match_faults

MATCH = "match_id int, home_id int, away_id int, meta_home_id int, length double, width double"
PLAYER = "match_id int, team_id int, player int, started boolean, position string"
SIDES = "match_id int, period int, by_meta int, by_shots int, by_keepers int"


def squad(match, team, starters=11, keeper=True):
    return [(match, team, k, k < starters, "GK" if k == 0 and keeper else None) for k in range(15)]


def test_each_rule_fires_alone(spark):
    matches = [(1, 10, 11, 10, 105.0, 68.0), (2, 10, 11, 11, 105.5, 67.5), (3, 10, 11, None, None, 68.0), (4, 10, 11, 10, 100.0, 68.0), (5, 10, 11, 10, 105.0, 68.0)]
    roster = [row for m in (1, 2, 3, 4) for t in (10, 11) for row in squad(m, t)]
    roster += [*squad(1, 10), *squad(9, 10), *squad(1, 99)]  # listed twice; unknown match; unknown team
    roster += squad(5, 10, starters=10, keeper=False)
    sides = [(1, 1, 1, 1, 1), (1, 2, None, None, -1), (2, 1, None, None, None), (3, 1, 1, -1, -1), (4, 1, None, 1, -1), (4, 2, 1, None, -1)]
    got = sorted(map(tuple, match_faults(spark.createDataFrame(matches, MATCH), spark.createDataFrame(roster, PLAYER), spark.createDataFrame(sides, SIDES)).collect()))
    assert got == sorted([
        (2, "match", "home team of the metadata differs", "problem"),
        (2, "1", "no direction of play", "problem"),
        (3, "match", "home team of the metadata differs", "problem"),
        (3, "match", "pitch size missing", "warning"),
        (3, "1", "start sides disagree with shots", "warning"),
        (4, "match", "pitch of other size", "warning"),
        (4, "1", "keepers at the other goal", "warning"),
        (5, "home", "no keeper in the roster", "problem"),
        (5, "home", "not eleven starters", "warning"),
        (5, "away", "no roster", "problem"),
        (5, "away", "no keeper in the roster", "problem"),
        (5, "away", "not eleven starters", "warning"),
    ])


def test_empty_tables_have_no_faults(spark):
    assert match_faults(*[spark.createDataFrame([], s) for s in (MATCH, PLAYER, SIDES)]).count() == 0
