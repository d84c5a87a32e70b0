"""The state study against plain loops."""

import random
import statistics

import numpy as np
import pytest

from touchline.operators import states

KEYS = ["m", "team", "state", "bin"]
KIND = "m int, team int, state string, bin int, clock double, live boolean, defending boolean, has_ball boolean, line double, length double, width double, holes int, free int, structure string"


def made(n=1500):
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        state, on = rng.choice(["level", "leading", "trailing"]), rng.random() < .6
        rows.append((
            rng.randrange(2), rng.randrange(2), state, rng.randrange(3), rng.uniform(0, 90), on or rng.random() < .5, on, not on, rng.gauss(30, 8) + 5 * (state == "trailing"),
            rng.gauss(30, 5), rng.choice([None, 40.0, 44.0]), rng.choice([None, 1, 5]), rng.randrange(3), rng.choice([*states.ORGANISED, "Defensive Transition", None]),
        ))
    return rows


@pytest.fixture(scope="module")
def binned(spark):
    presses = spark.createDataFrame([r[:4] for r in made()[::50]], "m int, team int, state string, bin int")
    return states.bins(spark.createDataFrame(made(), KIND), presses, KEYS)


def test_bins_equal_loops(binned):
    groups, pressed = {}, {}
    for r in made():
        if r[5] or r[6]:
            groups.setdefault(r[:4], []).append(r)
    for r in made()[::50]:
        pressed[r[:4]] = pressed.get(r[:4], 0) + 1
    got = {tuple(r[k] for k in KEYS): r for r in binned.collect()}
    assert set(got) == set(groups)
    for k, rows in groups.items():
        own, live, g = [r for r in rows if r[6]], [r for r in rows if r[5]], got[k]
        org = [r for r in own if r[13] in states.ORGANISED]
        assert (g.n_def, g.n_live, g.n_org, g.presses) == (len(own), len(live), len(org), pressed.get(k, 0))
        for name, at in (("line", 8), ("length", 9), ("width", 10)):
            assert getattr(g, name) == pytest.approx(statistics.median([r[at] for r in own if r[at] is not None]))
        assert g.holes == pytest.approx(statistics.mean([r[11] for r in own if r[11] is not None]))
        assert g.high == pytest.approx(100 * sum(r[13] == "High Press" for r in org) / len(org))
        assert g.possession == pytest.approx(100 * sum(r[7] for r in live) / len(live))
        assert g.clock == pytest.approx(statistics.mean([r[4] for r in own]))
        assert g.press_rate == pytest.approx(g.presses / (len(own) * .2 / 60))


def test_effects_equal_least_squares_with_dummies(binned):
    rows = binned.collect()
    got = {(r.measure, r.state): (r.effect, r.teams) for r in states.effects(binned, ["m", "team"], min_bin_s=1, min_state_min=.05).collect()}
    assert len(got) == 2 * len(states.MEASURES)
    for m in states.MEASURES:
        for versus in ("leading", "trailing"):
            use = [r for r in rows if r.state in ("level", versus) and r[m] is not None and r[states.WEIGHTS.get(m, "n_def")] * .2 >= 1]
            teams = sorted({(r.m, r.team) for r in use})
            root = np.sqrt([r[states.WEIGHTS.get(m, "n_def")] for r in use])
            a = np.array([[r.state == versus] + [(r.m, r.team) == t for t in teams] for r in use], float)
            want = np.linalg.lstsq(a * root[:, None], np.array([r[m] for r in use]) * root, rcond=None)[0][0]
            assert got[m, versus] == (pytest.approx(want), len(teams))


def test_too_few_teams_or_minutes_give_no_effect(binned):
    assert states.effects(binned.where("m = 0"), ["m", "team"], min_bin_s=1, min_state_min=.05).count() == 0
    assert states.effects(binned, ["m", "team"], min_bin_s=1, min_state_min=60).count() == 0
    assert states.effects(binned.limit(0), ["m", "team"]).count() == 0


def test_bins_read_the_samples_twice(spark):
    """Once for the counts, once for the values of the medians; their measuring used to read them a third time."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    samples = spark.createDataFrame(made(300), KIND).mapInPandas(count, KIND)
    assert states.bins(samples, spark.createDataFrame([r[:4] for r in made(300)[::50]], "m int, team int, state string, bin int"), KEYS).count() > 0
    assert seen.value == 2 * 300
