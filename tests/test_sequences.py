"""Sequential helpers against direct definitions."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import sequences as Q
from touchline.operators import smoothing as K
from touchline.operators.assignment import TrackSet, assign, assign_many, track_numbers
from touchline.operators.timeline import Timeline


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 2), (4, 6), (6, 6)]:
        c = rng.random((n, m))
        got = assign(c)
        assert len(got) == min(n, m) and len({a for a, _ in got}) == len({b for _, b in got}) == min(n, m)
        if n <= m:
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(c[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert sum(c[a, b] for a, b in got) == pytest.approx(best)


def test_assignments_of_a_stack_are_those_of_each():
    rng = np.random.default_rng(1)
    for n, m in [(1, 1), (3, 3), (2, 5), (5, 6)]:
        stack = np.round(rng.random((40, n, m)), 1)  # with ties
        for cost, columns in zip(stack, assign_many(stack)):
            assert len(set(columns)) == n
            assert cost[np.arange(n), columns].sum() == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)))


@pytest.mark.parametrize("start", [-5000, 0, 700_000])
def test_rate_limit_over_many_levels(spark, start):
    """Slices composed by threes, with empty stretches and times before zero."""
    rng = random.Random(start)
    rows = sorted({(rng.randint(0, 1), start + rng.choice([0, 9000]) + rng.randint(0, 3000)) for _ in range(400)})
    got = {tuple(r) for r in Q.rate_limit(spark.createDataFrame(rows, "k int, t long"), ["k"], "t", 5, fan_in=3).collect()}
    want, last = set(), {}
    for k, t in rows:
        if k not in last or t - last[k] >= 5:
            last[k] = t
            want.add((k, t))
    assert got == want


def matrix_smoother(t, z, q, r, gate):
    """The same model with full 4-state matrices."""
    H = np.eye(2, 4)
    x, P = np.array([*z[0], 0, 0]), np.diag([r * r, r * r, 25.0, 25.0])
    xs, Ps, xp, Pp, Fs = [x], [P], [x], [P], [None]
    for k in range(1, len(t)):
        h = max(t[k] - t[k - 1], 1e-3)
        A = np.eye(4)
        A[0, 2] = A[1, 3] = h
        G = np.array([[h * h / 2, 0], [0, h * h / 2], [h, 0], [0, h]])
        x, P = A @ x, A @ P @ A.T + q * q * G @ G.T
        xp.append(x), Pp.append(P), Fs.append(A)
        S = H @ P @ H.T + r * r * np.eye(2)
        e = z[k] - H @ x
        if e @ np.linalg.solve(S, e) <= gate * gate:
            K = P @ H.T @ np.linalg.inv(S)
            x, P = x + K @ e, P - K @ H @ P
        xs.append(x), Ps.append(P)
    out = [xs[-1]]
    for k in range(len(t) - 2, -1, -1):
        C = Ps[k] @ Fs[k + 1].T @ np.linalg.inv(Pp[k + 1])
        out.append(xs[k] + C @ (out[-1] - xp[k + 1]))
    return np.array(out[::-1])[:, :2]


def test_smoother_equals_matrix_form_and_gates_a_spike():
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.choice([1, 1, 1, 4], 300)) / Q.FPS
    true = np.c_[20 * np.sin(0.3 * t), 15 * np.cos(0.2 * t)]  # accelerations a player can reach
    z = true + rng.normal(0, 0.3, true.shape)
    z[150] += 30
    got = K.smooth_path(t, z, *K.PLAYER_NOISE)
    assert np.allclose(got, matrix_smoother(t, z, *K.PLAYER_NOISE, K.GATE_SIGMA), atol=1e-8)
    assert np.hypot(*(got[150] - true[150])) < 1.5
    assert np.abs(np.diff(got, 2, axis=0)).mean() < np.abs(np.diff(z, 2, axis=0)).mean() / 3


@pytest.mark.parametrize("cuts", [(), (3.0, 6.0, 9.0)])
def test_spikes_are_removed_singly_and_in_rounds(spark, cuts):
    tl = Timeline(("k",), "i", (), cuts)

    def kept(xs):
        rows = spark.createDataFrame([(1, i, i / 10.0, float(x), 0.0) for i, x in enumerate(xs)], "k int, i long, t double, x double, y double")
        return sorted(r.i for r in Q.without_spikes(rows, tl, 10.5).collect())

    xs = [i * 0.2 for i in range(12)]
    xs[5] += 40
    assert kept(xs) == [i for i in range(12) if i != 5]
    assert kept([i * 10 for i in range(12)]) == list(range(12))  # steady fast motion stays


def test_rounds_of_spikes_share_one_sort(spark):
    d = spark.createDataFrame([(0, i, i, float(i), 0.0) for i in range(5)], "k int, event_id long, c long, x double, y double").withColumn("t", F.col("c") * 1.0)
    left = Q.without_spikes(d, Timeline(("k",), "c", ("event_id",)), 0.5, 3)
    assert left._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


def test_savgol_matches_polynomial_fits():
    v = np.random.default_rng(2).normal(size=30)
    got = Q.savgol7(v)
    for i in range(30):
        c = min(max(i, 3), 26)
        u = np.arange(c - 3, c + 4)
        assert got[i] == pytest.approx(np.polyval(np.polyfit(u - c, v[u], 2), i - c))
    assert Q.savgol7(v[:5]).tolist() == v[:5].tolist()


@pytest.mark.parametrize("piece", [10, 200_000])
def test_savgol_tracks_equal_the_fits_and_settle_ties(spark, piece):
    rng = random.Random(4)
    rows = [(k, 100 * k + i, i * 1_000_000 + rng.randrange(900_000), rng.uniform(-50, 50), rng.uniform(-30, 30)) for k, n in enumerate((1, 2, 3, 6, 7, 8, 35)) for i in range(n)]
    d = spark.createDataFrame(rows, "k int, event_id long, c long, x double, y double").withColumn("t", F.col("c") / 1e6)
    got = {r.event_id: r for r in Q.savgol_tracks(d, ["k"], Timeline(("k",), "c", ("event_id",)), 10.0, piece).collect()}
    assert len(got) == len(rows)
    for k in range(7):
        mine = [r for r in rows if r[0] == k]
        t, sx = np.array([r[2] / 1e6 for r in mine]), Q.savgol7(np.array([r[3] for r in mine]))
        v = np.clip(np.gradient(sx, t), -10, 10) if len(mine) > 2 else np.zeros(len(mine))
        assert [got[r[1]].sx for r in mine] == pytest.approx(sx.tolist()) and [got[r[1]].vx for r in mine] == pytest.approx(v.tolist())
    same = spark.createDataFrame([(0, i, c, x, 0.0) for i, (c, x) in enumerate([(0, 0.0), (5, 1.0), (5, 3.0), (9, 3.0)])], "k int, event_id long, c long, x double, y double")
    got = {r.event_id: (r.vx, r.vy) for r in Q.savgol_tracks(same.withColumn("t", F.col("c") * 1.0), ["k"], Timeline(("k",), "c", ("event_id",)), 10.0).collect()}
    assert got[1] == (10.0, 10.0) and got[0] == (pytest.approx(0.2), 0.0)


def test_rate_limit_matches_greedy_loop(spark):
    rnd = random.Random(5)
    data = [(k, t) for k in "ab" for t in sorted(rnd.sample(range(20000), 600 if k == "a" else 40))]
    d = spark.createDataFrame(data, "k string, t bigint")
    got = {tuple(r) for r in Q.rate_limit(d, ["k"], "t", 37).collect()}
    want, last = set(), {}
    for k, t in data:
        if k not in last or t - last[k] >= 37:
            want.add((k, t))
            last[k] = t
    assert got == want


def test_trajectories_in_pieces_equal_whole(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": 1, "event_id": np.arange(3000), "t": np.arange(3000) / 10.0, "ti": np.arange(3000), "x": rng.normal(size=3000).cumsum(), "y": rng.normal(size=3000)})
    d = spark.createDataFrame(pdf)

    def body(p):
        return pd.DataFrame({"event_id": p["event_id"].to_numpy(), "sx": Q.savgol7(p["x"].to_numpy())})

    whole = Q.per_trajectory(d, ["k"], body, "event_id bigint, sx double").toPandas().set_index("event_id")["sx"].sort_index()
    tl = Timeline(("k",), "ti", (), (700.0, 1900.0))
    cut = Q.per_trajectory(d, ["k"], body, "event_id bigint, sx double", tl, halo=8, piece=500).toPandas().set_index("event_id")["sx"].sort_index()
    assert len(cut) == 3000 and np.allclose(whole, cut, atol=1e-12)


def plain_smoother(t, z, process, measure, gate):
    """Sample by sample, in the textbook's order, one axis pair at a time."""
    q, r = process**2, measure**2
    m, p = np.array([z[0], [0.0, 0.0]]), np.diag([r, K.FREE_VELOCITY])
    seen, guess = [(m, p)], []
    for h, at in zip(np.maximum(np.diff(t), K.SHORTEST), z[1:]):
        f = np.array([[1, h], [0, 1]])
        m, p = f @ m, f @ p @ f.T + q * np.array([[h**4 / 4, h**3 / 2], [h**3 / 2, h * h]])
        guess.append((f, m, p))
        if ((at - m[0]) ** 2).sum() / (p[0, 0] + r) <= gate**2:
            gain = p[:, :1] / (p[0, 0] + r)
            m, p = m + gain * (at - m[0]), p - gain @ p[:1]
        seen.append((m, p))
    out = [seen[-1][0]]
    for (m, p), (f, ahead, spread) in zip(seen[-2::-1], guess[::-1]):
        out.append(m + p @ f.T @ np.linalg.inv(spread) @ (out[-1] - ahead))
    return np.array(out[::-1])[:, 0]


def rough_path(n, seed):
    """A walk with gaps, equal times, single spikes and leaps that last, so that gates depend on gates."""
    rng = np.random.default_rng(seed)
    ticks = np.cumsum(rng.choice([0, 1, 1, 1, 9], n))
    z = rng.normal(0, 0.4, (n, 2)).cumsum(0)
    z[rng.random(n) < 0.05] += 25
    z[n // 2 :] += 60
    return ticks, z


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1001])
def test_composed_smoother_equals_the_plain_recursion(n, monkeypatch):
    for seed, noise in [(0, K.BALL_NOISE), (1, K.PLAYER_NOISE)]:
        ticks, z = rough_path(n, seed)
        want = plain_smoother(ticks / 10.0, z, *noise, K.GATE_SIGMA)
        assert np.abs(K.smooth_path(ticks / 10.0, z, *noise) - want).max() < 1e-10
        monkeypatch.setattr(K, "BLOCK", 13)  # gates settled in small blocks
        assert np.abs(K.smooth_path(ticks / 10.0, z, *noise) - want).max() < 1e-10
        monkeypatch.undo()
    assert K.smooth_path(np.zeros(0), np.zeros((0, 2)), *K.BALL_NOISE).shape == (0, 2)


@pytest.mark.parametrize("piece, cuts", [(10, ()), (10, (40.0, 90.0)), (97, ()), (5000, ())])
def test_smoother_in_pieces_equals_the_plain_recursion(spark, piece, cuts):
    frames, want = [], {}
    for k, n in [("long", 230), ("short", 12), ("one", 1), (None, 25)]:
        ticks, z = rough_path(n, n)
        first = len(want)
        want.update(zip(range(first, first + n), plain_smoother(ticks / 10.0, z, *K.BALL_NOISE, K.GATE_SIGMA)))
        frames += [(k, first + i, int(ti), float(ti) / 10.0, float(x), float(y)) for i, (ti, (x, y)) in enumerate(zip(ticks, z))]
    frames += [("long", 9001, 3, 0.3, None, 1.0), ("long", 9002, 3, 0.3, 1.0, float("nan")), ("gone", 9003, 3, None, 1.0, 1.0)]
    random.Random(0).shuffle(frames)
    d = spark.createDataFrame(frames, "k string, event_id long, ti long, t double, x double, y double")
    got = {r.event_id: (r.sx, r.sy) for r in K.smoothed(d, ["k"], Timeline(("k",), "ti", ("event_id",), cuts), *K.BALL_NOISE, piece=piece).collect()}
    assert got.keys() == want.keys()
    assert max(np.abs(np.subtract(got[e], want[e])).max() for e in want) < 1e-10
    assert K.smoothed(d.where("false"), ["k"], Timeline(("k",), "ti", ("event_id",)), *K.BALL_NOISE, piece=piece).count() == 0


@pytest.mark.parametrize("abreast", [0, 5, 300])
def test_trajectories_side_by_side_equal_the_plain_recursion(abreast, monkeypatch):
    monkeypatch.setattr(K, "ABREAST", abreast)
    lengths = [3, 1, 90, 5, 1, 6, 5, 2]
    paths = [rough_path(n, n + 50) for n in lengths]
    step = [np.maximum(np.diff(ticks / 10.0), K.SHORTEST) for ticks, _ in paths]
    h, ahead = np.concatenate([np.append(np.nan, s) for s in step]), np.concatenate([np.append(s, np.nan) for s in step])
    for noise in (K.BALL_NOISE, K.PLAYER_NOISE):
        want = np.concatenate([plain_smoother(ticks / 10.0, z, *noise, K.GATE_SIGMA) for ticks, z in paths])
        got = K.smooth_abreast(np.append(0, np.cumsum(lengths)[:-1]), h, np.concatenate([z for _, z in paths]), ahead, *noise)
        assert np.abs(got - want).max() < 1e-10


def test_many_short_trajectories_share_a_python_call(spark):
    d = spark.range(40).selectExpr("id % 20 AS k", "id AS event_id", "id AS ti", "id / 1.0D AS t", "1.0D AS x", "2.0D AS y")
    out = K.smoothed(d, ["k"], Timeline(("k",), "ti", ("event_id",)), *K.BALL_NOISE)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()  # that is a call per trajectory
    assert out.count() == 40


@pytest.mark.parametrize("rows", [1, 4, 100])
def test_stacks_hold_whole_groups(rows):
    sizes = [1, 7, 2, 1, 1, 5]
    d = pd.DataFrame({"i": np.concatenate([np.arange(n) + 1 for n in sizes])})
    stacks = list(Q.whole_groups((d.iloc[a : a + 3] for a in range(0, len(d), 3)), rows))
    assert pd.concat(stacks)["i"].tolist() == d["i"].tolist()
    assert all(s["i"].iloc[0] == 1 for s in stacks) and (len(stacks) == 1) == (rows == 100)


def test_tracks_keep_ids_through_motion_and_gate_newcomers():
    ts = TrackSet()
    a = ts.step(0.0, np.array([[0.0, 0], [10, 0]]))
    b = ts.step(0.1, np.array([[10.1, 0], [0.2, 0]]))
    assert b.tolist() == a[::-1].tolist()
    c = ts.step(0.2, np.array([[30.0, 0]]))
    assert c[0] not in a


def test_track_numbers_of_many_groups_are_those_of_each():
    rng = np.random.default_rng(3)
    i, t, points, want = [], [], [], []
    for n in [1, 4, 9, 1, 12, 3]:
        at, p, ts = np.sort(rng.integers(0, 1 + n // 3, n)), rng.random((n, 2)) * 6, TrackSet(gate=2.0)
        want += [k for v in np.unique(at) for k in ts.step(float(v), p[at == v])]
        i, t, points = [*i, *range(1, n + 1)], [*t, *at], [*points, *p]
    assert track_numbers(np.array(i), np.array(t), np.array(points), gate=2.0).tolist() == want


def test_many_short_camera_runs_share_a_python_call(spark):
    from touchline.plans import QUERIES

    out = QUERIES["tracker"](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()  # that is a call per run
    assert out.select("event_id").distinct().count() == out.count() > 0


def test_debounce_needs_three_in_a_row(spark):
    from touchline.operators.timeline import prev, scan

    seq = [0, 1, 1, 0, 1, 1, 1, 0, 0, 1, 0, 0, 0]
    held, rival, streak, want = None, None, 0, []
    for v in seq:  # direct definition
        if held is None or v == held:
            held, rival, streak = v if held is None else held, None, 0
        else:
            streak = streak + 1 if v == rival else 1
            rival = v
            if streak >= 3:
                held, rival, streak = v, None, 0
        want.append(held)
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(seq)], "k int, t int, team int")
    tl = Timeline(("k",), "t")
    d = scan(scan(d, tl, a=prev(F.col("team"))), tl, b=prev(F.col("a")))
    ok = F.col("a").isNull() | ((F.col("team") == F.col("a")) & (F.col("team") == F.col("b")))
    got = [r.h for r in scan(d, tl, h=prev(F.col("team"), when=ok, inclusive=True)).orderBy("t").collect()]
    assert got == want
