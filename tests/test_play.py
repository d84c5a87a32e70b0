"""Live-ball rule, statistics helpers, text and file readers on hand-made input."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import play
from touchline.operators import stats as ST
from touchline.operators.timeline import Timeline
from touchline.sources import feeds, sinks, tracking


@pytest.mark.parametrize("next_start,live_at", [(160, {159: True}), (161, {54: True, 55: False, 159: False})])
def test_live_until_next_touch_or_tail(spark, next_start, live_at):
    """On-ball [0, 10], next at 160 is in reach; at 161 play stops 45 after the touch ended (exclusive)."""
    probes = [(1, t, "PA", 0) for t in live_at]
    d = spark.createDataFrame([(1, 0, "OTB", 10), (1, next_start, "OTB", 0), *probes], "m int, t int, kind string, dur int")
    got = play.live_flags(d, Timeline(("m",), "t"), F.col("t") + F.col("dur"), 150, 45)
    flags = {r.t: r.live for r in got.collect()}
    assert {t: flags[t] for t in live_at} == live_at


def test_ball_out_stops_play(spark):
    d = spark.createDataFrame([(1, 0, "OTB", 10), (1, 30, "OUT", 0), (1, 60, "PA", 0), (1, 100, "OTB", 0)], "m int, t int, kind string, dur int")
    got = {r.t: r.live for r in play.live_flags(d, Timeline(("m",), "t"), F.col("t") + F.col("dur"), 150, 45).collect()}
    assert got[30] and not got[60]


def test_auc_counts_ties_half(spark):
    d = spark.createDataFrame([("g", 1.0, True), ("g", 1.0, True), ("g", 1.0, False), ("g", 0.0, False)], "g string, s double, p boolean")
    assert ST.auc(d, ["g"], "s", F.col("p")).first()["auc"] == pytest.approx(0.75)


def test_youden_takes_the_first_best_threshold(spark):
    d = spark.createDataFrame([(0.9, True), (0.8, True), (0.3, False), (0.2, False)], "s double, p boolean")
    r = ST.youden(d, [], F.col("s"), F.col("p")).first()
    assert r["threshold"] == pytest.approx(0.31) and r["j"] == pytest.approx(1.0)


def test_spline_columns_are_a_b_spline_basis(spark):
    xs = np.linspace(0, 10, 41)
    d = spark.createDataFrame([(float(x),) for x in xs], "x double")
    cols = ST.spline_columns(F.col("x"), F.lit(0.0), F.lit(4.0), F.lit(10.0))
    got = np.array([list(r) for r in d.orderBy("x").select(*cols).collect()])

    def value(i, k, x, t):
        if k == 0:
            last = t[i + 1] == t[-1]
            return 1.0 if t[i] <= x < t[i + 1] or (last and x == t[-1] and t[i] < t[i + 1]) else 0.0
        a = 0 if t[i + k] == t[i] else (x - t[i]) / (t[i + k] - t[i]) * value(i, k - 1, x, t)
        b = 0 if t[i + k + 1] == t[i + 1] else (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * value(i + 1, k - 1, x, t)
        return a + b

    knots = [0.0] * 4 + [4.0] + [10.0] * 4
    want = np.array([[value(i, 3, x, knots) for i in range(1, 5)] for x in xs])
    assert np.allclose(got, want)


def test_within_fit_matches_dummy_regression(spark):
    rng = np.random.default_rng(7)
    n = 120
    g, x, b, w = rng.integers(0, 6, n), rng.integers(0, 2, n).astype(float), rng.normal(size=n), rng.uniform(1, 9, n)
    y = 2 * x - b + g + rng.normal(size=n)
    d = spark.createDataFrame([(int(a) // 2, int(a), *map(float, r)) for a, *r in zip(g, y, x, b, w)], "m int, g int, ys double, xs double, b0 double, w double")
    m = ST.within_moments(d, ["g"], ["m"], ["ys", "xs", "b0"], "w")
    tot = m.agg(*[F.sum(c).alias(c) for c in m.columns if c != "m"]).withColumn("model", F.lit("a"))
    est = ST.fit_rows(tot, ["model"], ["ys", "xs", "b0"]).first()["estimate"]
    X = np.c_[x, b, np.eye(6)[g]] * np.sqrt(w)[:, None]
    assert est == pytest.approx(np.linalg.lstsq(X, y * np.sqrt(w), rcond=None)[0][0])
    ids = spark.createDataFrame([(i, i) for i in range(3)], "no int, m int")
    draws = ST.resample(ids, "m", F.lit(3), 50, 0).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert len(draws) == 50 and all(r.n == 3 for r in draws)


@pytest.mark.parametrize("n,want", [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (21, "21st"), (111, "111th")])
def test_ordinals(spark, n, want):
    assert spark.createDataFrame([(n,)], "n int").select(T.ordinal(F.col("n"))).first()[0] == want


def test_clock_texts(spark):
    d = spark.createDataFrame([(2710.5, 1), (2699.0, 1), (5520.0, 2)], "s double, p int")
    got = [tuple(r) for r in d.select(T.clock(F.col("s")), T.minute_label(F.col("s"), F.col("p"))).collect()]
    assert got == [("45:10", "45+1'"), ("44:59", "45'"), ("92:00", "90+3'")]
    assert spark.range(1).select(T.number(F.lit(2.0)), T.number(F.lit(1.5)), T.number(F.lit(1.26))).first()[:] == ("2", "1.5", "1.26")


def test_tracking_reader_dedups_and_falls_back(spark, tmp_path):
    p = lambda j, x: {"jerseyNum": j, "x": x, "y": 1.0}
    lines = [
        {"frameNum": 1, "homePlayers": [p("7", 9.0)], "homePlayersSmoothed": [p("7", 1.0), p("7", 5.0), p("8", None)], "ballsSmoothed": {"x": 2.0, "y": 3.0, "z": -1.0}},
        {"frameNum": 1, "homePlayers": [p("7", 99.0)], "ballsSmoothed": None},
        {"frameNum": 2, "homePlayers": [p("7", 4.0)], "homePlayersSmoothed": [], "ballsSmoothed": [{"x": 6.0, "y": 0.0}], "balls": [{"x": 8.0}]},
        {"frameNum": 3, "ballsSmoothed": {"x": None}, "balls": [{"x": 8.0, "y": 1.0, "z": 2.0}]},
    ]
    f = tmp_path / "t.jsonl"
    f.write_text("\n".join(map(json.dumps, lines)))
    t = tracking.ball(tracking.unique_frames(tracking.read_tracking(spark, str(f))))
    assert {(r.frameNum, r.side, r.jersey, r.x) for r in tracking.positions(t).collect()} == {(1, "home", "7", 1.0), (2, "home", "7", 4.0)}
    assert {r.frameNum: tuple(r.ball) for r in t.collect()} == {1: (2.0, 3.0, 0.0), 2: (6.0, 0.0, 0.0), 3: (8.0, 1.0, 2.0)}


def test_json_arrays_are_valid_documents(spark, tmp_path):
    out = str(tmp_path / "a")
    sinks.write_json_arrays(spark.range(10).repartition(3), out)
    docs = [json.loads(f.read_text()) for f in (tmp_path / "a").glob("part-*")]
    assert sorted(r["id"] for d in docs for r in d) == list(range(10))


def test_short_ids(spark):
    r = spark.createDataFrame([("AB-CD-00001Z",), ("AB-EF-0009K3",)], "i string").select(feeds.short_id(F.col("i"))).collect()
    assert [x[0] for x in r] == [int("00001Z", 36), int("0009K3", 36)]


def test_only_missing_keys_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_missing(rows, path, "k")  # nothing is there yet
    sinks.write_missing(rows.selectExpr("k + 1 AS k", "'new' AS v"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "new")]
