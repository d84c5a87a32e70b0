"""Event-time operators on topics whose rows come shuffled, in small batches, late, and end with a closing row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.streaming import live

KIND = "match_id long, team int, entity long, event_id long, clock_us long, x double, y double, value double, ts timestamp"
S = 1_000_000


def topic(spark, folder, batches, close=True):
    for rows in batches:
        df = spark.createDataFrame([(*r, None) for r in rows], KIND).withColumn("ts", F.timestamp_micros("clock_us"))
        df.coalesce(1).write.mode("append").parquet(folder)
    if close:
        every = spark.read.schema(KIND).parquet(folder)
        live.closing(every, "match_id").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)


def readings(seed, n=120, spread=20):
    """Rows in time order, and the same in batches, out of order by under ``spread`` seconds; some share a time."""
    rng = random.Random(seed)
    rows = [(k % 2, rng.randint(0, 1), rng.randint(1, 3), k, 3600 * S + (k - k % 3) * S // 2, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(0, 5)) for k in range(n)]
    arrival = sorted(rows, key=lambda r: r[4] + rng.random() * spread * S)
    return rows, [arrival[k : k + 30] for k in range(0, n, 30)]


def test_trailing_mean_of_shuffled_rows(spark, tmp_path):
    rows, batches = readings(1)
    s = topic(spark, f"{tmp_path}/t", batches)
    d = live.in_order(s, ["match_id", "team"], live.TrailingMean(3 * S), "event_id bigint, mean double", "60 seconds")
    got = {r.event_id: r["mean"] for r in live.drain(spark, d, "append").collect()}
    assert len(got) == len(rows)
    for r in rows:
        near = [o[7] for o in rows if o[:2] == r[:2] and r[4] - 3 * S < o[4] <= r[4]]
        assert got[r[3]] == pytest.approx(sum(near) / len(near), abs=1e-12)


@pytest.mark.parametrize("touches", [1, 3])
def test_possession_of_shuffled_rows(spark, tmp_path, touches):
    rows, batches = readings(2)
    d = live.in_order(topic(spark, f"{tmp_path}/t", batches), ["match_id"], live.Possession(touches), "match_id bigint, event_id bigint, loser int", "60 seconds")
    got = sorted((r.match_id, r.event_id, r.loser) for r in live.drain(spark, d, "append").collect())
    want = []
    for m in (0, 1):
        holder, others = None, 0
        for r in sorted((r for r in rows if r[0] == m), key=lambda r: (r[4], r[3])):
            holder = r[1] if holder is None else holder
            others = others + 1 if r[1] != holder else 0
            if others == touches:
                want.append((m, r[3], holder))
                holder, others = r[1], 0
    assert got == sorted(want)


def test_pressure_frames_of_shuffled_rows(spark, tmp_path):
    rows, batches = readings(3)
    frame, lookback = 10 * S, 8 * S
    d = live.in_order(topic(spark, f"{tmp_path}/t", batches), ["match_id", "team"], live.PressureFrames(frame, lookback), "match_id bigint, team int, frame bigint, n bigint, score double, presser bigint", "60 seconds")
    got = {(r.match_id, r.team, r.frame): (r.n, r.score, r.presser) for r in live.drain(spark, d, "append").collect()}
    want, was = {}, {}
    for m, team, entity, event, t, x, y, _ in sorted(rows, key=lambda r: (r[4], r[3])):
        old = was.get((m, team, entity))
        dt = (t - old[0]) / 1e6 if old else 0
        vx, vy = ((x - old[1]) / dt, (y - old[2]) / dt) if 0 < dt <= 8 else (0, 0)
        chance = 1 / (1 + math.exp((0.7 + math.hypot(x + 0.7 * vx, y + 0.7 * vy) / 8 - 1.5) / 0.5))
        want.setdefault((m, team, t // frame), []).append((-round(chance, 6), entity, chance))
        was[m, team, entity] = (t, x, y)
    assert got.keys() == want.keys()
    for k, c in want.items():
        assert got[k] == (len(c), pytest.approx(1 - math.prod(1 - x[2] for x in c)), min(c)[1])


def test_pressure_frames_of_readings_a_microsecond_apart(spark, tmp_path):
    rows = [(0, 0, 1, 0, 3600 * S, -50.0, 0.0, 0.0), (0, 0, 1, 1, 3600 * S + 1, 50.0, 0.0, 0.0), (0, 0, 2, 2, 3600 * S + 2, 0.0, 0.0, 0.0)]
    d = live.in_order(topic(spark, f"{tmp_path}/t", [rows]), ["match_id", "team"], live.PressureFrames(10 * S, 8 * S), "match_id bigint, team int, frame bigint, n bigint, score double, presser bigint", "60 seconds")
    (got,) = live.drain(spark, d, "append").collect()
    chance = [1 / (1 + math.exp((0.7 + r / 8 - 1.5) / 0.5)) for r in (50, 0)]
    assert (got.n, got.score, got.presser) == (3, pytest.approx(1 - (1 - chance[0]) * (1 - chance[1])), 2)


def test_late_rows_are_dropped_counted_and_listed(spark, tmp_path):
    first = [(0, 0, 1, k, (100 + k) * S, 0.0, 0.0, 1.0) for k in range(10)]
    second = [(0, 0, 1, 20, 200 * S, 0.0, 0.0, 1.0)]
    late = [(0, 0, 1, 30 + k, k * S, 0.0, 0.0, 1.0) for k in range(7)] + [(0, 0, 1, 40, 195 * S, 0.0, 0.0, 1.0)]
    s = topic(spark, f"{tmp_path}/t", [first, second, late])
    seen = []
    d = live.in_order(s, ["match_id"], live.Possession(1), "match_id bigint, event_id bigint, loser int", "10 seconds")
    live.drain(spark, d, "append", on_progress=lambda p: seen.append(live.dropped(p)))
    assert seen == [7]
    s = topic(spark, f"{tmp_path}/u", [first, second, late], close=False)
    d = live.stateful(s, ["match_id"], live.LateRows(10 * S), "match_id bigint, event_id bigint, late_us bigint")
    assert {r.event_id: r.late_us for r in live.drain(spark, d, "append").collect()} == {30 + k: (200 - k) * S for k in range(7)}


def test_open_sessions_end_with_the_topic(spark, tmp_path):
    rows = [(0, 0, 1, k, t * S, 0.0, 0.0, 1.0) for k, t in enumerate([1, 2, 30, 31, 33])]
    d = live.sessions(topic(spark, f"{tmp_path}/t", [rows[2:], rows[:2]]), ["match_id"], "10 seconds", "60 seconds")
    got = live.drain(spark, d, "append").where("match_id IS NOT NULL").select(F.unix_micros("start").alias("a"), F.unix_micros("end").alias("b"), "n")
    assert sorted(map(tuple, got.collect())) == [(1 * S, 12 * S, 2), (30 * S, 43 * S, 3)]
