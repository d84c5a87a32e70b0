"""Points in intervals against brute force."""

import random

from pyspark.sql import functions as F

from touchline.operators.intervals import dyadic, least_covering


def test_blocks_fill_the_interval_once(spark):
    pairs = [(a, b) for a in range(-9, 20) for b in range(a, 20)]
    d = spark.createDataFrame(pairs, "a long, b long").withColumn("blocks", dyadic(F.col("a"), F.col("b"), 6))
    for r in d.collect():
        ticks = [t for level, slot in r.blocks for t in range(slot << level, (slot + 1) << level)]
        assert sorted(ticks) == list(range(r.a, r.b + 1))


def test_least_covering_equals_brute_force(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), s := rng.randrange(-500, 5000), s + rng.choice([0, 3, 50, 4000]), i) for i in range(300)]
    spans += [("a", -500, 9000, 900 + i) for i in range(50)] + [("b", 10, 9, 950), (None, 0, 9000, 0), ("a", None, 5, 1), ("a", 5, None, 2)]
    points = [(rng.choice("abc"), rng.randrange(-600, 9100), "x") for _ in range(200)]
    points += [points[0], (None, 5, "x"), ("a", None, "x")]
    sp = spark.createDataFrame(spans, "k string, s long, e long, id long")
    pt = spark.createDataFrame(points, "k string, t long, e string")  # a column named like one of the spans'
    got = least_covering(pt, sp, ["k"], "t", F.col("s"), F.col("e"), F.struct("e", "id"), "hit")
    assert got.columns == ["k", "t", "e", "hit"]

    def want(k, t):
        hits = [(e, i) for q, s, e, i in spans if q == k and None not in (k, s, e, t) and s <= t <= e]
        return min(hits, default=None)

    rows = [(r.k, r.t, tuple(r.hit) if r.hit else None) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(str((k, t, want(k, t))) for k, t, _ in points)


def test_no_spans_and_no_points(spark):
    sp = spark.createDataFrame([], "k int, s long, e long")
    pt = spark.createDataFrame([(1, 5)], "k int, t long")
    assert least_covering(pt, sp, ["k"], "t", F.col("s"), F.col("e"), F.col("e"), "hit").collect() == [(1, 5, None)]
    assert least_covering(pt.limit(0), sp, ["k"], "t", F.col("s"), F.col("e"), F.col("e"), "hit").count() == 0
