"""Per-moment geometry against NumPy, and its symmetries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators import geometry as G
from touchline.operators import raster as R
from touchline.sources.driver_tables import moments

DIR = "/root/testdata/sf0.001"


def hull_test(pts):
    edges = []
    for a in pts:
        for b in pts:
            if (a != b).any():
                cr = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
                if cr.min() >= -1e-9:
                    edges.append((a, b - a))
    return lambda q: np.all([e[0] * (q[:, 1] - a[1]) - e[1] * (q[:, 0] - a[0]) >= -1e-9 for a, e in edges], axis=0)


def test_holes_and_free_players_match_numpy(spark):
    m = moments(spark, DIR).where("frame < 25")
    b = G.block_moments(m)
    areas = {r.frame: (r.inside, r.holes) for r in G.block_areas(b).collect()}
    free = {r.frame: r.n for r in b.select("frame", F.size(G.free_players(F.col("o"), F.col("d"), F.col("edges"))).alias("n")).collect()}
    gx, gy = np.meshgrid(np.arange(-20, 70) + 0.5, np.arange(-34, 34) + 0.5, indexing="ij")
    cells = np.c_[gx.ravel(), gy.ravel()]
    for r in m.collect():
        team, s = 1 - r.poss, 1.0 if 1 - r.poss == 0 else -1.0
        d = np.array([(p.x * s, p.y * s) for p in r.players if p.team == team and not p.gk])
        o = np.array([(p.x * s, p.y * s) for p in r.players if p.team != team and not p.gk])
        back = np.sort(d[:, 0])[:4].mean()
        d[:, 0] -= back
        o[:, 0] -= back
        ok = hull_test(d)
        ins = cells[ok(cells)]
        near = np.hypot(ins[:, None, 0] - d[None, :, 0], ins[:, None, 1] - d[None, :, 1]).min(1)
        assert areas[r.frame] == (len(ins), int((near > 8).sum()))
        oi = o[ok(o)]
        gap = np.hypot(oi[:, None, 0] - d[None, :, 0], oi[:, None, 1] - d[None, :, 1]).min(1) if len(oi) else np.array([])
        assert free[r.frame] == int((gap > 5).sum())


def test_half_turn_and_team_swap_leave_own_frame_measures(spark):
    """Turning the pitch by 180 degrees and swapping which end each team defends changes nothing in the own frame."""
    m = moments(spark, DIR).where("frame < 60")
    turned = m.withColumn(
        "players", F.transform("players", lambda p: F.struct(p["entity"].alias("entity"), (1 - p["team"]).alias("team"), p["gk"].alias("gk"), (-p["x"]).alias("x"), (-p["y"]).alias("y")))
    ).withColumn("poss", 1 - F.col("poss"))
    a = {r.frame: (r.inside, r.holes) for r in G.block_areas(G.block_moments(m)).collect()}
    b = {r.frame: (r.inside, r.holes) for r in G.block_areas(G.block_moments(turned)).collect()}
    assert a == b


@pytest.mark.parametrize("depth,length,want", [(40.0, 5.0, "High Press"), (32.0, 5.0, "Mid Block"), (31.9, 20.0, "Low Block"), (31.9, 20.1, "Mid Block"), (31.9, None, "Mid Block"), (None, 5.0, None)])
def test_block_thresholds(spark, depth, length, want):
    d = spark.createDataFrame([(depth, length)], "d double, l double")
    assert d.select(P.block_label(F.col("d"), F.col("l"))).first()[0] == want


@pytest.mark.parametrize("y,five,three", [(9.16, "centre", "middle"), (9.17, "left half-space", "middle"), (68 / 6, "left half-space", "middle"), (-9.16, "right half-space", "middle"), (-20.17, "right wing", "right")])
def test_lane_edges(spark, y, five, three):
    r = spark.createDataFrame([(y,)], "y double").select(P.lane5(F.col("y")), P.lane3(F.col("y"))).first()
    assert tuple(r) == (five, three)


def test_blur_keeps_mass_and_encode_round_trips(spark):
    d = spark.createDataFrame([(1, 0, 0, 2.0), (1, 51, 33, 1.0), (1, 20, 10, 5.0)], "k int, ix int, iy int, v double")
    b = R.blur(d, ["k"], 1.2)
    assert b.agg(F.sum("v")).first()[0] == pytest.approx(8.0)
    import base64

    g = R.encode(d.withColumn("q", F.col("v").cast("int")), ["k"]).first()["grid"]
    raw = base64.b64decode(g)
    assert len(raw) == 52 * 34 and raw[0] == 2 and raw[51 * 34 + 33] == 1 and raw[20 * 34 + 10] == 5
