"""Grids over the pitch as long tables (key, ix, iy, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLS, ROWS = 52, 34
LOG_FLOOR = 3e-4


def histogram(df: DataFrame, keys: list[str], x: Column, y: Column, weight: Column | None = None) -> DataFrame:
    """Weighted 2-D histogram on the 52 x 34 pitch grid; the top edge belongs to the last cell."""
    ix = F.least(F.floor((x + 52.5) / (105.0 / COLS)), F.lit(COLS - 1)).cast("int")
    iy = F.least(F.floor((y + 34.0) / (68.0 / ROWS)), F.lit(ROWS - 1)).cast("int")
    v = F.sum(weight) if weight is not None else F.count(F.lit(1)).cast("double")
    return df.groupBy(*keys, ix.alias("ix"), iy.alias("iy")).agg(v.alias("v"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * k * k / (sigma * sigma)) for k in range(-r, r + 1)]
    return [(k, v / sum(w)) for k, v in zip(range(-r, r + 1), w)]


def _blur_axis(df: DataFrame, keys: list[str], axis: str, other: str, n: int, sigma: float, mirror: bool) -> DataFrame:
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in kernel(sigma)])
    s = F.col(axis)
    places = F.array(s, -1 - s, 2 * n - 1 - s) if mirror else F.array(s)
    hits = F.flatten(
        F.transform(places, lambda p: F.transform(taps, lambda t: F.struct((p - t["k"]).alias("at"), t["w"].alias("w"))))
    )
    spread = df.select(*keys, other, "v", F.explode(F.filter(hits, lambda h: (h["at"] >= 0) & (h["at"] < n))).alias("h"))
    return spread.groupBy(*keys, F.col("h.at").alias(axis), other).agg(F.sum(F.col("v") * F.col("h.w")).alias("v"))


def blur(df: DataFrame, keys: list[str], sigma: float, cols: int = COLS, rows: int = ROWS, mirror: bool = True) -> DataFrame:
    """Gaussian blur, one axis at a time; edges reflect (``mirror``) or are treated as empty."""
    wide = _blur_axis(df, keys, "ix", "iy", cols, sigma, mirror)
    return _blur_axis(wide, keys, "iy", "ix", rows, sigma, mirror).select(*keys, "ix", "iy", "v")


def log_scale(v: Column) -> Column:
    return F.log1p(v / LOG_FLOOR)


def quantise(v: Column, ceiling: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / ceiling)) * 255).cast("int")


def encode(df: DataFrame, keys: list[str], cols: int = COLS, rows: int = ROWS) -> DataFrame:
    """One base64 string of cols*rows bytes per key, column by column, empty cells zero.

    A grid has a fixed number of cells, so the array built per key is bounded.
    """
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("ix") * rows + F.col("iy")).alias("i"), F.col("q"))))
    grid = F.transform(F.sequence(F.lit(0), F.lit(cols * rows - 1)), lambda i: F.coalesce(F.col("cells")[i], F.lit(0)))
    hexed = F.array_join(F.transform(grid, lambda q: F.lpad(F.hex(q), 2, "0")), "")
    return df.groupBy(*keys).agg(cells.alias("cells")).select(*keys, F.translate(F.base64(F.unhex(hexed)), "\r\n", "").alias("grid"))
