"""Statistics whose heavy part is a grouped sum: thresholds, correlations, fixed-effects fits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.timeline import Timeline, fit_timeline, scan, total

# Threshold grid of the engagement calibration.
GRID_START, GRID_STEP, GRID_N = 0.05, 0.01, 91
MIN_TAGS = 30


def grid_value(k: Column) -> Column:
    return F.lit(GRID_START) + k * F.lit(GRID_STEP)


def grid_reached(score: Column) -> Column:
    """How many grid thresholds a score reaches (score >= threshold), settled at the edges."""
    k = F.floor((score - GRID_START) / GRID_STEP)
    k = F.when(score >= grid_value(k + 1), k + 2).when(score < grid_value(k), k).otherwise(k + 1)
    return F.greatest(F.lit(0), F.least(F.lit(GRID_N), k)).cast("int")


def youden(df: DataFrame, keys: Sequence[str], score: Column, positive: Column) -> DataFrame:
    """Threshold with the largest TPR - FPR per key (first on a tie).

    Rows collapse to at most 92 score steps per key before anything is compared with the
    grid, so the sweep costs the same for any number of rows.
    """
    steps = df.groupBy(*keys, grid_reached(score).alias("reached")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(1)).alias("n")
    )
    size = Window.partitionBy(*keys)
    steps = steps.withColumn("pn", F.sum("p").over(size)).withColumn("nn", F.sum("n").over(size))
    # a step holding `reached` thresholds counts for thresholds 0 .. reached-1
    hit = steps.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(GRID_N - 1))))
    up = F.col("reached") > F.col("k")
    rates = hit.groupBy(*keys, "k").agg(
        F.try_divide(F.sum(F.when(up, F.col("p")).otherwise(0)).cast("double"), F.first("pn")).alias("tpr"),
        F.try_divide(F.sum(F.when(up, F.col("n")).otherwise(0)).cast("double"), F.first("nn")).alias("fpr"),
        F.first("pn").alias("p_n"),
        F.first("nn").alias("n_n"),
    )
    best = F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 9).alias("j"), (-F.col("k")).alias("first"), "tpr", "fpr", "p_n", "n_n"))
    return rates.groupBy(*keys).agg(best.alias("b")).select(*keys, grid_value(-F.col("b.first")).alias("threshold"), "b.j", "b.tpr", "b.fpr", "b.p_n", "b.n_n")


def auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Mann-Whitney AUC with ties counted half, from a running total over distinct scores."""
    c = df.groupBy(*keys, score).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(1)).alias("n")
    )
    c = scan(c, fit_timeline(c, keys, score), below=total(F.col("n")))
    wins = F.sum(F.col("p") * (F.col("below") - F.col("n") / 2.0))
    return c.groupBy(*keys).agg((wins / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"), F.sum("p").alias("p_n"), F.sum("n").alias("n_n"))


def partial_corr(r_yx: Column, r_yz: Column, r_xz: Column) -> Column:
    """Correlation of y and x after removing z from both."""
    return (r_yx - r_yz * r_xz) / F.sqrt((1 - r_yz * r_yz) * (1 - r_xz * r_xz))


def anova_f(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way F statistic from each group's count, mean and variance."""
    g = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    g = g.withColumn("gm", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(*keys)) / F.sum("n").over(Window.partitionBy(*keys)))
    a = g.groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
    )
    return a.withColumn("f", (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))


def spline_columns(x: Column, low: Column, mid: Column, high: Column) -> list[Column]:
    """Cubic B-spline basis with one inner knot and no intercept column (4 columns)."""
    t = [low] * 4 + [mid] + [high] * 4
    n = len(t) - 1
    zero, one = F.lit(0.0), F.lit(1.0)
    basis: list[Column | None] = [None] * n
    basis[3] = F.when((x >= low) & (x < mid), one).otherwise(zero)
    basis[4] = F.when((x >= mid) & (x <= high), one).otherwise(zero)
    for degree in (1, 2, 3):
        nextb: list[Column | None] = [None] * (n - degree)
        for i in range(n - degree):
            terms = []
            if basis[i] is not None:
                terms.append(F.coalesce(F.try_divide(x - t[i], t[i + degree] - t[i]), zero) * basis[i])
            if basis[i + 1] is not None:
                terms.append(F.coalesce(F.try_divide(t[i + degree + 1] - x, t[i + degree + 1] - t[i + 1]), zero) * basis[i + 1])
            nextb[i] = sum(terms[1:], terms[0]) if terms else None
        basis = nextb
    return [b if b is not None else zero for b in basis[1:]]


def within_moments(df: DataFrame, unit: Sequence[str], cluster: Sequence[str], cols: Sequence[str], weight: str) -> DataFrame:
    """Weighted cross products of the unit-demeaned columns, summed per cluster.

    Resampling whole clusters only re-weights these sums (a repeated cluster keeps its own
    demeaned rows), so the bootstrap never touches the rows again.
    """
    w = Window.partitionBy(*unit)
    wt = F.col(weight)
    demeaned = df.select(
        *cluster, wt.alias("__w"), *[(F.col(c) - F.sum(F.col(c) * wt).over(w) / F.sum(wt).over(w)).alias(c) for c in cols]
    )
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return demeaned.groupBy(*cluster).agg(*[F.sum(F.col("__w") * F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])


def solve(row: pd.Series, cols: Sequence[str]) -> float:
    """First coefficient of the least-squares fit of cols[0] on cols[1:], minimum norm if collinear."""
    xs = list(cols[1:])
    get = lambda a, b: row[f"{a}__{b}"] if f"{a}__{b}" in row else row[f"{b}__{a}"]
    a = np.array([[get(p, q) for q in xs] for p in xs], dtype=float)
    b = np.array([get(cols[0], p) for p in xs], dtype=float)
    return float(np.linalg.lstsq(a, b, rcond=1e-10)[0][0])


def fit_rows(sums: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One fitted coefficient per row of cross-product sums; rows are solved where they lie."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema)
    names = list(cols)

    def body(batches):
        for pdf in batches:
            est = [solve(r, names) for _, r in pdf.iterrows()]
            yield pdf[list(keys)].assign(estimate=est)

    return sums.mapInPandas(body, f"{schema}, estimate double")


def resample(clusters: DataFrame, cluster: str, n_clusters: Column, reps: int, seed: int) -> DataFrame:
    """Times each cluster is drawn in each repetition when as many draws as clusters are made.

    ``clusters`` has one row per cluster with its 0-based ``no``.  Every (repetition, draw) is
    one hash, so draws are made where the rows lie and repeat exactly.
    """
    draws = clusters.select(F.col("no").alias("draw"), n_clusters.alias("nc")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    pick = F.pmod(F.xxhash64(F.lit(seed), "rep", "draw"), F.col("nc"))
    times = draws.groupBy("rep", pick.alias("no")).agg(F.count(F.lit(1)).alias("times"))
    return times.join(clusters.select("no", cluster), "no").select("rep", cluster, "times")
