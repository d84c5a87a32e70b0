"""Position smoothing as prefix scans: a constant-velocity filter with a gate, then the backward smoothing pass.

A filter step is an element that composes associatively (Sarkka and Garcia-Fernandez, "Temporal parallelization of
Bayesian smoothers", 2021), and so is a smoothing step. NumPy composes the steps of a piece of a trajectory pairwise, in
a number of array operations that grows with the logarithm of its length; Spark composes the pieces' summaries in the
same way. Both axes share one 2 x 2 covariance, so a mean is a 2 x 2 block: (place, velocity) by (x, y).

Composed numbers round differently where samples lie far apart. They only open lanes of ``LANE`` samples, therefore; the
lanes of a piece are then walked side by side by the plain steps, and so are the smoothed means, from the end.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.sequences import per_stack, tasks_of
from touchline.operators.timeline import Timeline, nxt, prev, scan, total
from touchline.session import cut_lineage

# Noise settings of the position smoother (process, measure) and its gate, in deviations.
PLAYER_NOISE, BALL_NOISE = (4.0, 0.3), (12.0, 1.0)
GATE_SIGMA = 4.5
#: Shortest step between samples in seconds, and the variance of the first velocity.
SHORTEST, FREE_VELOCITY = 1e-3, 25.0
#: Samples whose gates are settled together.
BLOCK = 4096
#: Samples between two composed states.
LANE = 128
#: Rows of a trajectory in one task.
PIECE = 20_000
#: Longest trajectory that is walked side by side with others.
ABREAST = 256

_EYE = np.eye(2)


def _turned(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of many 2 x 2 matrices; faster than ``@``, which takes them one by one."""
    return a[..., :1] * b[..., :1, :] + a[..., 1:] * b[..., 1:, :]


def _inverse(m: np.ndarray) -> np.ndarray:
    (a, b), (c, d) = np.moveaxis(m, (-2, -1), (0, 1))
    out = np.stack([np.stack([d, -b], -1), np.stack([-c, a], -1)], -2)
    return out / (a * d - b * c)[..., None, None]


def prefixes(steps: np.ndarray, compose) -> np.ndarray:
    """All prefixes of ``steps`` under the associative ``compose(earlier, later)``, with two compositions per step."""
    n = len(steps)
    if n < 2:
        return steps.copy()
    even = n - n % 2
    upper = prefixes(compose(steps[0:even:2], steps[1:even:2]), compose)
    out = np.empty_like(steps)
    out[0], out[1:even:2] = steps[0], upper
    out[2::2] = compose(upper[: (n - 1) // 2], steps[2::2])
    return out


# An array of filter elements has the shape (n, 5, 2, 2): transition, offset, covariance, information of the past, its precision.


def _filtered(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = np.moveaxis(one, 1, 0), np.moveaxis(two, 1, 0)
    meet = _inverse(_EYE + _times(c1, j2))
    on, back = _times(a2, meet), _turned(_times(meet, a1))
    return np.stack(
        [
            _times(on, a1),
            _times(on, b1 + _times(c1, e2)) + b2,
            _times(_times(on, c1), _turned(a2)) + c2,
            _times(back, e2 - _times(j2, b1)) + e1,
            _times(_times(back, j2), a1) + j1,
        ],
        1,
    )


def _motion(h: np.ndarray, process: float) -> tuple[np.ndarray, np.ndarray]:
    """(transition, noise) of steps of ``h`` seconds."""
    move = np.broadcast_to(_EYE, (len(h), 2, 2)).copy()
    move[:, 0, 1] = h
    force = np.stack([h * h / 2, h], -1) * process
    return move, force[:, :, None] * force[:, None, :]


def state(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """The element that forgets what was before: a mean and a covariance."""
    out = np.zeros((5, 2, 2))
    out[1], out[2] = mean, cov
    return out


def opening(place: np.ndarray, measure: float) -> np.ndarray:
    """State of a trajectory at its first sample."""
    return state(np.stack([place, np.zeros(2)]), np.diag([measure**2, FREE_VELOCITY]))


def filter_steps(h: np.ndarray, xy: np.ndarray, taken: np.ndarray, process: float, measure: float) -> np.ndarray:
    """One element per sample that follows another; those not ``taken`` only move on."""
    move, noise = _motion(h, process)
    s = noise[:, 0, 0] + measure**2
    use = taken / s
    rest = np.broadcast_to(_EYE, noise.shape).copy()
    rest[:, 0, 0] = np.where(taken, measure**2 / s, 1.0)
    rest[:, 1, 0] = -noise[:, 1, 0] * use
    look = move[:, 0, :]  # the place's row of the transition
    told = use[:, None] * xy
    return np.stack([rest @ move, noise[:, :, :1] * told[:, None, :], rest @ noise, look[:, :, None] * told[:, None, :], look[:, :, None] * look[:, None, :] * use[:, None, None]], 1)


def plain_step(before: np.ndarray, h: np.ndarray, xy: np.ndarray, taken: np.ndarray, process: float, measure: float) -> np.ndarray:
    """The state after each of ``before``, a step of ``h`` and a sample, if it is taken."""
    mean, (a, b, c) = before[:, 1], (before[:, 2, i, k] for i, k in ((0, 0), (0, 1), (1, 1)))
    q, r = process**2, measure**2
    place = mean[:, 0] + h[:, None] * mean[:, 1]
    a, b, c = a + 2 * h * b + h * h * c + q / 4 * h * h * h * h, b + h * c + q / 2 * h * h * h, c + q * h * h
    to_place, to_speed = taken * a / (a + r), taken * b / (a + r)
    off = xy - place
    out = np.zeros_like(before)
    out[:, 1] = np.stack([place + to_place[:, None] * off, mean[:, 1] + to_speed[:, None] * off], 1)
    out[:, 2] = np.stack([np.stack([a - to_place * a, b - to_place * b], -1), np.stack([b - to_place * b, c - to_speed * b], -1)], 1)
    return out


def run_filter(start: np.ndarray, h: np.ndarray, xy: np.ndarray, process: float, measure: float, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """(states, taken) of samples that follow the state ``start``.

    Whether a sample passes the gate depends on the samples before. A block is filtered as if all passed, then judged; the
    samples up to the first misjudged one are right, and the rest is filtered anew with the verdicts of this round.
    """
    n = len(h)
    states, taken = np.empty((n, 5, 2, 2)), np.ones(n, bool)
    at = 0
    while at < n:
        end = min(at + BLOCK, n)
        steps = filter_steps(h[at:end], xy[at:end], taken[at:end], process, measure)
        past = prefixes(np.concatenate([start[None], steps]), _filtered)
        move, noise = _motion(h[at:end], process)
        guess = (move @ past[:-1, 1])[:, 0]
        spread = (move @ past[:-1, 2] @ _turned(move) + noise)[:, 0, 0] + measure**2
        passes = ((xy[at:end] - guess) ** 2).sum(1) / spread <= gate**2
        wrong = np.flatnonzero(passes != taken[at:end])
        right = int(wrong[0]) if len(wrong) else end - at
        for k in range(min(LANE, right)):  # one step in all lanes
            own = slice(at + k, at + right, LANE)
            past[k + 1 : right + 1 : LANE] = plain_step(past[k:right:LANE], h[own], xy[own], taken[own], process, measure)
        states[at : at + right] = past[1 : right + 1]
        start = past[right]
        taken[at:end] = passes
        at += right
    return states, taken


# Smoothing elements have the shape (n, 2, 2, 2): gain and offset; the later one is applied first.


def _smoothed(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.stack([_times(earlier[:, 0], later[:, 0]), _times(earlier[:, 0], later[:, 1]) + earlier[:, 1]], 1)


def smoother_steps(states: np.ndarray, ahead: np.ndarray, process: float) -> tuple[np.ndarray, np.ndarray]:
    """(elements, means guessed for the next sample) per state; ``ahead`` is the time to the next sample, NaN where there is none."""
    last = np.isnan(ahead)
    h, q = np.where(last, 1.0, ahead), process**2
    mean, (a, b, c) = states[:, 1], (states[:, 2, i, k] for i, k in ((0, 0), (0, 1), (1, 1)))
    pa, pb, pc = a + 2 * h * b + h * h * c + q / 4 * h * h * h * h, b + h * c + q / 2 * h * h * h, c + q * h * h
    to_place, to_speed, det = a + h * b, b + h * c, pa * pc - pb * pb
    gain = np.stack([np.stack([to_place * pc - b * pb, b * pa - to_place * pb], -1), np.stack([to_speed * pc - c * pb, c * pa - to_speed * pb], -1)], 1)
    gain = np.where(last[:, None, None], 0, gain / det[:, None, None])
    guess = np.stack([mean[:, 0] + h[:, None] * mean[:, 1], mean[:, 1]], 1)
    return np.stack([gain, mean - gain @ guess], 1), guess


def run_smoother(steps: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Smoothed means, (n, 2, 2); ``after``: the smoothed mean of the sample that follows."""
    back = steps[::-1]
    if after is not None:
        back = np.concatenate([np.stack([np.zeros((2, 2)), after])[None], back])
    out = prefixes(back, _smoothed)[::-1, 1]
    return out if after is None else out[:-1]


def smoothed_places(states: np.ndarray, ahead: np.ndarray, process: float, after: np.ndarray | None = None) -> np.ndarray:
    """Smoothed places of samples in a row from their filtered states."""
    steps, guess = smoother_steps(states, ahead, process)
    n, gain = len(states), steps[:, 0]
    out = np.concatenate([run_smoother(steps, after), guess[-1:] if after is None else after[None]])
    for k in range(min(LANE, n)):  # one step back in all lanes
        own, later = slice(n - 1 - k, None, -LANE), slice(n - k, 0, -LANE)
        off = out[later] - guess[own]
        out[own] = states[own, 1] + gain[own, :, :1] * off[:, :1] + gain[own, :, 1:] * off[:, 1:]
    return out[:-1, 0]


def smooth_steps(h: np.ndarray, xy: np.ndarray, process: float, measure: float, gate: float = GATE_SIGMA) -> np.ndarray:
    """Smoothed places of one trajectory of samples ``h`` seconds apart."""
    first = opening(xy[0], measure)
    states, _ = run_filter(first, h, xy[1:], process, measure, gate)
    states = np.concatenate([first[None], states])
    return smoothed_places(states, np.append(h, np.nan), process)


def smooth_path(t: np.ndarray, xy: np.ndarray, process: float, measure: float, gate: float = GATE_SIGMA) -> np.ndarray:
    """Smoothed places of one trajectory in memory, in the order of its samples."""
    if not len(t):
        return np.zeros((0, 2))
    return smooth_steps(np.maximum(np.diff(t), SHORTEST), xy, process, measure, gate)


def smooth_abreast(starts: np.ndarray, h: np.ndarray, xy: np.ndarray, ahead: np.ndarray, process: float, measure: float, gate: float = GATE_SIGMA) -> np.ndarray:
    """Smoothed places of trajectories that follow each other from ``starts`` on; ``h`` and ``ahead`` as in their rows.

    Those of up to ``ABREAST`` samples take each step together, forward and back; a longer one is taken by itself.
    """
    lengths = np.diff(np.append(starts, len(xy)))
    out = np.empty((len(xy), 2))
    for a, n in zip(starts[lengths > ABREAST], lengths[lengths > ABREAST]):
        out[a : a + n] = smooth_steps(h[a + 1 : a + n], xy[a : a + n], process, measure, gate)
    short = np.flatnonzero(lengths <= ABREAST)
    short = short[np.argsort(-lengths[short], kind="stable")]  # those still walking come first
    starts, lengths = starts[short], lengths[short]
    if not len(short):
        return out
    mine = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
    states = np.zeros((len(xy), 5, 2, 2))
    states[starts, 1, 0] = xy[starts]
    states[starts, 2] = np.diag([measure**2, FREE_VELOCITY])
    walking = [starts[: np.searchsorted(-lengths, -k)] + k for k in range(1, lengths[0])]
    for own in walking:
        before, step = states[own - 1], h[own]
        mean, (a, b, c) = before[:, 1], (before[:, 2, i, k] for i, k in ((0, 0), (0, 1), (1, 1)))
        off = xy[own] - (mean[:, 0] + step[:, None] * mean[:, 1])
        spread = a + 2 * step * b + step * step * c + process**2 / 4 * step * step * step * step + measure**2
        states[own] = plain_step(before, step, xy[own], (off**2).sum(1) / spread <= gate**2, process, measure)
    means = states[:, 1].copy()
    gain, guess = np.empty((len(xy), 2, 2)), np.empty((len(xy), 2, 2))
    steps, guess[mine] = smoother_steps(states[mine], ahead[mine], process)
    gain[mine] = steps[:, 0]
    for later in reversed(walking):
        own = later - 1
        off = means[later] - guess[own]
        means[own] += gain[own, :, :1] * off[:, :1] + gain[own, :, 1:] * off[:, 1:]
    out[mine] = means[mine, 0]
    return out


def smoothed(
    df: DataFrame, keys: list[str], tl: Timeline, process: float, measure: float, gate: float = GATE_SIGMA, piece: int = PIECE
) -> DataFrame:
    """``keys, event_id, sx, sy``: smoothed places of rows ``(keys, event_id, t, x, y)`` in the order of ``tl``.

    Rows without a time or a place take no part; a trajectory of one row stays where it is; equal times count as
    ``SHORTEST`` apart. Trajectories of up to ``piece`` rows are read whole, many in one call; a longer one is taken in pieces of
    ``piece`` rows. A piece is first summed up as if it began a
    trajectory; the summaries composed in order tell every piece its true state at the start. With it the gates are judged
    anew, until no piece judges otherwise than in the round before; then all states at the borders are those of a single
    pass, up to rounding (1e-12 for samples up to seconds apart; where they lie a minute apart, any pass in doubles is good
    to about 1e-8). A gate matters little beyond its neighbourhood, so this takes a round or two; round k settles piece k at least.
    Summaries hold 28 numbers, so a task that composes those of one trajectory has a piece's size for 10^8 rows.
    """
    tl = tl.by(*keys)
    df = df.where(F.col("t").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("t") & ~F.isnan("x") & ~F.isnan("y"))
    counts = df.groupBy(*keys).count()
    longest = counts.agg(F.max("count")).first()[0] or 0
    one = F.lit(1).cast("bigint")
    step = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(b - a, F.lit(SHORTEST)))
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, "event_id").schema) + ", sx double, sy double"

    def whole(pdf):
        starts = np.flatnonzero(pdf["i"].to_numpy() == 1)
        t, t0, t1 = (pdf[c].to_numpy(float) for c in ("t", "__before", "__after"))
        h, ahead = np.maximum(t - t0, SHORTEST), np.maximum(t1 - t, SHORTEST)  # NaN where there is no neighbour
        place = smooth_abreast(starts, h, pdf[["x", "y"]].to_numpy(float), ahead, process, measure, gate)
        return pdf[[*keys, "event_id"]].assign(sx=place[:, 0], sy=place[:, 1])

    def wholes(d: DataFrame) -> DataFrame:
        d = d.select(*dict.fromkeys([*keys, "event_id", *tl.order, "t", "x", "y"]))
        return per_stack(d, tl, whole, result, __before=prev(F.col("t")), __after=nxt(F.col("t")))

    if longest <= piece:
        return wholes(df)
    # the long ones are one key in ``piece`` rows at most
    long = counts.where(F.col("count") > piece).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
    short, df = df.join(F.broadcast(long), same, "left_anti"), df.join(F.broadcast(long), same, "left_semi")
    rows = scan(df, tl, __i=total(one), __before=prev(F.col("t")), __after=nxt(F.col("t")))
    rows = rows.select(
        *keys, "event_id", "x", "y", F.col("__i").alias("i"), F.floor((F.col("__i") - 1) / piece).alias("piece"),
        step(F.col("__before"), F.col("t")).alias("h"), step(F.col("t"), F.col("__after")).alias("ahead"),
    )
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    group = [*keys, "piece"]

    def filtered(pdf: pd.DataFrame, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states, taken, composed element) of a piece; without a state before, its first sample opens a trajectory."""
        h, xy = pdf["h"].to_numpy(float), pdf[["x", "y"]].to_numpy(float)
        if before is not None:
            states, taken = run_filter(before, h, xy, process, measure, gate)
            return states, taken, prefixes(filter_steps(h, xy, taken, process, measure), _filtered)[-1]
        first = opening(xy[0], measure)
        states, taken = run_filter(first, h[1:], xy[1:], process, measure, gate)
        states, taken = np.concatenate([first[None], states]), np.append(True, taken)
        head = first[None] if np.isnan(h[0]) else filter_steps(h[:1], xy[:1], taken[:1], process, measure)
        steps = np.concatenate([head, filter_steps(h[1:], xy[1:], taken[1:], process, measure)])
        return states, taken, prefixes(steps, _filtered)[-1]

    def told(value) -> np.ndarray | None:
        """The state before a piece as an element; none for the first piece."""
        if value is None:
            return None
        mean, cov = np.asarray(value, float).reshape(2, 2, 2)
        return state(mean, cov)

    def summary(key, pdf, given):
        pdf = pdf.sort_values("i")
        states, taken, composed = filtered(pdf, None if given is None else told(given["before"].iloc[0]))
        back = prefixes(smoother_steps(states, pdf["ahead"].to_numpy(float), process)[0][::-1], _smoothed)[-1]
        verdicts = hashlib.sha256(np.packbits(taken).tobytes()).hexdigest()
        same = given is not None and given["verdicts"].iloc[0] == verdicts
        return pd.DataFrame([[*key, composed.ravel(), back.ravel(), verdicts, same]], columns=[*group, "whole", "back", "verdicts", "same"])

    def borders(key, pdf):
        """What the pieces of a trajectory learn from each other: the state before each, the smoothed mean after each."""
        pdf = pdf.sort_values("piece")
        wholes = np.stack(pdf["whole"].to_list()).reshape(-1, 5, 2, 2)
        backs = np.stack(pdf["back"].to_list()).reshape(-1, 2, 2, 2)
        before = [None, *(s[1:3].ravel() for s in prefixes(wholes, _filtered)[:-1])]
        after = [*(m.ravel() for m in run_smoother(backs)[1:]), None]
        out = pd.DataFrame({"piece": pdf["piece"].to_numpy(), "before": before, "after": after, "verdicts": pdf["verdicts"].to_numpy()})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*group, "before", "after", "verdicts"]]

    def final(key, pdf, given):
        pdf = pdf.sort_values("i")
        before, after = told(given["before"].iloc[0]), given["after"].iloc[0]
        states, _, _ = filtered(pdf, before)
        place = smoothed_places(states, pdf["ahead"].to_numpy(float), process, None if after is None else np.asarray(after, float).reshape(2, 2))
        out = pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "sx": place[:, 0], "sy": place[:, 1]})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "event_id", "sx", "sy"]]

    rows = cut_lineage(rows.repartition(tasks_of(df.sparkSession), *group))
    summed = f"{ddl}, piece bigint, whole array<double>, back array<double>, verdicts string, same boolean"
    parts = cut_lineage(rows.groupBy(*group).applyInPandas(lambda key, pdf: summary(key, pdf, None), summed))
    while True:
        edges = parts.groupBy(*keys).applyInPandas(borders, f"{ddl}, piece bigint, before array<double>, after array<double>, verdicts string")
        if parts.where("NOT same").isEmpty():
            break
        both = rows.groupBy(*group).cogroup(edges.groupBy(*group))
        parts = cut_lineage(both.applyInPandas(summary, summed))
    return rows.groupBy(*group).cogroup(edges.groupBy(*group)).applyInPandas(final, result).union(wholes(short))
