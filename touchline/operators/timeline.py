"""Ordered operators over keyed timelines: as-of lookups, runs, running totals.

Everything here is built on one primitive, :func:`scan`.  A scan answers, for each
row of a timeline, "what was the last / next / total so far".  With few rows per key
that is one window per key.  When the busiest key is too big for a task, the time
axis is cut at quantiles so that no (key, segment) pair holds more than a bounded
share of the table, the window runs inside each pair, and a small table of segment
summaries carries values across the cuts.  Either way the big table is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut_lineage

SEG = "__seg"
MAX_ROWS_PER_TASK = 2_000_000
MAX_VALUES_PER_TASK = 200_000
MAX_SEGMENTS = 4096
INLINE_CUTS = 32
MAX_PLAN_NODES = 150
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Timeline:
    """Key columns, an integer time column, tie breakers, and the cuts of the time axis."""

    keys: tuple[str, ...]
    time: str
    tie: tuple[str, ...] = ()
    cuts: tuple[float, ...] = ()

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tie]

    def by(self, *keys: str) -> "Timeline":
        """Same axis, other keys (a finer key only makes groups smaller)."""
        return replace(self, keys=keys)

    def on(self, time: str, *tie: str) -> "Timeline":
        return replace(self, time=time, tie=tie)

    def with_segment(self, df: DataFrame) -> DataFrame:
        if not self.cuts:
            return df
        if len(self.cuts) <= INLINE_CUTS:
            seg = sum(((F.col(self.time) >= c).cast("int") for c in self.cuts), F.lit(0))
            return df.withColumn(SEG, seg)
        splits = [-float("inf"), *self.cuts, float("inf")]
        tagged = df.withColumn("__t", F.col(self.time).cast("double"))
        return (
            Bucketizer(splits=splits, inputCol="__t", outputCol=SEG)
            .transform(tagged)
            .withColumn(SEG, F.col(SEG).cast("int"))
            .drop("__t")
        )


def fit_timeline(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_TASK,
) -> Timeline:
    """Measure the busiest key and cut the time axis only if it is too big for a task.

    Both probes are map-side combined aggregates; at most ``MAX_SEGMENTS`` numbers
    reach the driver.  Cuts are table-wide quantiles of the time column, so a segment
    holds about 1/n of all rows whatever share one key has.
    """
    busiest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if busiest <= max_rows:
        return Timeline(tuple(keys), time, tuple(tie))
    n = min(MAX_SEGMENTS, -(-busiest // max_rows) * 2)
    probs = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(F.col(time), probs, 4 * n)).first()[0]
    return Timeline(tuple(keys), time, tuple(tie), tuple(sorted(set(float(c) for c in cuts))))


@dataclass(frozen=True)
class Spec:
    kind: str
    value: Column
    when: Column | None = None
    inclusive: bool = True


def prev(value: Column, when: Column | None = None, inclusive: bool = False) -> Spec:
    """Last value at an earlier row (or this one, if inclusive); a null value counts."""
    return Spec("prev", value, when, inclusive)


def nxt(value: Column, when: Column | None = None, inclusive: bool = False) -> Spec:
    """First value at a later row (or this one, if inclusive); a null value counts."""
    return Spec("next", value, when, inclusive)


def total(value: Column) -> Spec:
    """Running sum over all rows up to and including this one."""
    return Spec("sum", value)


def total_at(value: Column) -> Spec:
    """Running sum that includes every row sharing this row's time."""
    return Spec("peersum", value)


def folded_at(fold: str, value: Column, ahead: bool = False) -> Spec:
    """Running ``sum``, ``min`` or ``max`` up to this row, or from it on if ``ahead``; rows of its time belong to it."""
    return Spec(f"peer{fold}{'ahead' if ahead else ''}", value)


def highest(value: Column) -> Spec:
    """Running maximum up to and including this row."""
    return Spec("max", value)


def lowest(value: Column) -> Spec:
    """Running minimum up to and including this row."""
    return Spec("min", value)


def lowest_ahead(value: Column) -> Spec:
    """Minimum from this row on."""
    return Spec("minahead", value)


def plan_nodes(df: DataFrame) -> int:
    return df._jdf.queryExecution().analyzed().treeString().count("\n")


def scan(df: DataFrame, tl: Timeline, **specs: Spec) -> DataFrame:
    """Add one column per spec; the frame is shuffled once by (keys, segment).

    A segmented scan reads its input twice (rows and summaries), so a chain of them would
    double the plan at every step; a plan that has grown long is checkpointed first.
    """
    seg = [SEG] if tl.cuts else []
    if seg and plan_nodes(df) > MAX_PLAN_NODES:
        df = cut_lineage(df)
    part = [*tl.keys, *seg]
    out = tl.with_segment(df)
    up = Window.partitionBy(*part).orderBy(*tl.order)
    down = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in tl.order])
    order = F.struct(*tl.order)

    carried: dict[str, Column] = {}
    local: dict[str, Column] = {}
    for name, s in specs.items():
        if s.kind in ("prev", "next"):
            boxed = F.struct(s.value.alias("v"))
            if s.when is not None:
                boxed = F.when(s.when, boxed)
            at = F.when(boxed.isNotNull(), order)
            win = up if s.kind == "prev" else down
            frame = win.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
            if s.when is None and not s.inclusive:
                # the neighbour itself: one sort order serves both directions, and a chain of scans keeps it
                local[name] = (F.lag if s.kind == "prev" else F.lead)(boxed).over(up)
            else:
                local[name] = F.last(boxed, ignorenulls=True).over(frame)
            carried[name] = F.max_by(boxed, at) if s.kind == "prev" else F.min_by(boxed, at)
        elif s.kind == "max":
            local[name] = F.max(s.value).over(up.rowsBetween(Window.unboundedPreceding, 0))
            carried[name] = F.max(s.value)
        elif s.kind in ("min", "minahead"):
            win = up if s.kind == "min" else down
            local[name] = F.min(s.value).over(win.rowsBetween(Window.unboundedPreceding, 0))
            carried[name] = F.min(s.value)
        elif s.kind.startswith("peer"):
            fold = FOLDS[s.kind[4:7]]
            at = F.col(tl.time).desc() if s.kind.endswith("ahead") else F.col(tl.time)
            local[name] = fold(s.value).over(Window.partitionBy(*part).orderBy(at).rangeBetween(Window.unboundedPreceding, 0))
            carried[name] = fold(s.value)
        else:
            local[name] = F.sum(s.value).over(up.rowsBetween(Window.unboundedPreceding, 0))
            carried[name] = F.sum(s.value)

    if not seg:
        return out.withColumns({n: c["v"] if specs[n].kind in ("prev", "next") else c for n, c in local.items()})

    past = Window.partitionBy(*tl.keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*tl.keys).orderBy(F.col(SEG).desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = out.groupBy(*part).agg(*[c.alias(f"__c_{n}") for n, c in carried.items()])
    carry_cols = []
    for name, s in specs.items():
        c = F.col(f"__c_{name}")
        if s.kind in ("prev", "next"):
            over = F.last(c, ignorenulls=True).over(past if s.kind == "prev" else future)
        else:
            over = FOLDS[s.kind.removeprefix("peer")[:3]](c).over(future if s.kind.endswith("ahead") else past)
        carry_cols.append(over.alias(f"__k_{name}"))
    carry = summary.select(*[F.col(c).alias(f"__p_{i}") for i, c in enumerate(part)], *carry_cols)

    # a null key is a key like any other, as it is to a window
    same = [F.col(c).eqNullSafe(F.col(f"__p_{i}")) for i, c in enumerate(part)]
    out = out.withColumns(local).join(carry, reduce(and_, same), "left").drop(*[f"__p_{i}" for i in range(len(part))])
    final = {}
    for name, s in specs.items():
        mine, before = F.col(name), F.col(f"__k_{name}")
        if s.kind in ("prev", "next"):
            final[name] = F.coalesce(mine, before)["v"]
        elif "max" in s.kind:
            final[name] = F.greatest(mine, before)
        elif "min" in s.kind:
            final[name] = F.least(mine, before)
        else:
            final[name] = F.when(mine.isNull() & before.isNull(), None).otherwise(
                F.coalesce(mine, F.lit(0)) + F.coalesce(before, F.lit(0))
            )
    return out.withColumns(final).drop(SEG, *[f"__k_{n}" for n in specs])


def row_index(df: DataFrame, tl: Timeline, name: str) -> DataFrame:
    """1-based position of each row on its timeline."""
    return scan(df, tl, **{name: total(F.lit(1).cast("bigint"))})


def asof_join(
    left: DataFrame,
    right: DataFrame,
    tl: Timeline,
    value: Column,
    name: str,
    direction: str = "backward",
    tolerance: int | None = None,
) -> DataFrame:
    """Attach ``value`` of the nearest right row in time to every left row.

    Both sides share ``tl.keys`` and ``tl.time``.  backward: right time <= left time,
    forward: right time >= left time, nearest: the closer one, the earlier on a tie.
    The two sides are stacked and scanned, so the cost is linear and no pair of rows
    is ever enumerated.  ``<name>_t`` is the matched right time.  Among equal right
    times the greatest value is taken looking back, the least looking ahead.
    """
    lcols = left.columns
    want_back = direction in ("backward", "nearest")
    want_fwd = direction in ("forward", "nearest")
    # rank puts a right row before a left row of equal time when looking back, after it when looking ahead
    ranks = ([0] if want_back else []) + ([2] if want_fwd else [])
    rank = F.explode(F.array(*map(F.lit, ranks))) if len(ranks) > 1 else F.lit(ranks[0])
    none = F.lit(None)
    box = F.struct(F.col(tl.time).alias("t"), value.alias("v"))
    rights = right.select(*tl.keys, tl.time, rank.alias("__rank"), box.alias("__r"), none.alias("__l"))
    probes = left.select(*tl.keys, tl.time, F.lit(1).alias("__rank"), none.alias("__r"), F.struct(*lcols).alias("__l"))
    axis = tl.on(tl.time, "__rank", "__r")
    r = F.col("__r")
    specs = {}
    if want_back:
        specs["__b"] = prev(r, when=F.col("__rank") == 0)
    if want_fwd:
        specs["__f"] = nxt(r, when=F.col("__rank") == 2)
    got = scan(rights.union(probes), axis, **specs).where(F.col("__rank") == 1)
    t = F.col(f"__l.{tl.time}")
    back_gap = (t - F.col("__b.t")) if want_back else None
    fwd_gap = (F.col("__f.t") - t) if want_fwd else None
    if direction == "backward":
        hit, gap = F.col("__b"), back_gap
    elif direction == "forward":
        hit, gap = F.col("__f"), fwd_gap
    else:
        use_fwd = F.col("__b").isNull() | (fwd_gap < back_gap)
        hit = F.when(use_fwd, F.col("__f")).otherwise(F.col("__b"))
        gap = F.when(use_fwd, fwd_gap).otherwise(back_gap)
    if tolerance is not None:
        hit = F.when(gap <= tolerance, hit)
    return got.select(
        *[F.col(f"__l.{c}").alias(c) for c in lcols], hit["v"].alias(name), hit["t"].alias(f"{name}_t")
    )


def window_stats(df: DataFrame, tl: Timeline, width: int, value: Column, prefix: str, measures: Sequence[str] = ("sum", "n"), ahead: bool = False) -> DataFrame:
    """``sum``, ``n``, ``min`` and ``max`` of ``value`` over (t - width, t], or over [t, t + width) if ``ahead``.

    Time is cut into blocks as long as the window, so every window is one end of its row's block and the other end of a
    neighbour: running folds from both ends of the blocks, one lookup, and no row is ever subtracted. An infinite value
    or a rounding residue leaves with its row, and the work does not depend on how many rows a window holds. Null and
    not-a-number count as missing; the sum of a window without values is null.
    """
    cols, t = df.columns, F.col(tl.time)
    v = value.cast("double")
    v = F.when(~F.isnan(v), v)
    folds = {"sum": ("sum", v), "n": ("sum", v.isNotNull().cast("bigint")), "min": ("min", v), "max": ("max", v)}
    d = df.withColumn("__blk", F.floor(t / width))
    ends = {f"__{way}_{m}": folded_at(folds[m][0], folds[m][1], way == "down") for m in measures for way in ("up", "down")}
    d = scan(d, tl.by(*tl.keys, "__blk").on(tl.time), **ends)
    own, far = ("down", "up") if ahead else ("up", "down")
    moved = d.select(*cols, "__blk", *[f"__{own}_{m}" for m in measures], t.alias("__at")).withColumn(tl.time, t + (width - 1 if ahead else 1 - width))
    box = F.struct("__blk", *[f"__{far}_{m}" for m in measures])
    got = asof_join(moved, d, tl, box, "__far", "backward" if ahead else "forward")
    next_to = F.col("__far.__blk") == F.col("__blk") + (1 if ahead else -1)
    out = []
    for m in measures:
        mine, other = F.col(f"__{own}_{m}"), F.when(next_to, F.col(f"__far.__{far}_{m}"))
        if m in ("min", "max"):
            both = (F.least if m == "min" else F.greatest)(mine, other)
        else:
            both = F.coalesce(mine + other, mine, other)
        out.append(both.alias(f"{prefix}_{m}"))
    return got.withColumn(tl.time, F.col("__at")).select(*cols, *out)


def trailing(df: DataFrame, tl: Timeline, width: int, value: Column, prefix: str) -> DataFrame:
    """Sum (0 if there is nothing) and count of ``value`` over the half-open window (t - width, t]; see :func:`window_stats`."""
    return window_stats(df, tl, width, value, prefix).withColumn(f"{prefix}_sum", F.coalesce(f"{prefix}_sum", F.lit(0.0)))


def window_lowest(probes: DataFrame, points: DataFrame, tl: Timeline, half: int, value: Column, name: str) -> DataFrame:
    """Smallest ``value`` among the points within ``half`` of each probe, both ends included.

    Time is cut into blocks as long as the window, so every window is the end of one block
    plus the start of the next: two lookups of running minima instead of all pairs.
    """
    width, t = 2 * half, F.col(tl.time)
    block = lambda c: F.floor(c / width)
    p = points.select(*tl.keys, tl.time, value.alias("v")).withColumn("__blk", block(t))
    p = scan(p, tl.by(*tl.keys, "__blk").on(tl.time), head=lowest(F.col("v")), tail=lowest_ahead(F.col("v")))
    back = probes.columns
    p = p.groupBy(*tl.keys, "__blk", tl.time).agg(F.min("head").alias("head"), F.min("tail").alias("tail"))  # points of one time
    for shift, side, way in ((-half, "tail", "forward"), (half, "head", "backward")):
        moved = probes.withColumn("__at", t).withColumn(tl.time, t + shift)
        got = asof_join(moved, p, tl, F.struct("__blk", F.col(side).alias("v")), f"__{side}", way)
        found = F.when(F.col(f"__{side}.__blk") == block(t), F.col(f"__{side}.v"))
        probes = got.withColumn(f"__{side}", found).withColumn(tl.time, F.col("__at")).drop("__at", f"__{side}_t")
    return probes.select(*back, F.array_min(F.array("__tail", "__head")).alias(name))


def runs(df: DataFrame, tl: Timeline, state: Column, *aggs: Column, name: str = "state") -> DataFrame:
    """Maximal stretches of equal state: one row per run with start, end, n and extra aggregates."""
    d = df.withColumn(name, state)
    d = scan(d, tl, __was=prev(F.struct(F.col(name).alias("s"))))
    changed = F.col("__was").isNull() | ~F.col(name).eqNullSafe(F.col("__was.s"))
    d = scan(d, tl, __run=prev(F.struct(*tl.order), when=changed, inclusive=True))
    return (
        d.groupBy(*tl.keys, "__run", name)
        .agg(
            F.min(tl.time).alias("start"),
            F.max(tl.time).alias("end"),
            F.count(F.lit(1)).alias("n"),
            *aggs,
        )
        .drop("__run")
    )


def merge_gaps(rs: DataFrame, tl: Timeline, max_gap: int, strict: bool, *aggs: Column) -> DataFrame:
    """Join runs (already of one state per key) whose pause is below ``max_gap``; runs must not overlap."""
    axis = tl.on("start")
    d = scan(rs, axis, __pe=prev(F.col("end")))
    gap = F.col("start") - F.col("__pe")
    fresh = F.col("__pe").isNull() | ((gap >= max_gap) if strict else (gap > max_gap))
    d = scan(d, axis, __head=prev(F.col("start"), when=fresh, inclusive=True))
    return (
        d.groupBy(*tl.keys, "__head")
        .agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("parts"), *aggs)
        .withColumnRenamed("__head", "start")
    )


def absorb_short_runs(rs: DataFrame, tl: Timeline, state: str, length: Column, minimum: int, keep_last: bool) -> DataFrame:
    """Spells after runs shorter than ``minimum`` have joined the spell before them.

    The first run of a key is always kept; with ``keep_last`` so is the final one, which
    is also what repeated absorption between two equal neighbours leaves when two states
    alternate (tested against that definition).
    """
    axis = tl.on("start")
    d = scan(rs, axis, __before=prev(F.col("start")), __after=nxt(F.col("start")))
    anchor = (length >= minimum) | F.col("__before").isNull()
    if keep_last:
        anchor = anchor | F.col("__after").isNull()
    d = d.withColumn("__anchor", anchor)
    d = scan(d, axis, __held=prev(F.col(state), when=F.col("__anchor")))
    fresh = F.col("__anchor") & (F.col("__before").isNull() | (F.col(state) != F.col("__held")))
    d = scan(d, axis, __head=prev(F.struct("start", F.col(state).alias("s")), when=fresh, inclusive=True))
    return (
        d.groupBy(*tl.keys, "__head")
        .agg(F.max("end").alias("end"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
        .select(*tl.keys, F.col("__head.s").alias(state), F.col("__head.start").alias("start"), "end", "n", "parts")
    )


def lerp_fill(df: DataFrame, tl: Timeline, value: str, max_gap: int, out: str, strict: bool = False) -> DataFrame:
    """Linear interpolation of the null values between known neighbours at most ``max_gap`` apart.

    Known samples stay; with ``strict`` the sample opening an over-long gap is dropped too.
    """
    known = F.col(value).isNotNull()
    pt = F.struct(F.col(tl.time).alias("t"), F.col(value).alias("v"))
    d = scan(df, tl, __a=prev(pt, when=known, inclusive=True), __b=nxt(pt, when=known))
    span = F.col("__b.t") - F.col("__a.t")
    frac = (F.col(tl.time) - F.col("__a.t")) / span
    mid = F.when(span <= max_gap, F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * frac)
    keep = known & (~(span > max_gap) | span.isNull()) if strict else known
    filled = F.when(keep, F.col(value)).when(~known, mid)
    return d.withColumn(out, filled).drop("__a", "__b")


def spell_before(rs: DataFrame, tl: Timeline, state: str, length: Column, minimum: int, *first: str, tie: Sequence[str] = ()) -> DataFrame:
    """For each run, the spell that was current just before it: struct ``before`` of (state, start, *first*).

    ``tie`` orders runs that start at the same time.
    """
    axis = tl.on("start", *tie)
    d = scan(rs, axis, __b=prev(F.col("start")))
    d = d.withColumn("__anchor", (length >= minimum) | F.col("__b").isNull())
    d = scan(d, axis, __held=prev(F.col(state), when=F.col("__anchor")))
    fresh = F.col("__anchor") & (F.col("__b").isNull() | (F.col(state) != F.col("__held")))
    head = F.struct(F.col(state), F.col("start"), *[F.col(c) for c in first])
    return scan(d, axis, before=prev(head, when=fresh)).drop("__b", "__anchor", "__held")


def grouped_percentile(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bounded: bool = False, stored: bool = False) -> DataFrame:
    """Exact, linearly interpolated percentiles per key.

    Values are counted first, so equal ones cost one row.  With ``bounded`` they have a fixed
    measuring resolution, and a key's counts fit a task.  Otherwise the busiest key's distinct
    values are measured: if they are few they are aggregated in a task, whose memory holds them
    all; if not, ranks come from a segmented scan along the value axis, which holds none.  Rows that
    are dear to make are made once if the counts are ``stored``, not for the measuring and again.
    """
    known = df.where(F.col(value).isNotNull())
    names, ps = list(probs), list(probs.values())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    if stored:
        counts = cut_lineage(counts)
    tl = None if bounded else fit_timeline(counts, keys, value, max_rows=MAX_VALUES_PER_TASK)
    if bounded or not tl.cuts:
        got = counts.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, ps)), F.col("__n")).alias("__p"))
        return got.select(*keys, *[F.get("__p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return ranked_percentile(counts, tl, value, probs)


def ranked_percentile(counts: DataFrame, tl: Timeline, value: str, probs: dict[str, float]) -> DataFrame:
    keys = list(tl.keys)
    ranked = scan(counts, tl, __cum=total(F.col("__n")))
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    d = ranked.join(sizes, keys)
    picks = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("__all") - 1)
        for end, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("__cum") > at) & (F.col("__cum") - F.col("__n") <= at)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"__{name}_{end}"))
    got = d.groupBy(*keys).agg(F.first("__all").alias("__all"), *picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("__all") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, *out)
