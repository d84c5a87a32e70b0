"""Match-play views over any event feed: what the ball was doing, presses, turnovers, chances, settling, board.

A ``Feed`` holds the events of many matches as a DataFrame with these columns (others are carried along):

``match_id, event_id``   which match, and an id that orders events of one moment
``user_id``              the player
``team``                 0 home, 1 away; the home side attacks towards +x in every period
``kind``                 OTB on the ball, PA pass, CH challenge, SH shot, OUT ball out
``period, clock_us``     period, and microseconds on one clock that runs through the match
``end_us``               when the touch ends
``x, y``                 metres from the centre spot
``pressed``              whether the player on the ball is under pressure

Every view is a function of a feed and of its own thresholds, so the same code serves a table, a set of files or a
single match (``feed.only(match)``).  Rows without a team or a clock should be left out by whoever builds the feed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators import play
from touchline.operators.timeline import (
    Timeline, asof_join, fit_timeline, grouped_percentile, merge_gaps, nxt, prev, runs, scan, spell_before, total,
)
from touchline.session import cut_lineage

S = play.SECOND
COLUMNS = ("match_id", "event_id", "user_id", "team", "kind", "period", "clock_us", "end_us", "x", "y", "pressed")
SIDE = ("match_id", "team")


def _long(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("bigint")


def _rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


@dataclass
class Feed:
    """Events and the time axis they are ordered on.  ``axis`` is measured from the rows if it is not given."""

    rows: DataFrame
    axis: Timeline | None = None
    gap: int = 30 * S    # play goes on if the next touch starts within this time of the last one's end
    tail: int = 1500000  # otherwise it goes on for this long

    def __post_init__(self) -> None:
        lacking = [c for c in COLUMNS if c not in self.rows.columns]
        if lacking:
            raise ValueError(f"a feed needs the columns {', '.join(lacking)}")
        if self.axis is None:
            self.axis = fit_timeline(self.rows, ["match_id"], "clock_us", ["event_id"])

    @cached_property
    def live(self) -> DataFrame:
        """The rows with ``live``: whether the ball is in play."""
        return play.live_flags(self.rows, self.axis, F.col("end_us"), self.gap, self.tail)

    def only(self, match) -> "Feed":
        """The feed of one match."""
        return Feed(self.rows.where(F.col("match_id") == F.lit(match)), None, self.gap, self.tail)

    def kept(self, *also: str) -> "Feed":
        """The same feed with its rows, columns ``also`` and live flags stored once, for several views of one expensive source."""
        slim = Feed(self.rows.select(*COLUMNS, *also), self.axis, self.gap, self.tail)
        stored = Feed(cut_lineage(slim.live), self.axis, self.gap, self.tail)
        stored.__dict__["live"] = stored.rows
        stored.rows = stored.rows.select(*COLUMNS, *also)
        return stored

    def opened(self, rows: int = 3) -> DataFrame:
        """Live rows plus ``open``: the ball live on the last ``rows`` rows, and not over a goal line."""
        d = scan(self.live, self.axis, i=total(_long(1)))
        d = scan(d, self.axis, dead=prev(F.col("i"), when=~F.col("live")))
        ok = (F.col("i") > rows) & (F.abs("x") <= 52.4) & (F.col("dead").isNull() | (F.col("i") - F.col("dead") > rows))
        return d.withColumn("open", ok)

    def losses(self) -> DataFrame:
        """On-ball events of another team than the one before: ``loser`` and ``winner``."""
        o = scan(self.rows.where(F.col("kind") == "OTB"), self.axis, was=prev(F.col("team")))
        return o.where(F.col("was") != F.col("team")).withColumn("loser", F.col("was")).withColumn("winner", F.col("team"))


def match_runs(d: DataFrame, tl: Timeline) -> DataFrame:
    """Runs of one team with their first event: its id ``head`` orders runs that start at the same time."""
    first = F.min_by(F.struct("event_id", "x", "y", "open", "period"), F.struct("clock_us", "event_id"))
    return runs(d, tl, F.col("team"), first.alias("first"), name="team").withColumn("head", F.col("first.event_id"))


def settling(
    feed: Feed, step: int = 5 * S, cap: int = 100 * S, reference: int = 15 * S, depth: float = 15.0, lane: float = 12.0, share: float = 0.85
) -> DataFrame:
    """Time after each loss until the shape stays near where it ends up.

    A loss is probed on a short fixed grid, each probe takes the nearest reading within ``step``, and the shape has
    settled at the first point from which on ``share`` of the readings lie within ``depth`` and ``lane`` of the mean of
    the last ``reference``.  The grid ends at ``cap`` or at the same team's next loss.
    """
    tl = feed.axis
    ls = feed.losses().select("match_id", F.col("event_id").alias("loss_id"), F.col("clock_us").alias("t0"), F.col("loser").alias("dteam"))
    ls = scan(ls, tl.by("match_id", "dteam").on("t0"), nx=nxt(F.col("t0")))
    room = F.least(F.lit(cap), F.coalesce(F.col("nx") - F.col("t0"), F.lit(cap)))
    probes = ls.withColumn("rel", F.explode(F.sequence(F.lit(0), room, F.lit(step)))).withColumn("clock_us", F.col("t0") + F.col("rel"))
    reads = feed.rows.select("match_id", "clock_us", "x", F.abs("y").alias("l"))
    got = asof_join(
        probes.select("match_id", "loss_id", "rel", "clock_us"), reads, tl, F.struct(F.col("x").alias("d"), "l"), "m", "nearest", step
    ).where(F.col("m").isNotNull())
    one = Window.partitionBy("match_id", "loss_id")
    rest = one.orderBy("rel").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    got = got.withColumn("mx", F.max("rel").over(one))
    late = F.col("rel") >= F.col("mx") - reference
    got = got.withColumn("rd", F.avg(F.when(late, F.col("m.d"))).over(one)).withColumn("rl", F.avg(F.when(late, F.col("m.l"))).over(one))
    fd = F.avg((F.abs(F.col("m.d") - F.col("rd")) <= depth).cast("int")).over(rest)
    fl = F.avg((F.abs(F.col("m.l") - F.col("rl")) <= lane).cast("int")).over(rest)
    got = got.withColumn("good", (fd >= share) & (fl >= share))
    st = got.groupBy("match_id", "loss_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("good"), F.col("rel"))).alias("at"), F.max("rel").alias("mx")
    )
    d = ls.drop("nx").join(st, ["match_id", "loss_id"], "left")
    enough = F.coalesce(F.col("n") >= 2, F.lit(False))
    dur = F.when(~enough, 0).otherwise(F.coalesce("at", "mx"))
    return d.select("match_id", "loss_id", "t0", "dteam", _long(dur).alias("dur_us"), (enough & F.col("at").isNotNull()).alias("settled"))


def turnovers(feed: Feed, minimum: int = 5 * S, attack: int = 30 * S, shot_within: int = 45 * S) -> DataFrame:
    """Open-play ball wins: where, whether they reached the last third within ``attack``, and whether a shot followed."""
    tl = feed.axis
    d = feed.opened()
    # spells: fresh anchors of the run table, numbered along the match
    b = spell_before(match_runs(d, tl), tl, "team", F.col("end") - F.col("start"), minimum, tie=["head"])
    fresh = F.col("before").isNull() | ((F.col("end") - F.col("start") >= minimum) & (F.col("before.team") != F.col("team")))
    sp = b.where(fresh).select("match_id", "head", "team", "start", "first", F.col("before").isNull().alias("opening"))
    rows = d.select("match_id", "clock_us", "x")
    spell = F.struct("head", "team", "start", "first", "opening")
    hit = asof_join(rows, sp.withColumn("clock_us", F.col("start")), tl, spell, "sp")
    own_x = F.col("x") * P.flip(F.col("sp.team"))
    ahead = F.max(F.when(F.col("clock_us") < F.col("sp.start") + attack, own_x))
    won = (
        hit.where(F.col("sp").isNotNull() & ~F.col("sp.opening") & F.col("sp.first.open"))
        .groupBy("match_id", "sp.team", "sp.start", "sp.first")
        .agg(ahead.alias("ahead"))
        .withColumn("clock_us", F.col("start"))
    )
    shots = feed.rows.where(F.col("kind") == "SH").select("match_id", "team", "clock_us")
    won = asof_join(won, shots, tl.by(*SIDE), F.lit(1), "shot", "forward", shot_within)
    f = P.flip(F.col("team"))
    return won.select(
        "match_id", "team", "start", F.col("first.period").alias("period"), (F.col("first.x") * f).alias("x"), (F.col("first.y") * f).alias("y"),
        (F.col("ahead") > P.THIRD_X).alias("fast"), F.col("shot").isNotNull().alias("shot"),
    )


def presses(feed: Feed, merge: int = 10 * S, minimum: int = 333333, win: int = 15 * S, counter: int = 10 * S, fresh_pass: int = 20 * S) -> DataFrame:
    """Presses with what set them off and whether they won the ball within ``win``.

    Everything a press start needs to know is looked up once per row in a single scan; the
    run aggregation then keeps the first row's answers.
    """
    tl = feed.axis
    t, team = F.col("clock_us"), F.col("team")
    pas = F.struct(t.alias("t"), F.col("x"))
    d = scan(
        feed.live, tl,
        p0=prev(t, when=team == 0), p1=prev(t, when=team == 1), n0=nxt(t, when=team == 0), n1=nxt(t, when=team == 1),
        q0=prev(pas, when=(team == 0) & (F.col("kind") == "PA"), inclusive=True),
        q1=prev(pas, when=(team == 1) & (F.col("kind") == "PA"), inclusive=True),
    )
    pteam = F.when(F.col("live") & F.col("pressed"), 1 - team)
    mine, theirs = F.when(team == 1, F.col("p0")).otherwise(F.col("p1")), F.when(team == 0, F.col("q0")).otherwise(F.col("q1"))
    back = F.when(team == 1, F.col("n0")).otherwise(F.col("n1"))
    facts = F.struct(F.col("user_id"), F.col("x"), F.col("y"), mine.alias("own"), theirs.alias("pas"), back.alias("back"))
    first = F.min_by(facts, F.struct("clock_us", "event_id")).alias("f")
    rs = runs(d, tl, pteam, first, name="pteam").where(F.col("pteam").isNotNull())
    keyed = tl.by("match_id", "pteam")
    m = merge_gaps(rs, keyed, merge, True, F.min_by("f", "start").alias("f")).where(F.col("end") - F.col("start") >= minimum)
    flip = P.flip(F.col("pteam"))
    s = F.col("start")
    carrier = F.when(F.col("pteam") == 1, 1).otherwise(-1)
    trigger = (
        F.when(s - F.col("f.own") <= counter, "counter-press")
        .when(F.col("f.pas").isNull() | (s - F.col("f.pas.t") > fresh_pass), "carry or first touch")
        .when((F.col("f.x") - F.col("f.pas.x")) * carrier < -2, "back pass")
        .when(F.abs("f.y") > 20.16, "pass out wide")
        .otherwise("other pass")
    )
    return m.select(
        "match_id", F.col("pteam").alias("team"), "start", "end", F.col("f.user_id").alias("presser"), (F.col("f.x") * flip).alias("x"), (F.col("f.y") * flip).alias("y"),
        F.coalesce(F.col("f.back") - s <= win, F.lit(False)).alias("won"), trigger.alias("trigger"),
    )


def chances(feed: Feed, minimum: int = 5 * S, longest: int = 20 * S) -> DataFrame:
    """Every shot traced back to where its attack began, ``longest`` before it at most, with the passes in between.

    The possession spell before a shot is the state of the spell automaton just before the
    run the shot falls in, corrected for that run being cut at the shot. Events of one time are in the order of their ids,
    so of several runs that start at one time the shot falls in the last.
    """
    tl = feed.axis
    d = scan(feed.opened(), tl, was=prev(F.col("live")))
    b = spell_before(match_runs(d, tl), tl, "team", F.col("end") - F.col("start"), minimum, "first", tie=["head"]).withColumn("clock_us", F.col("start"))
    shots = d.where(F.col("kind") == "SH").select("match_id", "event_id", "team", "period", F.col("clock_us").alias("t"))
    run = F.struct("head", "team", "start", "end", "first", "before")
    j = asof_join(shots.withColumn("clock_us", F.col("t") - 1), b, tl, run, "run").where(F.col("run").isNotNull())
    starts = d.where(F.col("live") & ~F.col("was")).select("match_id", "clock_us")
    j = asof_join(j.withColumn("clock_us", F.col("t")).drop("run_t"), starts, tl, F.lit(1), "rs")
    t, team, before = F.col("t"), F.col("team"), F.col("run.before")
    cut_short = F.least(F.col("run.end"), t - 1) - F.col("run.start") < minimum
    keep = before.isNotNull() & ((cut_short & (F.col("run.team") != team)) | (before["team"] == F.col("run.team")))
    holder = F.when(keep, F.struct(before["team"].alias("team"), before["start"].alias("s"), before["first"].alias("f"))).otherwise(
        F.struct(F.col("run.team").alias("team"), F.col("run.start").alias("s"), F.col("run.first").alias("f"))
    )
    j = j.withColumn("h", holder).withColumn("mine", F.col("h.team") == team)
    j = j.withColumn("own", F.when(F.col("mine"), F.col("h.s")).otherwise(t)).withColumn("rst", F.coalesce("rs_t", _long(-1)))
    j = j.withColumn("start", F.greatest("own", "rst", t - longest))
    won = (F.col("rst") != F.col("start")) & (F.col("own") == F.col("start")) & (~F.col("mine") | F.col("h.f.open"))
    kind = F.when(F.col("rst") == F.col("start"), "restart").when(won, "turnover").otherwise("long")
    zone = F.when(won & F.col("mine"), P.third(F.col("h.f.x") * P.flip(team)))
    j = j.select("match_id", "event_id", "team", "period", "t", "start", kind.alias("kind"), zone.alias("third"))
    side = tl.by(*SIDE)
    passes = scan(feed.rows.where(F.col("kind") == "PA"), side, n=total(_long(1))).select("match_id", "team", "clock_us", "n")
    for at, name in (("t", "upto"), ("start", "since")):
        j = asof_join(j.withColumn("clock_us", F.col(at) - 1), passes, side, F.col("n"), name).drop(f"{name}_t", "clock_us")
    return j.withColumn("passes", F.coalesce("upto", _long(0)) - F.coalesce("since", _long(0))).drop("upto", "since")


def board(feed: Feed, minutes_per_row: float = 6 / 29.97 / 60, keys: Sequence[str] = SIDE) -> DataFrame:
    """One row per team and match, joined from the views' summaries."""
    k = list(keys)
    n = F.count_if("live")
    lp = feed.live.groupBy("match_id").agg(
        _rounded(n * minutes_per_row).alias("live_min"), (100.0 * F.count_if(F.col("live") & (F.col("team") == 0)) / F.greatest(n, _long(1))).alias("home_pct")
    )
    own = feed.rows.select(*k, "kind", (F.col("x") * P.flip(F.col("team"))).alias("ox"))
    line = grouped_percentile(own, k, "ox", {"line": 0.5})
    sh = own.groupBy(*k).agg(F.count_if(F.col("kind") == "SH").alias("shots")).join(line, k)
    other = sh.select("match_id", (1 - F.col("team")).alias("team"), F.col("shots").alias("against"))
    t = turnovers(feed).groupBy(*k).agg(
        F.count(F.lit(1)).alias("w"), _rounded(100.0 * F.count_if(F.col("x") >= 0) / F.count(F.lit(1))).alias("wins_high"), F.count_if("fast").alias("f")
    )
    p = presses(feed).groupBy(*k).agg(_rounded(100.0 * F.count_if("won") / F.count(F.lit(1))).alias("press_won"))
    z = _long(0)
    return (
        sh.join(other, k, "left").join(lp, "match_id").join(t, k, "left").join(p, k, "left").select(
            *k, (1 - F.col("team")).alias("opp"), _rounded(F.when(F.col("team") == 0, F.col("home_pct")).otherwise(100 - F.col("home_pct"))).alias("possession"),
            _rounded(F.col("line") + P.LENGTH / 2).alias("back_line"), F.coalesce("w", z).alias("wins"), "wins_high", F.coalesce("f", z).alias("fast"),
            F.col("shots").alias("shots_for"), F.coalesce("against", z).alias("shots_against"), "live_min", "press_won",
        )
    )
