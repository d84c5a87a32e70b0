"""Conversations brought to the grammar (s?(ua)+)? by the cheapest edits of their turns.

Turns are aligned with the alternating string of every feasible length, by the recurrence of Wagner and Fischer. Strings
that end alike are suffixes of one another, so one matrix over (turns left, target left) holds them all; a cell whose
least possible cost is above that of a script known beforehand is never filled (Ukkonen's band). Of the cheapest scripts
the one with the least string of edits is traced back, over all lengths at once.

A conversation of more than ``PIECE`` turns is aligned piece by piece, for every role that the output may stand at before
and after a piece, and the pieces' tables are joined. That gives the same script: two scripts of equal cost for the same
turns are never one a prefix of the other, as what one has more would be inserts, which cost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.ordered import digests, with_places
from touchline.llm.tables import written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
PIECE, FAN_IN = 256, 64
#: Patterns of turns that a Python worker remembers, and their greatest length.
REMEMBERED, SHORT = 20_000, 64
GAPS = " \t\n\x0b\x0c\r"
#: Where the output stands: nothing yet, after s, after u, after a; it may end at the first and the last.
START, S, U, A = range(4)
NONE = 1 << 40

Script = tuple[int, str]
Table = dict[tuple[int, int], Script]


def _first(t: int, last: str) -> str:
    """The first role of an alternating string of ``t`` turns that ends in ``last``."""
    return last if t % 2 else ("u" if last == "a" else "a")


class Alignment:
    """Turns aligned with all alternating strings that end in ``last``.

    A turn is a letter: s, u, a or o for its role, upper case where the text is truncated, x where it must be deleted.
    ``left[i, t]`` is the least cost for turns i, ... and a target of t turns; ``system[i, t]`` the same with an s before it.
    """

    def __init__(self, turns: str, last: str):
        self.turns, self.last = turns, last
        n, usable = len(turns), [0]
        for c in reversed(turns):
            usable.append(usable[-1] + (c != "x"))
        usable.reverse()
        bound = self._bound(usable[0])
        self.width = usable[0] + bound // INSERT + 1
        t = np.arange(self.width)
        starts = np.array([_first(k, last) for k in range(self.width)])
        self.left = np.full((n + 1, self.width), NONE, np.int64)
        self.system = np.full((n + 1, self.width), NONE, np.int64)
        for i in range(n, -1, -1):
            row = np.full(self.width, NONE, np.int64)
            if i == n:
                row[0] = 0
            else:
                c = turns[i]
                row = self.left[i + 1] + DELETE
                self.system[i] = self.system[i + 1] + DELETE
                if c != "x":
                    cost = c.isupper() * TRUNCATED
                    matched = self.left[i + 1, :-1] + cost + np.where(starts[1:] == c.lower(), 0, REROLE)
                    row[1:] = np.minimum(row[1:], matched)
                    if c in "sS":
                        self.system[i] = np.minimum(self.system[i], self.left[i + 1] + cost)
            row = np.minimum.accumulate(row - INSERT * t) + INSERT * t
            outside = DELETE * (usable[i] - t) > bound
            outside |= INSERT * (t - usable[i]) > bound
            row[outside | (row >= NONE)] = NONE
            self.left[i] = row
        self.system[self.system >= NONE] = NONE

    def _bound(self, usable: int) -> int:
        """What some script costs beyond the deletes that must be, whatever role the target begins with: turns are rerole'd to
        alternate, perhaps after an insert; inserts at the end make the length right."""
        wrong = {}
        for first in "ua":
            roles = (c for c in self.turns if c != "x")
            wrong[first] = sum(REROLE * (c.lower() != ("ua" if first == "u" else "au")[k % 2]) for k, c in enumerate(roles))
        truncated = TRUNCATED * sum(c.isupper() for c in self.turns)
        return truncated + max(min(wrong["u"], wrong["a"] + INSERT), min(wrong["a"], wrong["u"] + INSERT)) + 2 * INSERT

    def _cost(self, i: int, pending: bool, t: int) -> int:
        return int((self.system if pending else self.left)[i, t])

    def best(self, ends: Iterable[tuple[bool, int]]) -> Script | None:
        """The cheapest script to one of the targets (with an s before it, length), the least string of edits among those."""
        ends = [e for e in ends if e[1] < self.width]
        cost = min((self._cost(0, *e) for e in ends), default=NONE)
        if cost >= NONE:
            return None
        at, i, audit = {e for e in ends if self._cost(0, *e) == cost}, 0, []
        while True:
            edit, step, at = self._least_edit(i, at)
            if edit is None:
                return cost, "".join(audit)
            audit.append(edit)
            i += step

    def _least_edit(self, i: int, at: set[tuple[bool, int]]) -> tuple[str | None, int, set[tuple[bool, int]]]:
        c = self.turns[i] if i < len(self.turns) else None
        now = {e: self._cost(i, *e) for e in at}
        if c is not None and (to := {e for e in at if now[e] == DELETE + self._cost(i + 1, *e)}):
            return "D", 1, to
        if to := {(p, t - 1) for p, t in at if not p and t and now[p, t] == INSERT + self._cost(i, p, t - 1)}:
            return "I", 0, to
        if c is None or c == "x":
            return None, 0, at
        extra, keep, rerole = c.isupper() * TRUNCATED, set(), set()
        for p, t in at:
            if p:
                if c in "sS" and now[p, t] == extra + self._cost(i + 1, False, t):
                    keep.add((False, t))
            elif t:
                rest = extra + self._cost(i + 1, False, t - 1)
                if _first(t, self.last) == c.lower():
                    if now[p, t] == rest:
                        keep.add((False, t - 1))
                elif now[p, t] == rest + REROLE:
                    rerole.add((False, t - 1))
        return ("K", 1, keep) if keep else ("R", 1, rerole)


def _ends(align: Alignment, begin: int) -> Iterator[tuple[bool, int]]:
    """The targets that lead from ``begin`` to the last role of ``align``."""
    wanted = "a" if begin == U else "u"
    for t in range(align.width):
        if t == 0 and not (begin == A and align.last == "a" or begin == U and align.last == "u"):
            continue
        if t == 0 or _first(t, align.last) == wanted:
            yield False, t
            if begin == START:
                yield True, t


def whole(turns: str) -> Script:
    """The cheapest edits of a conversation, and of those the least in ASCII order."""
    none = (DELETE * len(turns), "D" * len(turns))
    align = Alignment(turns, "a")
    return min(none, align.best(_ends(align, START)) or none)


def table(turns: str) -> Table:
    """The cheapest edits of a piece by where the output stands before and after it."""
    n = len(turns)
    deleted = (DELETE * n, "D" * n)
    found: Table = {(START, START): deleted, (S, S): deleted}
    system = [(DELETE * (n - 1) + TRUNCATED * c.isupper(), "D" * i + "K" + "D" * (n - 1 - i)) for i, c in enumerate(turns) if c in "sS"]
    if system:
        found[START, S] = min(system)
    for last, end in (("u", U), ("a", A)):
        align = Alignment(turns, last)
        for begin in range(4):
            if script := align.best(_ends(align, begin)):
                found[begin, end] = script
    return found


def joined(first: Table, second: Table) -> Table:
    """The table of two pieces one after the other."""
    out: Table = {}
    for begin in range(4):
        for end in range(4):
            ways = [(first[begin, m], second[m, end]) for m in range(4) if (begin, m) in first and (m, end) in second]
            if ways:
                least = min(a[0] + b[0] for a, b in ways)
                out[begin, end] = min((least, a[1] + b[1]) for a, b in ways if a[0] + b[0] == least)
    return out


@functools.lru_cache(REMEMBERED)
def _remembered(turns: str) -> Script:
    return whole(turns)


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with the faults that crc32(``conv_id:turn``) % 20 puts in: 0 drops a row, 1 empties its
    text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls count as one space, but for ``turn``, which is a
    space in the key and stays null; rows without a ``conv_id`` are left out."""
    space = F.lit(" ")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text")
    )
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("fault", F.crc32(key.cast("binary")) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("time")


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``place``, by turn (null first), role and text."""
    coarse = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 16)]
    return with_places(turns, "conv_id", coarse, [F.col("role"), F.col("text")])


def faults(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, turn, initial, fault)`` of placed turns; the fault is blank, duplicate, truncated (the first that holds) or null."""
    end = F.rtrim("text", F.lit(GAPS))
    fault = F.when(end == "", F.lit("blank")).when(~F.substring(end, -1, 1).isin(".", "!", "?"), F.lit("truncated"))
    same = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    rows = written(turns.select("conv_id", "place", "turn", initial.alias("initial"), fault.alias("own"), same.alias("same")), "faults")
    first = rows.groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("conv_id", "place", F.lit(True).alias("first"))
    again = (F.coalesce("own", F.lit("")) != "blank") & F.col("first").isNull()
    fault = F.when(again, F.lit("duplicate")).otherwise(F.col("own"))
    return written(rows.join(first, ["conv_id", "place"], "left").select("conv_id", "place", "turn", "initial", fault.alias("fault")), "faults")


_TABLE = "array<struct<begin: int, end: int, cost: bigint, audit: string>>"


def _aligned(pieces: DataFrame) -> DataFrame:
    """``(conv_id, span, illegal, cost, audit, scripts)`` of pieces; those of a longer conversation have a table of scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            illegal, costs, audits, scripts = [], [], [], []
            for span, letters in zip(batch.column("span").to_pylist(), batch.column("letters").to_pylist()):
                roles, turns = letters[0::2], letters[1::2].rstrip(" ")
                illegal.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])))
                alone = span == 0 and len(turns) == len(roles)
                cost, audit = (_remembered(turns) if len(turns) <= SHORT else whole(turns)) if alone else (None, None)
                costs.append(cost)
                audits.append(audit)
                scripts.append(None if alone else [{"begin": b, "end": e, "cost": c, "audit": a} for (b, e), (c, a) in table(turns).items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("span"), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(scripts, _ARROW_TABLE)],
                names=["conv_id", "span", "illegal", "cost", "audit", "scripts"],
            )

    return pieces.mapInArrow(run, f"conv_id bigint, span bigint, illegal bigint, cost bigint, audit string, scripts {_TABLE}")


_ARROW_TABLE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _as_table(scripts: list[dict]) -> Table:
    return {(s["begin"], s["end"]): (s["cost"], s["audit"]) for s in scripts}


def _folded(pieces: DataFrame) -> DataFrame:
    """Tables of up to ``FAN_IN`` pieces in a row made one: ``(conv_id, span, scripts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = batch.column("parts")[k].as_py()
                made = functools.reduce(joined, (_as_table(p["scripts"]) for p in parts))
                scripts = [[{"begin": b, "end": e, "cost": c, "audit": a} for (b, e), (c, a) in made.items()]]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").slice(k, 1), batch.column("span").slice(k, 1), pa.array(scripts, _ARROW_TABLE)], names=["conv_id", "span", "scripts"])

    parts = F.array_sort(F.collect_list(F.struct("span", "scripts"))).alias("parts")
    return pieces.groupBy("conv_id", F.expr(f"span DIV {FAN_IN}").alias("span_")).agg(parts).withColumnRenamed("span_", "span").mapInArrow(run, f"conv_id bigint, span bigint, scripts {_TABLE}")


def audits(turns: DataFrame) -> DataFrame:
    """``(conv_id, illegal, cost, audit)`` of conversations with ``(conv_id, place, initial, fault)``."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x")).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    rows = turns.select("conv_id", "place", F.expr(f"place DIV {PIECE}").alias("span"), F.concat("initial", letter).alias("letters"))
    # a piece also sees the role that follows it
    ahead = turns.where(f"place > 0 AND place % {PIECE} = 0").select("conv_id", "place", F.expr(f"place DIV {PIECE} - 1"), F.concat("initial", F.lit(" ")))
    gathered = F.array_sort(F.collect_list(F.struct("place", "letters")))
    pieces = rows.union(ahead).groupBy("conv_id", "span").agg(F.array_join(F.transform(gathered, lambda r: r["letters"]), "").alias("letters"))
    done = written(_aligned(pieces), "aligned")
    out = done.where("audit IS NOT NULL").select("conv_id", "illegal", "cost", "audit")
    long = done.where("scripts IS NOT NULL")
    last = long.agg(F.max("span")).first()[0]
    if last is None:
        return out
    rest = long.select("conv_id", "span", "scripts")
    while last:
        rest, last = written(_folded(rest), "folded"), last // FAN_IN
    # cost and audit of the scripts that end well, the cheapest and least first
    good = F.filter("scripts", lambda s: (s["begin"] == START) & s["end"].isin(START, A))
    best = F.array_min(F.transform(good, lambda s: F.struct(s["cost"].alias("cost"), s["audit"].alias("audit"))))
    illegal = long.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    rest = rest.select("conv_id", best.alias("best")).join(illegal, "conv_id")
    return out.union(rest.select("conv_id", "illegal", "best.cost", "best.audit"))


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``(conv_id, at, role, text)``: placed turns after the edits of ``(conv_id, audit)``, in the order ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("conv_id", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("new_role", pa.string())]
        for batch in batches:
            rows: list[tuple] = []
            for conv, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist()):
                at = place = 0
                odd = (len(audit) - audit.count("D")) % 2  # only with an s in front
                for edit in audit:
                    if edit != "D":
                        rows.append((conv, at, None if edit == "I" else place, None if edit == "K" else ("user", "assistant")[(at - odd) % 2]))
                        at += 1
                    place += edit != "I"
                    if len(rows) > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    lines = found.select("conv_id", "audit").mapInArrow(run, "conv_id bigint, at bigint, place bigint, new_role string")
    lines = lines.join(turns.select("conv_id", "place", "role", "text"), ["conv_id", "place"], "left")
    return lines.select("conv_id", "at", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair(conversations: DataFrame) -> DataFrame:
    """A row per ``conv_id`` of ``conversations``: its faults after damage, the cheapest edits and a digest of what they give.

    Of no turns left after the damage: zeros, an empty ``audit``, the digest of nothing. Ties of ``turn`` are ordered by role and
    text. Rows without a ``conv_id`` are left out; other columns are ignored. The alignment sees a letter per turn, so
    texts of any length take no memory there; a conversation of any length is cut into pieces.
    """
    turns = placed(damaged(conversations))
    known = faults(turns)
    found = written(audits(known), "audits")
    lines = repaired(turns, found).select("conv_id", "at", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    ends = digests(lines, "conv_id", "at", "line", b"\n")
    kinds = [F.sum((F.col("fault") == k).cast("bigint")).alias(k) for k in ("blank", "duplicate", "truncated")]
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counted = known.groupBy("conv_id").agg(span.cast("bigint").alias("gaps"), *kinds)
    every = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = every.join(counted, "conv_id", "left").join(found, "conv_id", "left").join(ends, "conv_id", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
