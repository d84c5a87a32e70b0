"""Text of clocks, ranks, zones and view summaries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.pitch import BAND

# Wording of lanes, shape changes and attack kinds.
GAP_LANES = ("R wing", "R half-space", "centre", "L half-space", "L wing")
SHAPE_WORDS = {
    "back_line": ("back line", "steps up", "drops", "holds its height"),
    "width": ("block", "widens", "narrows", "keeps its width"),
    "length": (None, "stretches", "shortens", "keeps its length"),
}
KIND_TEXT = {"restart": "after a restart", "long": "long possession", "turnover": "after a turnover"}
PERIOD_END = {1: 45, 2: 90, 3: 105, 4: 120}


def whole(v: Column, pattern: str = "%d") -> Column:
    return F.format_string(pattern, F.bround(v).cast("bigint"))


def clock(seconds: Column) -> Column:
    """m:ss of the seconds rounded half to even."""
    s = F.bround(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def padded_clock(seconds: Column) -> Column:
    """mm:ss of the whole seconds, never negative."""
    s = F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint"))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def minute_label(seconds: Column, period: Column) -> Column:
    """45+2' style minute: stoppage counts on from the end of the period."""
    m = F.floor(seconds / 60) + 1
    end = F.element_at(F.create_map(*[F.lit(v) for kv in PERIOD_END.items() for v in kv]), period)
    return F.when(m > end, F.format_string("%d+%d'", end, m - end)).otherwise(F.format_string("%d'", m))


def ordinal(n: Column) -> Column:
    tail = (
        F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), tail)


def rank_text(rank: Column, of: Column, best: Column) -> Column:
    return F.concat(ordinal(rank), F.lit(" of "), of.cast("string"), F.when(rank == 1, F.concat(F.lit(" ("), best, F.lit(")"))).otherwise(""))


def shape_change(key: str, d: Column) -> Column:
    noun, up, down, same = SHAPE_WORDS[key]
    verb = F.when(F.abs(d) < 1, same).otherwise(
        F.concat(F.when(d > 0, up).otherwise(down), F.lit(" "), whole(F.abs(d)), F.lit(" m"))
    )
    return F.concat(F.lit(noun + " "), verb) if noun else verb


def shape_sentence(back_line: Column, width: Column, length: Column) -> Column:
    return F.concat(
        F.lit("Without the ball: "), shape_change("back_line", back_line), F.lit(", "), shape_change("width", width), F.lit(" and "), shape_change("length", length)
    )


def change_text(before: Column, after: Column) -> Column:
    d = (F.bround(after) - F.bround(before)).cast("bigint")
    return F.when(d == 0, "no change").otherwise(F.format_string("%+d", d))


def zone_name(lane: Column, band: Column) -> Column:
    a, b = band * BAND, (band + 1) * BAND
    depth = F.when(a >= 0, F.format_string("%d-%d m ahead of", a, b)).otherwise(F.format_string("%d-%d m behind", -b, -a))
    name = F.element_at(F.array(*[F.lit(n) for n in GAP_LANES]), lane + 1)
    return F.concat(name, F.lit(", "), depth, F.lit(" the back line"))


def centre_text(c: Column) -> Column:
    side = F.when(c > 0, "into the opponents’ half").otherwise("inside its own half")
    return F.when(F.bround(F.abs(c)) == 0, "team centre on the halfway line").otherwise(
        F.concat(F.lit("team centre "), whole(F.abs(c)), F.lit(" m "), side)
    )


def caption(kind: Column, third: Column, seconds: Column, passes: Column) -> Column:
    named = F.element_at(F.create_map(*[F.lit(v) for kv in KIND_TEXT.items() for v in kv]), kind)
    what = F.when(third.isNotNull(), F.concat(F.lit("won in "), third, F.lit(" third"))).otherwise(named)
    return F.concat(what, F.lit(" · "), whole(seconds), F.lit(" s · "), passes.cast("string"), F.lit(" pass"), F.when(passes != 1, "es").otherwise(""))


def number(v: Column) -> Column:
    """Whole numbers without a decimal point, others with two places at most."""
    two = F.regexp_replace(F.format_string("%.2f", v), "\\.?0+$", "")
    return F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(two)


def surname(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def first_part(text: Column) -> Column:
    return F.element_at(F.split(text, " · "), 1)


def credit(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replacements applied in order; providers bring their own pairs."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def turnover_sentence(name, won, half, fast, shot) -> Column:
    return F.format_string("%s: %d regains, %d past halfway, %d near goal within 10 s, %d ending in a shot", name, won, half, fast, shot)


def press_sentence(name, presses, win_rate, half) -> Column:
    return F.format_string("%s: %d presses, %d past halfway, %d%% successful within 5 s", name, presses, half, F.bround(win_rate).cast("bigint"))


def chance_sentence(name, faced, turn, restart, long) -> Column:
    return F.format_string("%s: shots against %d = turnover %d + restart %d + long possession %d", name, faced, turn, restart, long)


def attack_sentence(name, left, middle, right, entries) -> Column:
    share = lambda c: F.bround(c).cast("bigint")
    return F.format_string("%s: entries %d; play by lane %d/%d/%d %% (left/middle/right)", name, entries, share(left), share(middle), share(right))


def gap_sentence(name, holes, free, pocket) -> Column:
    return F.concat(name, F.lit(": mean hole area "), whole(holes), F.lit(" m2, mean free opponents "), number(free), F.lit(", usual hole "), pocket)


def time_sentence(name, first, last) -> Column:
    return F.concat(name, F.lit(": line height "), whole(first), F.lit(" m early, "), whole(last), F.lit(" m late"))


def line_break_sentence(name, conceded, behind, lane) -> Column:
    return F.concat(name, F.lit(": lines broken "), conceded.cast("string"), F.lit(" times, "), behind.cast("string"), F.lit(" of them behind the last line, mostly by the "), lane)
