"""Quality rules: text statistics as column expressions, and decision lists learned from labelled statistics.

Sequential covering: a rule is grown condition by condition on two thirds of the labelled rows (information gain over
histograms that Spark counts), pruned on the other third, and the rows it covers leave before the next rule is grown.
The list is emitted as one ordered ``CASE``. Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bytes between words, and the characters counted as symbols.
GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")


def _without(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns ``STATS`` (long) to every row; columns of these names are replaced, all others stay as they are.

    Words are runs of anything but ASCII white space; a null or empty text has none. ``n_repeat_words`` counts the words
    in three-word windows that the text holds twice or more; windows are compared by a 64-bit hash. Work and memory
    are those of one text at a time; no shuffle.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    bare = _without(text, GAPS)
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, GAPS) != "")
    out = docs.drop(*STATS).withColumn("__text", F.col(text_col).cast("string"))
    out = out.withColumn("__words", F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != ""))
    out = out.withColumn("__lines", lines)

    def window(i: Column) -> Column:
        return F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))

    n = F.size("__words")
    out = out.withColumn("__windows", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")))
    # where windows repeat: (hash, place) in order, then the places whose neighbour has the same hash
    pairs = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), pairs))

    def twice(x: Column, k: Column) -> Column:
        near = lambda j: F.coalesce(F.get("__sorted", j)["h"] == x["h"], F.lit(False))
        return near(k - 1) | near(k + 1)

    out = out.withColumn("__at", F.array_sort(F.transform(F.filter("__sorted", twice), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    size = F.char_length(text)
    stats = {
        "n_words": n,
        "word_chars": F.char_length(bare),
        "n_symbols": size - F.char_length(_without(text, SYMBOLS)),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("__lines"),
        "n_upper": size - F.char_length(_without(text, UPPER)),
        "n_marks": size - F.char_length(_without(text, "!?")),
        "n_digits": size - F.char_length(_without(text, "0123456789")),
    }
    return out.withColumns({k: v.cast("bigint") for k, v in stats.items()}).drop("__text", "__words", "__lines", "__windows", "__sorted", "__at")


def base_failed() -> Column:
    """The fixed part of the verdict."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _grid(first: float, factor: float, count: int) -> list[float]:
    return [round(first * factor**k, 6) for k in range(count)]


#: What rules may ask for: name, numerator and denominator of ``STATS``, thresholds.
FEATURES = [
    ("symbols per character", "n_symbols", "word_chars", _grid(0.002, 1.6, 14)),
    ("marks per word", "n_marks", "n_words", _grid(0.01, 1.6, 12)),
    ("upper case per character", "n_upper", "word_chars", _grid(0.01, 1.4, 14)),
    ("digits per character", "n_digits", "word_chars", _grid(0.005, 1.6, 12)),
    ("repeated lines", "n_dup_lines", "n_lines", _grid(0.02, 1.5, 10)),
    ("repeated words", "n_repeat_words", "n_words", _grid(0.01, 1.5, 10)),
    ("characters per word", "word_chars", "n_words", [2.0 + 0.5 * k for k in range(20)]),
    ("words per line", "n_words", "n_lines", _grid(2.0, 1.5, 12)),
    ("words", "n_words", None, _grid(60.0, 1.5, 12)),
]


def value(feature: int) -> Column:
    _, a, b, _ = FEATURES[feature]
    return F.col(a).cast("double") if b is None else _share(a, b)


@dataclass(frozen=True)
class Condition:
    """``feature`` (its place in ``FEATURES``) over, or not over, its threshold ``cut``."""

    feature: int
    cut: int
    over: bool

    def column(self) -> Column:
        x, cut = value(self.feature), FEATURES[self.feature][3][self.cut]
        return x > cut if self.over else x <= cut

    def binned(self) -> Column:
        at = F.col("bins")[self.feature]
        return at > self.cut if self.over else at <= self.cut

    def __str__(self) -> str:
        name, _, _, cuts = FEATURES[self.feature]
        return f"{name} {'>' if self.over else '<='} {cuts[self.cut]:g}"


Rule = tuple[Condition, ...]


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(bad, prune, bins)`` of the labelled rows that pass the fixed part; rows without an id or label take no part."""
    known = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) == 0).alias("bad")).where("bad IS NOT NULL AND __id IS NOT NULL")
    bins = F.array(*(sum(((value(k) > t).cast("int") for t in f[3]), F.lit(0)) for k, f in enumerate(FEATURES)))
    # a third of the rows prunes, told by the statistics alone: copies of a text stay on one side
    prune = F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_upper"), F.lit(3)) == 0
    return stats.join(known, stats[id_col] == known["__id"]).where(~base_failed()).select("bad", prune.alias("prune"), bins.alias("bins"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, most: int) -> Rule:
    rule: Rule = ()
    while len(rule) < most:
        inside = rows.where(_all([c.binned() for c in rule]) & ~F.col("prune"))
        # at most features x thresholds rows come to the driver
        counted = inside.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.sum((~F.col("bad")).cast("int")).alias("n")).collect()
        table: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counted:
            table.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["n"])
        ranked: list[tuple[float, Condition, int]] = []
        for f, by in sorted(table.items()):
            p0, n0 = (sum(v[k] for v in by.values()) for k in (0, 1))
            for cut in range(len(FEATURES[f][3])):
                under = [v for b, v in by.items() if b <= cut]
                p, n = (sum(v[k] for v in under) for k in (0, 1))
                for over, (a, b) in ((True, (p0 - p, n0 - n)), (False, (p, n))):
                    ranked.append((_gain(a, b, p0, n0), Condition(f, cut, over), b))
        score, best, left = max(ranked, key=lambda r: r[0], default=(0.0, None, 0))
        if score <= 1e-9:
            break
        # thresholds that part the labelled rows alike: the middle one is farthest from either side
        alike = [r for r in ranked if r[1].feature == best.feature and r[1].over == best.over and abs(r[0] - score) <= 1e-9]
        _, best, left = alike[len(alike) // 2]
        rule += (best,)
        if left == 0:
            break
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule that is best on the pruning rows, with the bad and the good rows it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        hit = _all([c.binned() for c in rule[:k]])
        sums += [F.coalesce(F.sum((hit & F.col("bad")).cast("int")), F.lit(0)).alias(f"p{k}"), F.coalesce(F.sum((hit & ~F.col("bad")).cast("int")), F.lit(0)).alias(f"n{k}")]
    r = rows.where("prune").agg(*sums).first()
    k = max(range(1, len(rule) + 1), key=lambda k: ((r[f"p{k}"] - r[f"n{k}"]) / max(1, r[f"p{k}"] + r[f"n{k}"]), r[f"p{k}"]))
    return rule[:k], r[f"p{k}"], r[f"n{k}"]


def learn(rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95, support: int = 3) -> list[Rule]:
    """An ordered list of rules for bad texts from ``training_rows`` (read several times: pass a written table).

    A rule counts if at least ``precision`` of the pruning rows it covers are bad, and at least ``support`` of them; the
    first that does not ends the list. Without labelled rows the list is empty. Every labelled row takes part.
    """
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        rule = _grow(left, max_conditions)
        if not rule:
            break
        rule, p, n = _prune(left, rule)
        if p < support or p < precision * (p + n):
            break
        rules.append(rule)
        left = left.where(~_all([c.binned() for c in rule]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for texts to keep: the first rule that holds rejects."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        hit = _all([c.column() for c in rule])
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return out.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """The rule that rejects, as text; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all([c.column() for c in rule]), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out
