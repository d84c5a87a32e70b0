"""Game-state study: what a side does while it leads, trails or is level, and how much of it goes with the state.

Samples are rows of any DataFrame with key columns, ``state``, ``clock`` (any unit), ``live``, ``defending``, ``has_ball`` and the
measures of the defending block: ``line, length, width`` (medians), ``holes, free`` (means), ``structure``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.timeline import grouped_percentile

# Labels of an organised block; which count weighs a measure, all others go by n_def.
ORGANISED = ("High Press", "Mid Block", "Low Block")
MEDIANS, MEANS = ("line", "length", "width"), ("holes", "free")
WEIGHTS = {"possession": "n_live", "high": "n_org", "low": "n_org"}
MEASURES = (*MEDIANS, *MEANS, "high", "low", "possession")


def bins(samples: DataFrame, presses: DataFrame, keys: Sequence[str], seconds: float = 0.2) -> DataFrame:
    """One row per key with every measure, its weight in samples, minutes, and presses per defending minute.

    ``presses`` has the keys, one row per press.  Only live or defending samples count; a sample lasts ``seconds``.
    Counts, shares and means are one combined aggregation, the medians one percentile pass over the defending rows, whose
    counted values are stored: two readings of ``samples`` in all.
    """
    keys = list(keys)
    s = samples.where(F.col("live") | F.col("defending"))
    own, org = F.col("defending"), F.col("defending") & F.col("structure").isin(*ORGANISED)
    share = lambda of, what: 100.0 * F.avg(F.when(of, what.cast("int")))
    every = s.groupBy(*keys).agg(
        F.count_if(own).alias("n_def"), F.count_if(org).alias("n_org"), F.count_if("live").alias("n_live"),
        *[F.avg(F.when(own, F.col(c))).alias(c) for c in MEANS],
        share(org, F.col("structure") == "High Press").alias("high"), share(org, F.col("structure") == "Low Block").alias("low"),
        share(F.col("live"), F.col("has_ball")).alias("possession"),
        F.coalesce(F.avg(F.when(own, F.col("clock"))), F.avg(F.when(F.col("live"), F.col("clock")))).alias("clock"),
    )
    named = F.array(*[F.struct(F.lit(c).alias("__m"), F.col(c).cast("double").alias("__v")) for c in MEDIANS])
    long = s.where(own).select(*keys, F.inline(named))
    med = grouped_percentile(long, [*keys, "__m"], "__v", {"__p": 0.5}, stored=True)
    med = med.groupBy(*keys).agg(*[F.max(F.when(F.col("__m") == c, F.col("__p"))).alias(c) for c in MEDIANS])
    pressed = presses.groupBy(*keys).agg(F.count(F.lit(1)).alias("presses"))
    d = every.join(med, keys, "left").join(pressed, keys, "left").withColumn("presses", F.coalesce("presses", F.lit(0).cast("bigint")))
    minutes = lambda n: F.col(n) * seconds / 60
    return d.withColumn("def_min", minutes("n_def")).withColumn("live_min", minutes("n_live")).withColumn(
        "press_rate", F.try_divide(F.col("presses").cast("double"), F.col("def_min"))
    )


def effects(
    binned: DataFrame, team: Sequence[str], compare: Sequence[str] = ("leading", "trailing"), base: str = "level",
    min_bin_s: float = 30, min_state_min: float = 3, min_teams: int = 3, seconds: float = 0.2,
) -> DataFrame:
    """Difference of every measure in a state from ``base``, within team-matches: ``measure, state, effect, teams``.

    Weighted least squares on the state with a constant per team-match; weights are the seconds behind each bin's measure.
    The state is 0 or 1, so a team-match is four sums, and nothing but those is grouped further.  A bin needs
    ``min_bin_s`` of its weight, a team-match ``min_state_min`` minutes in both states, a comparison ``min_teams`` of them.
    """
    team = list(team)
    each = F.array(*[
        F.struct(
            F.lit(m).alias("measure"), F.col(m).cast("double").alias("__y"), F.col(WEIGHTS.get(m, "n_def")).cast("double").alias("__w"),
            F.col("live_min" if m == "possession" else "def_min").alias("__minutes"),
        ) for m in MEASURES
    ])
    d = binned.withColumn("__versus", F.explode(F.array(*map(F.lit, compare)))).where((F.col("state") == base) | (F.col("state") == F.col("__versus")))
    d = d.select(*team, "__versus", (F.col("state") != base).alias("__on"), F.inline(each)).where(F.col("__y").isNotNull() & (F.col("__w") * seconds >= min_bin_s))
    w, y = F.col("__w"), F.col("__y")
    t = d.groupBy("measure", "__versus", *team).agg(
        F.sum(w).alias("__w"), F.sum(w * y).alias("__wy"), F.sum(F.when(F.col("__on"), w)).alias("__wx"), F.sum(F.when(F.col("__on"), w * y)).alias("__wxy"),
        F.sum(F.when(F.col("__on"), F.col("__minutes"))).alias("__in_state"), F.sum(F.when(~F.col("__on"), F.col("__minutes"))).alias("__in_base"),
    ).where((F.col("__in_state") >= min_state_min) & (F.col("__in_base") >= min_state_min))
    got = t.groupBy("measure", F.col("__versus").alias("state")).agg(
        F.sum(F.col("__wxy") - F.col("__wx") * F.col("__wy") / F.col("__w")).alias("xy"), F.sum(F.col("__wx") - F.col("__wx") * F.col("__wx") / F.col("__w")).alias("xx"), F.count(F.lit(1)).alias("teams")
    )
    return got.where(F.col("teams") >= min_teams).select("measure", "state", F.try_divide("xy", "xx").alias("effect"), "teams")
