"""Mixing documents to target weights by budgets that run down a tree of groups. Built-in functions only.

A token budget is split over domains, each share over the domain's languages, each of those over sources, by weight. What
a group cannot fill, its documents times the epochs allowed, goes to its siblings; only when a whole branch is full does
the rest go to the branch's siblings. A leaf's budget buys whole epochs and the longest prefix that fits of one more, in
an order seeded per epoch. All amounts are whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.tables import written

#: Documents per running sum within a leaf, about.
BUCKET_DOCS = 4096


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; none in a null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("bigint")


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1).cast("bigint")
    for key, w in sorted(weights.items()):
        out = F.when(name == key, F.lit(int(w)).cast("bigint")).otherwise(out)
    return out


def _filled(groups: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget`` to siblings ``(parent..., name, weight, cap, given)``: ``given`` split by weight under the caps.

    Siblings in order of cap over weight: one is full if what the smaller ones take and its own share of the rest, at
    its own ratio, stay within ``given``. Shares of the others are rounded down.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(*parent)
    g = groups.withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights_left", F.sum("weight").over(after))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    g = g.withColumn("full", wide("caps_before") * F.col("weight") + wide("cap") * F.col("weights_left") <= wide("given") * F.col("weight"))
    g = g.withColumn("taken", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)).withColumn("open", F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(every))
    share = F.expr("CAST((CAST(given - taken AS DECIMAL(38,0)) * weight) DIV open AS BIGINT)")
    return g.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), share))).drop("caps_before", "weights_left", "full", "taken", "open", "given")


def leaf_budgets(sizes: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], given: Column, epochs: int) -> DataFrame:
    """``(levels..., tokens, docs, budget)`` from one row per leaf ``(levels..., tokens, docs)``.

    ``given`` is the whole budget as a column over ``all_tokens``, the tokens of all leaves. A name without a weight has
    weight 1; weights are positive whole numbers. The tables here have a row per group of the tree, not per document.
    """
    names = list(levels)
    tree = sizes.withColumn("cap", F.col("tokens") * epochs)
    total = tree.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")).select(given.cast("bigint").alias("given"))
    budget = None
    for depth, name in enumerate(names):
        path = names[: depth + 1]
        groups = tree.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(name), weights.get(name, {})))
        if budget is None:
            groups = groups.join(F.broadcast(total))  # one row
        else:
            groups = groups.join(budget.withColumnRenamed("budget", "given"), names[:depth])
        budget = _filled(groups, names[:depth], name).select(*path, "budget")
    return tree.join(budget, names).drop("cap")


def draw_key(epoch: Column, id_: Column, seed: int) -> Column:
    """Where a document stands in its leaf's order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def draws(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], given: Column, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", tokens_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``copies`` (bigint, in place of a column of that name), how often each row is drawn; rows that are not drawn are left out.

    Rows of null levels form groups of their own under the empty name; null tokens count as 0. Rows of equal ids in a leaf
    stand side by side in its order, smaller ones first; equal in size too, they are drawn together or not at all. Pass a
    table that is cheap to read: it is read twice. No leaf is gathered anywhere: places in a leaf come from sums of
    buckets of its order.
    """
    names = [f"__{k}" for k in range(len(levels))]
    rows = docs.withColumns({n: F.coalesce(F.col(c).cast("string"), F.lit("")) for n, c in zip(names, levels)}).withColumn("__t", F.coalesce(F.col(tokens_col).cast("bigint"), F.lit(0)))
    sizes = rows.groupBy(*names).agg(F.sum("__t").alias("tokens"), F.count("*").alias("docs"))
    budgets = written(leaf_budgets(sizes, names, {n: weights.get(c, {}) for n, c in zip(names, levels)}, given, epochs), "budgets")
    whole = F.when(F.col("tokens") > 0, F.expr("budget DIV tokens")).otherwise(F.lit(0))
    plan = budgets.select(*names, whole.alias("__whole"), (F.col("budget") - whole * F.col("tokens")).alias("__rest"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_DOCS)).alias("__buckets"))
    placed = rows.join(plan, names).withColumn("__key", draw_key(F.col("__whole") + 1, F.col(id_col), seed))
    placed = placed.withColumn("__bucket", (F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint") * F.col("__buckets") / F.lit(1 << 32)).cast("bigint"))
    sums = placed.groupBy(*names, "__bucket").agg(F.sum("__t").alias("__sum"))
    ahead = sums.withColumn("__ahead", F.sum("__sum").over(Window.partitionBy(*names).orderBy("__bucket")) - F.col("__sum")).drop("__sum")
    running = F.sum("__t").over(Window.partitionBy(*names, "__bucket").orderBy("__key", "__t"))
    out = placed.join(ahead, [*names, "__bucket"]).withColumn("__upto", F.col("__ahead") + running)
    out = out.withColumn("copies", F.col("__whole") + F.when(F.col("__upto") <= F.col("__rest"), F.lit(1)).otherwise(F.lit(0)))
    return out.where("copies > 0").select(*(c for c in docs.columns if c != "copies"), "copies")
