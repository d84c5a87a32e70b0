"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, for every node in ``links`` ``(u, v)``.

    Alternates two rewirings until nothing changes: first every node hands its larger neighbours its smallest one, then
    its smaller ones. Rounds grow with the logarithm of a component's diameter; each round is written to the shared
    folder, nothing but two numbers comes to the driver. Loops and repeated links are allowed; null ends are dropped.
    """
    edges = links.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "components")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v"))
    edges = edges.where("u <> v")
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        grown = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = grown.groupBy("u").agg(F.min("v").alias("m"))
        moved = grown.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.union(least).distinct(), "components")
        after = _state(edges)
        if after == before:
            break
        before = after
    return nodes.distinct().join(edges.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))
