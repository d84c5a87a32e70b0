"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are one node. A shard's graph is built in insertion order: a node links to diverse ones among the nearest of
those before it, on every level it belongs to, and back; so early nodes keep long links. Levels are flat arrays of
neighbours. All queries of a block walk a shard side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.tables import written

#: Nodes per shard, about: its build holds a square of distances.
SHARD_NODES = 2048
#: Links given to a new node on a level; twice as many are kept.
LINKS = 12
#: Nodes that a walk keeps in view on the lowest level and above.
VIEW, VIEW_ABOVE = 40, 4
#: Queries that travel together.
QUERY_BLOCK = 128


def usable(c: Column) -> Column:
    """Vectors that take part: set, not zero, every component set and finite."""
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0)


def _diverse(square: np.ndarray, options: np.ndarray, most: int) -> np.ndarray:
    """Of each node's options, nearest first (-1: none), those nearer to the node than to any chosen before."""
    n = len(square)
    kept = np.full((n, most), -1, np.int32)
    count = np.zeros(n, np.int64)
    for k in range(options.shape[1]):
        c = options[:, k]
        rows = np.flatnonzero((c >= 0) & (count < most))
        if not len(rows):
            continue
        own = kept[rows]
        far = np.where(own >= 0, square[c[rows][:, None], np.maximum(own, 0)], np.inf)
        rows = rows[(far > square[rows, c[rows]][:, None]).all(1)]
        kept[rows, count[rows]] = c[rows]
        count[rows] += 1
    return kept


def _level_links(square: np.ndarray) -> np.ndarray:
    """Neighbours of the nodes of one level, in insertion order, padded with -1."""
    n = len(square)
    if n < 2:
        return np.full((n, 2 * LINKS), -1, np.int32)
    before = np.where(np.tri(n, k=-1, dtype=bool), square, np.inf)
    look = min(n - 1, 3 * LINKS)
    near = np.argpartition(before, look - 1, axis=1)[:, :look]
    dist = np.take_along_axis(before, near, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    near = np.where(np.isfinite(np.take_along_axis(dist, order, 1)), np.take_along_axis(near, order, 1), -1)
    chosen = _diverse(square, near, LINKS)
    a, k = np.nonzero(chosen >= 0)
    b = chosen[a, k]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((b, square[a, b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    options = np.full((n, int(rank.max()) + 1), -1, np.int32)
    options[a, rank] = b
    if options.shape[1] <= 2 * LINKS:
        out = np.full((n, 2 * LINKS), -1, np.int32)
        out[:, : options.shape[1]] = options
        return out
    crowded = (options >= 0).sum(1) > 2 * LINKS
    out = options[:, : 2 * LINKS].copy()
    picked = _diverse(square, np.where(crowded[:, None], options, -1), 2 * LINKS)
    out[crowded] = picked[crowded]
    return out


def build_graph(vectors: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, their neighbours) per level, lowest first; neighbours are numbers of vectors, -1 pads."""
    wide = vectors.astype(np.float64)
    norm = (wide * wide).sum(1)
    square = np.maximum(norm[:, None] + norm[None, :] - 2 * wide @ wide.T, 0).astype(np.float32)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(vectors))) / math.log(LINKS)).astype(int)
    levels = []
    for k in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= k)
        links = _level_links(square[np.ix_(nodes, nodes)])
        levels.append((nodes.astype(np.int32), np.where(links >= 0, nodes[np.maximum(links, 0)], -1).astype(np.int32)))
    return levels


def _walk(queries: np.ndarray, vectors: np.ndarray, place: np.ndarray, links: np.ndarray, start: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) in view of each query after its walk over one level, nearest first."""
    q = len(queries)
    seen = np.zeros((q, len(vectors)), bool)
    nodes = np.full((q, view), -1, np.int64)
    dist = np.full((q, view), np.inf, np.float32)
    done = np.ones((q, view), bool)
    width = min(start.shape[1], view)
    first = start[:, :width]
    nodes[:, :width] = first
    gap = vectors[np.maximum(first, 0)] - queries[:, None, :]
    dist[:, :width] = np.where(first >= 0, np.einsum("qkd,qkd->qk", gap, gap), np.inf)
    done[:, :width] = first < 0
    np.put_along_axis(seen, np.maximum(first, 0), first >= 0, 1)
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        pick = open_.argmin(1)
        go = np.isfinite(open_[np.arange(len(active)), pick])
        active, pick = active[go], pick[go]
        if not len(active):
            break
        done[active, pick] = True
        near = links[place[nodes[active, pick]]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, -1)
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        gap = vectors[near[r, c]] - queries[active[r]]
        new = np.full(near.shape, np.inf, np.float32)
        new[r, c] = np.einsum("kd,kd->k", gap, gap)
        all_d = np.concatenate([dist[active], new], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :view]
        dist[active] = np.take_along_axis(all_d, order, 1)
        nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near], 1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], new == np.inf], 1), order, 1)
    return nodes, dist


def search_graph(queries: np.ndarray, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Nodes in view of each query at the end, nearest first, -1 pads."""
    found = np.repeat(levels[-1][0][None, :1].astype(np.int64), len(queries), 0)
    for k in range(len(levels) - 1, -1, -1):
        nodes, links = levels[k]
        place = np.zeros(len(vectors), np.int64)
        place[nodes] = np.arange(len(nodes))
        found, _ = _walk(queries, vectors, place, links, found, VIEW if k == 0 else VIEW_ABOVE)
    return found


def _packed(levels: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    head = np.array([len(levels), *(len(nodes) for nodes, _ in levels)], np.int32)
    return b"".join([head.tobytes(), *(x.astype(np.int32).tobytes() for level in levels for x in level)])


def _unpacked(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    flat = np.frombuffer(data, np.int32)
    sizes, at, levels = flat[1 : 1 + flat[0]], 1 + flat[0], []
    for n in sizes.tolist():
        nodes, links = flat[at : at + n], flat[at + n : at + n + n * 2 * LINKS].reshape(n, 2 * LINKS)
        levels.append((nodes, links))
        at += n + n * 2 * LINKS
    return levels


def build_index(vectors: DataFrame, keep: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per shard: ``(dim, shard, owners, vectors, graph)``; every usable row is indexed.

    Equal vectors share a node that keeps the ``keep`` smallest ids: more of them can never be among the nearest
    ``keep``. ``id_col`` is bigint; rows without an id, and vectors that ``usable`` refuses, take no part.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("nth") <= keep)
    nodes = written(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("owners")).withColumn("dim", F.size("vector")), "ann-nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_NODES).alias("shards"))
    nodes = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        dim, shard = (k.as_py() for k in key)
        flat = np.asarray(group.column("vector").combine_chunks().flatten(), np.float32).reshape(-1, dim)
        owners = group.column("owners").to_pylist()
        order = np.argsort([o[0] for o in owners], kind="stable")
        order = order[np.random.default_rng(shard).permutation(len(order))]  # the same graph whatever order the rows come in
        flat = flat[order]
        return pa.table({"dim": [dim], "shard": [shard], "owners": [[owners[i] for i in order]], "vectors": [flat.tobytes()], "graph": [_packed(build_graph(flat, shard))]}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("owners", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("graph", pa.binary())]))

    return nodes.groupBy("dim", "shard").applyInArrow(build, "dim int, shard bigint, owners array<array<bigint>>, vectors binary, graph binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows found nearest to each row of ``queries``, by Euclidean distance.

    A query never finds its own id; ties go to the smaller id; with fewer candidates all are returned. Queries of another
    dimension than a row do not meet it. Rows that ``build_index`` refuses take no part on either side.
    """
    index = written(build_index(vectors, k + 1, id_col, vector_col), "ann-index")
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    asked = asked.withColumn("dim", F.size("vector"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    asked = asked.join(blocks, "dim").groupBy("dim", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("queries"))
    pairs = index.join(asked, "dim").repartition("shard", "block")  # every block of queries visits every shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim = batch.column("dim")[row].as_py()
                asked_ids = np.array([q["id"] for q in batch.column("queries")[row].as_py()], np.int64)
                wanted = np.array([q["vector"] for q in batch.column("queries")[row].as_py()], np.float32)
                flat = np.frombuffer(batch.column("vectors")[row].as_py(), np.float32).reshape(-1, dim)
                owners = batch.column("owners")[row].as_py()
                found = search_graph(wanted, flat, _unpacked(batch.column("graph")[row].as_py()))
                out = []
                for q, nodes in enumerate(found):
                    nodes = nodes[nodes >= 0]
                    gap = flat[nodes].astype(np.float64) - wanted[q].astype(np.float64)
                    score = np.sqrt((gap * gap).sum(1))
                    own = int(asked_ids[q])
                    near = sorted((s, o) for n, s in zip(nodes.tolist(), score.tolist()) for o in owners[n] if o != own)[:k]
                    out += [(own, o, s) for s, o in near]
                ids, others, scores = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "owners", "vectors", "graph", "queries").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
