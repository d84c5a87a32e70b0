import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm import ordered, prefix_trie

KIND = "conv_id long, turn long, role string, text string, id string, node string, place string, words string"


def slow_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        childless = [n for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)]
        ends = ",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(node)))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(n) == len(node) + 1 for n in under), len(childless),
            sum((len(nodes[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row[:4]) + tuple(row[4:])


def made(seed, n_convs, depth, words):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        for t in range(rng.randint(0, depth)):
            rows.append((c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices(words, k=rng.randint(0, 2)))))
    return [(*r, "a", "b", "c", "d") for r in rows]


EDGES = [
    (0, 0, "user", "hi there"), (0, 1, "assistant", None), (0, 2, None, "x y z"), (1, 0, "user", "hi there"), (1, None, "user", "first"), (1, None, None, None),
    (2, 5, "user", "hi there"), (2, 5, "user", "hi there"), (2, 5, "a", "tie"), (3, 0, "user", "w " * 50_000), (4, 0, "user", "é\x0b ü"), (None, 0, "user", "no id"),
    (21, 0, "user", "base absent"), (45, 0, "u", "t"), (47, 0, "u", "t"), (47, 1, "u", "t"), (-7, 0, "user", "negative"), (-7, 1, "user", "more"), (61, 0, "userx", "y"), (62, 0, "user", "xy"),
]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, seed):
    rows = made(seed, 45, 5 if seed == 1 else 11, ["a", "b"] if seed == 1 else ["a"])
    if seed == 1:
        rows += [(100 + (r[0] or 0), *r[1:], *"abcd") for r in EDGES if r[0] is not None] + [(*r, *"abcd") for r in EDGES if r[0] is None or r[0] >= 21]
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, KIND).repartition(3))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for _, t in found.dtypes[:-1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(slow_trie(rows), key=key)


def test_edges_and_small_spans(spark, monkeypatch):
    """A long conversation that is cut into spans of four places."""
    monkeypatch.setattr(prefix_trie, "SPAN", 4)
    monkeypatch.setattr(ordered, "PACK_BYTES", 5)
    rows = [(*r, *"abcd") for r in EDGES] + [(60, t, "user", f"w{t % 3}", *"abcd") for t in range(37)] + [(80 + k, t, "user", f"w{t % 3}", *"abcd") for k in range(3) for t in range(20 + k)]
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, KIND).repartition(3))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(slow_trie(rows), key=key)


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], KIND)).collect() == []


def test_places_of_a_group_in_many_tasks(spark):
    rows = spark.range(400).select(F.expr("CASE WHEN id % 4 < 3 THEN 7 ELSE id DIV 50 END").alias("g"), (F.col("id") * 7 % 401).alias("at"), F.lit("x").alias("first"))
    found = ordered.with_places(rows.repartition(9), "g", [F.col("at")], []).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r.g].append((r.at, r.place))
    assert len(found) == 400 and all([p for _, p in sorted(v)] == list(range(len(v))) for v in groups.values())


@pytest.mark.parametrize("pack", [1, 10, 1 << 16])
def test_digests_of_groups_in_many_tasks(spark, monkeypatch, pack):
    monkeypatch.setattr(ordered, "PACK_BYTES", pack)
    rows = [(g, k, b"" if k % 5 == 0 else f"{k}-{g}".encode()) for g, n in [(1, 200), (2, 1), (3, 1), (4, 30), (5, 2), (9, 60)] for k in range(n)]
    found = ordered.digests(spark.createDataFrame(rows, "g long, at long, v binary").repartition(5), "g", "at", "v", b"\n")
    want = {g: hashlib.sha256(b"\n".join(v for h, _, v in rows if h == g)).hexdigest() for g in {r[0] for r in rows}}
    got = found.collect()
    assert len(got) == len(want) and {r.g: r.sha256 for r in got} == want
