import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from touchline.llm import simhash


def slow_fingerprint(text: str | None) -> int:
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", fold)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """Smallest id reachable per row, by trying all pairs of rows."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(range(len(rows)), 2):
            if label[a] != label[b] and (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    ids = [[rows[k][0] for k in range(len(rows)) if label[k] == label[r] and rows[k][0] is not None] for r in range(len(rows))]
    return [min(i, default=None) for i in ids]


def test_query_against_all_pairs(spark, docs):
    found = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, f"{fp:016x}", c) for (i, fp), c in zip(rows, slow_components(rows))), key=key)
    assert sorted((tuple(r) for r in found), key=key) == want
    assert found[0].__fields__ == ["doc_id", "fingerprint", "component_id"]


def test_empty_table(spark, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pieces_of_a_text(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE_BYTES", piece)
    monkeypatch.setattr(simhash, "COUNTED", 3)
    for text in ["", " \t ", "one", "One two", "a b c", "É é\x0bÉ x  y\tZ", " ".join(f"w{k % 5}" for k in range(40)), "x" * 50 + " y z"]:
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_very_long_text():
    text = " ".join(f"w{k % 977}x{k}" for k in range(400_000))
    assert simhash.fingerprint((text + " " + "y" * 3_000_000).encode()) == slow_fingerprint(text + " " + "y" * 3_000_000)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_pairs_and_links_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(6)]
    some = set(base)
    for f in base:  # chains and balls around each, sign bit included
        for _ in range(12):
            f ^= 1 << rng.choice([0, 1, 2, 62, 63])
            some.add(f)
    signed = np.array(sorted(some), np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(f,) for f in signed], "fingerprint long")
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    found = [tuple(r) for r in simhash.pairs(rows, radius).collect()]
    assert len(found) == len(set(found)) and set(found) == want

    def parts(edges):
        top = {f: f for f in signed}
        for _ in signed:
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
        return top

    stars = {tuple(r) for r in simhash.links(rows, radius).collect()}
    assert stars <= want and parts(stars) == parts(want)


def test_odd_radius_is_an_error(spark):
    with pytest.raises(ValueError):
        simhash.variants(spark.createDataFrame([(1,)], "fingerprint long"), 3)
