import numpy as np
from pyspark.sql import functions as F

from touchline.llm import minhash
from touchline.llm.hashing import mixed


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_keys_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 2**64, n, np.uint64)) for n in (0, 1, 5, 47, 48, 49, 64, 65, 0, 300, 2000, 0)]
    at = np.append(0, np.cumsum([len(own) for own in sets]))
    keys, begins = minhash.keys_of_sets(np.concatenate(sets), at)
    for own, a, b in zip(sets, begins[:-1], begins[1:], strict=True):
        expected = []
        if 0 < len(own) <= minhash.SMALL:
            expected += mixed(own[: len(own) - -(-len(own) * 75 // 100) + 1] ^ np.uint64(0x5851F42D4C957F2D)).tolist()
        if len(own) > 48:
            bins = {}
            for x in own.tolist():
                bins.setdefault(x >> 64 - minhash.BIN_BITS, x)
            least = [bins[k] if k in bins else bins[next(d for d in minhash._donors()[k].tolist() if d in bins)] for k in range(minhash.BINS)]
            bands = np.array(least[: minhash.BANDS * minhash.BAND], np.uint64).reshape(-1, minhash.BAND)
            expected += mixed((bands * minhash._PLACE[: minhash.BAND]).sum(1) + np.arange(1, minhash.BANDS + 1, dtype=np.uint64) * minhash._PLACE[minhash.WORDS]).tolist()
        assert keys[a:b].tolist() == expected


def test_sieve_sends_no_text_to_python(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "none")], "id long, text string")
    some = minhash._sieved(rows, rows.select("id").where("id % 50 = 7"))
    assert {7, 57, 107, 157} <= {r.id for r in some.collect()} and some.count() < 20
    steps = [line for line in plan(some).splitlines() if "Python" in line or "MapInArrow" in line]
    assert len(steps) == 1 and "ArrowEvalPython" in steps[0] and "text" not in steps[0].split("[")[1]


def test_stars_need_no_join(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(int(k), int(r), int(r) * 10) for k, r in rng.integers(0, 40, (90, 2))})
    stars = minhash._stars(spark.createDataFrame(rows, "key long, rep long, n long").repartition(3))
    sizes = {k: sum(x[0] == k for x in rows) for k, _, _ in rows}
    shared = [x for x in rows if sizes[x[0]] > 1]
    meets = {r: sum(sizes[k] for k, x, _ in shared if x == r) for _, r, _ in shared}
    hubs = {k: min((x[1] for x in shared if x[0] == k), key=lambda r: (-meets[r], r)) for k, _, _ in shared}
    assert sorted(map(tuple, stars.collect())) == [(k, r, n, hubs[k], hubs[k] * 10) for k, r, n in shared]
    assert "Join" not in plan(stars) and len(set(sizes.values())) > 2


def test_members_that_meet_in_many_buckets_are_compared_once(spark, monkeypatch):
    stored = []

    def noted(df, what, **options):
        stored.append((what, df := df.cache()))
        return df

    monkeypatch.setattr(minhash, "written", noted)
    sets = {0: [*range(100)], 1: [*range(80), *range(1000, 1020)], 2: [*range(80), *range(1000, 1019), 2000], 3: [*range(20, 100), *range(3000, 3020)]}
    held = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes())) for i, s in sets.items()], "id long, shingles binary")
    rest = spark.createDataFrame([(key, rep, 100, rep, 0, 100) for key in range(11, 16) for rep in (1, 2, 3)], "key long, rep long, n long, c long, hub long, hub_n long")
    assert list(map(tuple, minhash._unsettled(rest, held).collect())) == [(1, 2, True)]
    members = next(df for what, df in stored if what == "members-of-hubs")
    assert sorted((r.hub, r.rep, sorted(r["keys"])) for r in members.collect()) == [(0, rep, [*range(11, 16)]) for rep in (1, 2)]
    assert members.groupBy("hub", "rep").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
