"""Output that knows its input."""

import json

import pytest
from pyspark.sql import functions as F

from touchline.sources import sinks

KIND = "k long, id long, v double"


def test_only_changed_keys_are_made_again(spark, tmp_path):
    path = f"{tmp_path}/table"

    def run(rows, name):
        made = []

        def make(d):
            made.extend(r.k for r in d.select("k").distinct().collect())
            return d.withColumn("run", F.lit(name))

        sinks.write_changed(spark.createDataFrame(rows, KIND), make, path, "k")
        return sorted(made), sorted((r.k, r.id, r.v, r.run) for r in spark.read.parquet(path).collect())

    first = [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.0), (3, 1, 5.0)]
    assert run(first, "a") == ([1, 2, 3], sorted((*r, "a") for r in first))
    assert run(first[::-1], "b") == ([], sorted((*r, "a") for r in first))  # the order of rows is no change
    second = [(1, 1, 1.0), (1, 2, 9.0), (2, 1, 1.0), (4, 1, 1.0)]  # 1 changed, 3 gone, 4 new
    assert run(second, "c") == ([1, 4], sorted((*r, "a" if r[0] == 2 else "c") for r in second))
    repeated = [*second, (2, 1, 1.0)]
    assert run(repeated, "d")[0] == [2]  # a repeated row is a change


def test_a_lost_ledger_makes_all_keys_again(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = spark.createDataFrame([(1, 1, 1.0)], KIND)
    rows.write.partitionBy("k").parquet(path)
    sinks.write_changed(rows.withColumn("v", F.lit(2.0)), lambda d: d, path, "k")
    assert [tuple(r) for r in spark.read.parquet(path).select("k", "v").collect()] == [(1, 2.0)]


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 14, 20])
def test_json_arrays_are_cut_into_files(spark, tmp_path, n):
    out = str(tmp_path / "arrays")
    sinks.write_json_arrays(spark.range(n).coalesce(1), out, 7)
    parts = [json.loads(f.read_text()) for f in sorted((tmp_path / "arrays").glob("part-*"))]
    assert [len(p) for p in parts if p] == [7] * (n // 7) + [n % 7] * (n % 7 > 0)
    assert sorted(r["id"] for p in parts for r in p) == list(range(n))
