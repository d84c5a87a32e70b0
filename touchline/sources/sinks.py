"""Writers: partitioned tables, JSON arrays, chapters with a manifest, XML, only what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)


def write_json_lines(df: DataFrame, path: str, compression: str = "bzip2") -> None:
    df.write.mode("overwrite").option("compression", compression).json(path)


def write_json_arrays(df: DataFrame, path: str, rows: int = 50_000) -> None:
    """Each part file is one JSON array, streamed row by row, of ``rows`` rows at most: one task has to read a file whole."""

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            if len(b):
                at = (np.arange(n, n + len(b))) % rows
                n += len(b)
                yield pd.DataFrame({"value": np.where(at == 0, "[", ",") + b["value"].to_numpy(object) + np.where(at == rows - 1, "]", "")})
        if n == 0 or n % rows:
            yield pd.DataFrame({"value": ["]" if n else "[]"]})

    lines = df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(wrap, "value string")
    lines.write.mode("overwrite").option("maxRecordsPerFile", rows).text(path)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, in whatever store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Append only partitions whose key is not in the table yet; what is there stays untouched. The first run writes all."""
    if holds_files(df.sparkSession, path):
        done = df.sparkSession.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    df.write.mode("append").partitionBy(key).parquet(path)


def fingerprints(df: DataFrame, key: str) -> DataFrame:
    """``(key, rows, digest)``: what the rows of each key are, whatever their order."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    other = F.xxhash64(F.lit(1), *sorted(df.columns)).cast("decimal(38,0)")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.sum(row).cast("string"), F.sum(other).cast("string")).alias("digest"))


def write_changed(inputs: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, key: str) -> None:
    """Bring the table at ``path``, partitioned by ``key``, up to date with ``inputs``: only keys whose input rows are not those
    that its ledger names are made anew, by ``make``, and replace their partitions; keys without input rows go.

    The ledger, a fingerprint of the input per key, is written after the data, each version to a folder of its own: a run
    that dies between the two makes the same partitions again.
    """
    spark, ledger = inputs.sparkSession, f"{path}/_ledger"
    kind = inputs.select(key).schema.add("rows", "long").add("digest", "string")
    before, version = spark.createDataFrame([], kind), 0
    if holds_files(spark, ledger):
        version = spark.read.schema(kind.add("version", "long")).parquet(ledger).agg(F.max("version")).first()[0]
        before = spark.read.schema(kind).parquet(f"{ledger}/version={version}")
    now = fingerprints(inputs, key)
    stale = now.join(before, [key, "rows", "digest"], "left_anti").select(key)
    make(inputs.join(stale, key, "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    for gone in before.join(now, key, "left_anti").select(key).toLocalIterator():  # one folder each
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={'__HIVE_DEFAULT_PARTITION__' if gone[0] is None else gone[0]}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    now.write.parquet(f"{ledger}/version={version + 1}")


def carry_manifest(fresh: DataFrame, prior: DataFrame, key: list[str], field: str) -> DataFrame:
    """New manifest that keeps one field of the manifest before it."""
    return fresh.join(prior.select(*key, field), key, "left")
