"""Places of rows in their group and digests of a group's rows in order, for groups of any size.

Rows are dealt by ranges of (group, order), so a large group lies in many tasks one after the other. What a task cannot
know alone, how many rows of its first group stand in tasks before it, is one small row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.tables import written

#: Bytes that are put together before they are handed on; larger values go alone.
PACK_BYTES = 1 << 16


def with_places(rows: DataFrame, group: str, coarse: list[Column], fine: list[Column]) -> DataFrame:
    """``rows`` with ``place``, from 0, among the rows of equal ``group`` (not null), by ``coarse``, then ``fine``.

    ``coarse`` deals the rows to tasks, so its values should be short; rows equal in it pass through one task in a stream.
    """
    kind = T.StructType([*rows.schema.fields, T.StructField("__task", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, upto = None, 0
        for batch in batches:
            places = []
            for key in batch.column(group).to_pylist():
                last, upto = key, upto + 1 if key == last else 1
                places.append(upto - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])

    dealt = rows.repartitionByRange(F.col(group), *coarse).sortWithinPartitions(F.col(group), *coarse, *fine)
    dealt = written(dealt.withColumn("__task", F.spark_partition_id().cast("bigint")).mapInArrow(run, kind), "places")
    # only the first group of a task can have begun before it; a row per task is left
    ends = dealt.groupBy("__task").agg(F.min(group).alias("__first"), F.max(group).alias("__last"))
    held = dealt.join(F.broadcast(ends), "__task").where((F.col(group) == F.col("__first")) | (F.col(group) == F.col("__last")))
    held = held.groupBy(group, "__task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    ahead = held.select(group, "__task", before.alias("__ahead")).where("__ahead IS NOT NULL")
    out = dealt.join(F.broadcast(ahead), [group, "__task"], "left")
    return out.select(*rows.columns, (F.col("place") + F.coalesce("__ahead", F.lit(0))).alias("place"))


def digests(rows: DataFrame, group: str, order: str, value: str, separator: bytes) -> DataFrame:
    """``(group, sha256)``: lower-case hex SHA-256 of the binary ``value`` of a group's rows in ``order``, joined.

    Groups within one task are done there. Of a group that may go on in another task, or that is large, packs of bytes
    are handed on; a digest is made of bytes in sequence, so one task takes a group's packs, one at a time.
    """
    key = rows.schema[group].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size, sent, first, out, key_type = None, [], 0, 0, True, [], None

        def flush(done: bool) -> None:
            nonlocal parts, size, sent
            data = separator.join(parts)
            out.append((now, hashlib.sha256(data).hexdigest() if done else None, None if done else data, sent))
            parts, size, sent = [], 0, sent + 1

        def made() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (key_type, pa.string(), pa.binary(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["group", "sha256", "pack", "n"])

        for batch in batches:
            key_type = batch.column("group").type
            for g, v in zip(batch.column("group").to_pylist(), batch.column("value").to_pylist()):
                if g != now:
                    if parts:
                        flush(done=not first and sent == 0)
                    first, now, sent = now is None, g, 0
                elif size > PACK_BYTES:
                    flush(done=False)
                parts.append(v)
                size += len(v) + len(separator)
            if out:
                yield made()
        if parts:
            flush(done=False)
            yield made()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type, group_now, state = None, None, None
        for batch in batches:
            key_type, found = batch.column("group").type, []
            for g, v in zip(batch.column("group").to_pylist(), batch.column("pack").to_pylist()):
                if state is not None and g == group_now:
                    state.update(separator)
                else:
                    if state is not None:
                        found.append((group_now, state.hexdigest()))
                    group_now, state = g, hashlib.sha256()
                state.update(v)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], key_type), pa.array([d for _, d in found])], names=["group", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group_now], key_type), pa.array([state.hexdigest()])], names=["group", "sha256"])

    named = rows.select(F.col(group).alias("group"), F.col(order).alias("at"), F.col(value).alias("value"))
    dealt = named.repartitionByRange("group", "at").sortWithinPartitions("group", "at")
    kind = T.StructType([T.StructField("group", key), T.StructField("sha256", T.StringType()), T.StructField("pack", T.BinaryType()), T.StructField("n", T.LongType())])
    packs = dealt.select("group", "value").mapInArrow(pack, kind)
    packs = written(packs.withColumn("task", F.spark_partition_id()), "packs")
    some = packs.where("sha256 IS NULL").repartition("group").sortWithinPartitions("group", "task", "n")
    small = T.StructType([T.StructField("group", key), T.StructField("sha256", T.StringType())])
    rest = some.select("group", "pack").mapInArrow(chain, small)
    return packs.where("sha256 IS NOT NULL").select("group", "sha256").union(rest).withColumnRenamed("group", group)
