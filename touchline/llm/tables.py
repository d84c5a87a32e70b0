"""Where the operators' queries read their tables and keep intermediate results."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from touchline.session import checkpoint_root

_noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one that the session names in ``spark.checkpoint.dir``."""
    folder = f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(folder)
    return folder


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written to a fresh shared folder and read again: cuts lineage and measures the size for the plans that follow."""
    spark = df.sparkSession
    folder = fresh_folder(spark, what)
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def noting(folders: list[str]) -> Iterator[None]:
    """Folders made inside are added to ``folders``."""
    token = _noted.set(folders)
    try:
        yield
    finally:
        _noted.reset(token)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete ``folders``, in whatever store they are; what is read from them later is lost."""
    while folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folders.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
