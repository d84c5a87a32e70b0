"""Fresh folders for tables a job writes and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from touchline.session import checkpoint_root


def scratch(spark: SparkSession, name: str) -> str:
    """New folder under the folder that driver and executors share."""
    return f"{checkpoint_root(spark)}/touchline-{uuid.uuid4().hex}/{name}"
