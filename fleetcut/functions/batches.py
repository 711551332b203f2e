"""Sizes of the Arrow batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bound the bytes of an Arrow batch besides its rows, as long texts would make batches of any size, of which the JVM and the worker each hold several. A
    lower limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(key, str(limit))
