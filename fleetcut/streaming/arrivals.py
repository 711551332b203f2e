"""Arriving projects: the batch operators on each micro-batch of a stream of files, with repeatable writes of the touched buckets only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetcut.operators.candidates import merge_cuts, resolve_overlaps
from fleetcut.operators.intervals import PID

CUT_COLUMNS = (PID, "cut_id", "start_ms", "end_ms", "reason", "confidence", "status", "note")
BUCKETS = 1024


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(PID), F.lit(buckets)).cast("int")


def on_arrival(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run handle(rows, batch id) on each micro-batch. A batch that is run again has the same id, so handle can be made repeatable."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def seed_cuts(cuts: DataFrame, cuts_path: str, buckets: int = BUCKETS) -> None:
    """Lay the reviewed cuts out as bucket=<hash of the project>/version=<batch>, version 0."""
    rows = cuts.select(*CUT_COLUMNS).withColumn("bucket", bucket_of(buckets)).withColumn("version", F.lit(0).cast("bigint"))
    rows.write.partitionBy("bucket", "version").parquet(cuts_path)


def latest_cuts(table: DataFrame, before: int | None = None) -> DataFrame:
    """The rows of each bucket's newest version (older than `before`, if given) of a table read from its root."""
    rows = table if before is None else table.filter(F.col("version") < before)
    last = rows.groupBy("bucket").agg(F.max("version").alias("version"))  # BUCKETS rows at most
    return rows.join(F.broadcast(last), ["bucket", "version"], "left_semi").select(*CUT_COLUMNS)


def refresh_cuts(cuts_path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A handler that merges arriving candidates into the reviewed cuts: version batch id + 1 of the buckets that hold their projects.

    Buckets without candidates are neither read nor written. Judged cuts keep their verdicts (merge_cuts). A batch that is run again
    starts from the versions before it and replaces its own.
    """

    def handle(candidates: DataFrame, batch: int) -> None:
        spark = candidates.sparkSession
        touched = [r["bucket"] for r in candidates.select(bucket_of(buckets).alias("bucket")).distinct().collect()]  # `buckets` rows at most
        if not touched:
            return
        table = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in spark.read.parquet(cuts_path).schema)}").parquet(cuts_path)
        before = latest_cuts(table.filter(F.col("bucket").isin(touched)), batch + 1)
        named = candidates.select(PID).distinct()
        merged = resolve_overlaps(merge_cuts(before.join(named, PID, "left_semi"), candidates)).select(*CUT_COLUMNS)
        rows = merged.unionByName(before.join(named, PID, "left_anti"))
        rows = rows.withColumn("bucket", bucket_of(buckets)).withColumn("version", F.lit(batch + 1).cast("bigint"))
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "version").parquet(cuts_path)

    return handle
