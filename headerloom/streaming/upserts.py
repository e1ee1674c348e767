"""Continuous aggregates kept as a keyed table: each micro-batch writes the keys that it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_changes(changes: DataFrame, target: str, checkpoint: str):
    """Starts the stream in update mode; batch N overwrites ``target/batch=N``, so a retried batch leaves no second copy."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def current(spark, target: str, keys: list[str], schema: str) -> DataFrame:
    """The newest row of each key over all batches written so far."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(target)
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("w")).select(*keys, "w.*")


def bucket_counts(events: DataFrame, at: str, length: str, late: str, *keys: str, measure: Column) -> DataFrame:
    """Rows and the sum of ``measure`` per key and tumbling window; state older than ``late`` is dropped."""
    return (
        events.withWatermark(at, late).groupBy(*keys, F.window(at, length).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(measure).alias("total")).select(*keys, F.col("w.start").alias("window_start"), "n", "total")
    )


def sliding_counts(events: DataFrame, at: str, length: str, slide: str, late: str, *keys: str) -> DataFrame:
    """Rows per key and sliding window; rows later than ``late`` behind the newest seen are dropped with their state."""
    return events.withWatermark(at, late).groupBy(*keys, F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def write_dirty(changes: DataFrame, keys: list[str], at: str, target: str, checkpoint: str):
    """Starts a stream that keeps, for each batch, the distinct keys that it touched and their latest time; a retried batch overwrites its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.max(at).alias("dirty_at")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def dirty_keys(spark, target: str, keys: list[str], schema: str, since: int = -1) -> DataFrame:
    """The keys that batches after ``since`` touched, once each, with their latest time."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(target).where(F.col("batch") > since)
    return rows.groupBy(*keys).agg(F.max("dirty_at").alias("dirty_at"))


def compacted(spark, target: str, keys: list[str], schema: str, onto: str) -> DataFrame:
    """current() written as one table under ``onto``, so that later reads need not go through every batch."""
    current(spark, target, keys, schema).write.mode("overwrite").parquet(onto)
    return spark.read.schema(schema).parquet(onto)
