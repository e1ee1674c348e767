"""Logical parts of a file and the statistics built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def logical_parts(physical: DataFrame) -> DataFrame:
    """One row per (binary_id, part_number): the largest copy, then the smallest article_id, then the earliest.

    Further copies of a part never raise a file's completion. The winner is taken by an aggregate,
    so copies of one part are combined before the shuffle.
    """
    best = F.min_by(
        F.struct("segment_bytes", "article_id", "posted_at"),
        F.struct((-F.col("segment_bytes")).alias("b"), F.col("article_id").alias("a"), F.col("posted_at").alias("t")),
    )
    return physical.groupBy("binary_id", "part_number").agg(best.alias("w")).select("binary_id", "part_number", "w.*")


def observation_stats(physical: DataFrame, roots: DataFrame) -> DataFrame:
    """Per file: observed parts, bytes, declared total, first posting time, completeness by equality.

    physical: binary_id, part_number, segment_bytes, article_id, posted_at. roots: binary_id, root_posted_at.
    A file without parts keeps zero counts and its root's own posting time.
    """
    stats = logical_parts(physical).groupBy("binary_id").agg(
        F.count("part_number").alias("observed_parts"),
        F.sum("segment_bytes").alias("total_bytes"),
        F.max("part_number").alias("total_parts"),
        F.min("posted_at").alias("posted_at"),
    )
    observed, total = F.coalesce("observed_parts", F.lit(0).cast("long")), F.coalesce("total_parts", F.lit(0)).cast("int")
    return roots.join(stats, "binary_id", "left").select(
        "binary_id",
        observed.alias("observed_parts"),
        F.coalesce("total_bytes", F.lit(0).cast("long")).alias("total_bytes"),
        total.alias("total_parts"),
        F.coalesce("posted_at", "root_posted_at").alias("posted_at"),
        ((observed > 0) & (observed == total)).alias("is_complete"),
    )
