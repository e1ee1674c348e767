"""Families of files: their summary, the bucket that says what can be done with them, candidate file sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def family_summary(files: DataFrame) -> DataFrame:
    """Per family: counts, coverage and the dominant kind (most files, then the smaller name).

    files: family_key, kind, is_main, is_complete, expected_files. Files are counted by family and kind
    first, so the second aggregate sees a few rows a family however many files it has.
    """
    main = F.col("is_main") & F.col("is_complete")
    by_kind = files.groupBy("family_key", "kind").agg(
        F.count("*").alias("n"), F.count_if("is_main").alias("main"), F.count_if(main).alias("complete_main"),
        F.count_if("is_complete").alias("complete"), F.max("expected_files").alias("expected"),
    )
    total = by_kind.groupBy("family_key").agg(
        F.sum("n").alias("binary_count"), F.sum("main").alias("main_count"), F.sum("complete_main").alias("complete_main_count"),
        F.sum("complete").alias("complete_count"), F.coalesce(F.max("expected"), F.lit(0)).alias("expected_file_count"),
        F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("dominant_kind"),
    )
    coverage = F.when(F.col("expected_file_count") > 0, F.least(F.lit(1.0), F.col("complete_count") / F.col("expected_file_count"))).otherwise(F.lit(0.0))
    return total.withColumn("coverage", coverage)


def readiness_bucket(summary: DataFrame) -> DataFrame:
    """The summary with ``bucket``; a weak single file overrides actionable, a weak kind replaces only actionable."""
    single = (F.col("binary_count") == 1) & (F.col("complete_main_count") == 1) & (F.col("expected_file_count") == 0)
    bucket = (
        F.when(F.col("binary_count") == 0, "stale_cleanup_only")
        .when(single, "weak_single_binary")
        .when((F.col("complete_main_count") > 0) & F.col("dominant_kind").isin("numeric_obfuscated_set", "opaque_set"), "weak_obfuscated_set")
        .when(F.col("complete_main_count") > 0, "actionable")
        .otherwise("fragment_only")
    )
    return summary.withColumn("bucket", bucket)


def family_shape(files: DataFrame) -> DataFrame:
    """Per family: whether all files are complete, distinct complete indexes and groups, span of posting times in hours."""
    return files.groupBy("family_key").agg(
        F.bool_and("is_complete").alias("all_complete"),
        F.count_distinct(F.when(F.col("is_complete"), F.col("file_index"))).alias("complete_indexes"),
        F.count_distinct("group_id").alias("group_count"),
        F.floor((F.unix_micros(F.max("posted_at").cast("timestamp")) - F.unix_micros(F.min("posted_at").cast("timestamp"))) / 3_600_000_000).alias("span_hours"),
    )


def fileset_candidates(files: DataFrame, hours: int, least: int = 2) -> DataFrame:
    """File sets with more than one distinct file that were posted within ``hours``; groups > 1 bridge newsgroups."""
    shape = files.groupBy("file_set_key").agg(
        F.count_distinct("binary_id").alias("binary_count"), F.count_distinct("group_id").alias("group_count"),
        F.min("posted_at").alias("first_at"), F.max("posted_at").alias("last_at"),
    )
    near = F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp")) <= hours * 3_600_000_000
    return shape.where((F.col("binary_count") >= least) & near).withColumn("bridges_groups", F.col("group_count") > 1)


def members_by_key_kind(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Files of candidates whose key is a family or a base stem: two equi-joins in place of one with OR."""
    family = candidates.where("key_kind = 'release_family'").join(files, F.col("key") == F.col("family_key"))
    stem = candidates.where("key_kind = 'base_stem'").join(files, F.col("key") == F.lower("base_stem"))
    pick = lambda df: df.select("key_kind", "key", "binary_id")
    return pick(family).unionByName(pick(stem))
