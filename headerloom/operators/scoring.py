"""Scores of releases from the files of their clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.operators.enrich import availability


def identity_status(score: Column, title_source: Column, title_confidence: Column, is_readable: Column) -> Column:
    """identified, probable or unknown: a trusted title source decides before the score does."""
    trusted = ~F.coalesce(title_source, F.lit("")).isin("", "source")
    sure = F.coalesce(title_confidence, F.lit(0.0))
    return (
        F.when(trusted & (sure >= 0.90), "identified").when(trusted & (sure >= 0.70), "probable").when(is_readable & (score >= 75), "identified").when(score >= 55, "probable").otherwise("unknown")
    )


def media_quality_tier(score: Column) -> Column:
    return F.when(score >= 85, "premium").when(score >= 65, "good").when(score >= 45, "standard").otherwise("unknown")


def release_scores(files: DataFrame) -> DataFrame:
    """Per release: completion, availability, identity, dominant poster with its share, posting span and classification.

    files: release_id, poster, posted_at, confidence, observed_parts, total_parts, expected_files, kind (archive,
    video, audio, par or other). Files are counted by release and poster first, so the poster's share
    needs no second pass over the files and a hot release is combined before its shuffle.
    """
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    by_poster = files.groupBy("release_id", "poster").agg(
        F.count("*").alias("n"), F.min("posted_at").alias("first_at"), F.max("posted_at").alias("last_at"), F.sum(F.round(F.col("confidence") * 10000).cast("long")).alias("confidence"),
        F.sum("observed_parts").alias("observed"), F.sum("total_parts").alias("total"), F.max("expected_files").alias("expected"), *[n(k) for k in ("archive", "video", "audio", "par")],
    )
    one = by_poster.groupBy("release_id").agg(
        F.sum("n").alias("file_count"), F.min_by("poster", F.struct(-F.col("n"), F.col("poster"))).alias("dominant_poster"), F.max("n").alias("poster_files"), F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"), *[F.sum(c).alias(c) for c in ("confidence", "observed", "total", "archive", "video", "audio", "par")], F.coalesce(F.max("expected"), F.lit(0)).alias("expected"),
    )
    share = lambda a, b: F.when(b > 0, F.least(F.lit(100.0), 100.0 * a / b)).otherwise(F.lit(100.0))
    average = F.col("confidence") / 10000 / F.col("file_count")
    completion = F.least(share(F.col("observed"), F.col("total")), share(F.col("file_count"), F.col("expected")))
    hours = (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 3_600_000_000
    ratio = F.col("poster_files") / F.col("file_count")
    many = F.col("file_count") > 1
    cluster = (
        F.lit(0.20) + 0.30 * average + F.when(many & (ratio >= 0.75), 0.14).otherwise(0.0) + F.when(~many, 0.0).when(hours <= 2, 0.14).when(hours <= 12, 0.09).when(hours <= 24, 0.04).otherwise(0.0)
        + F.when(F.col("par") > 0, 0.10).otherwise(0.0) + F.when((F.col("archive") > 0) & (F.col("video") + F.col("audio") > 0), 0.06).otherwise(0.0)
        + F.when(completion >= 95, 0.06).when(completion >= 75, 0.04).when(completion >= 50, 0.02).otherwise(0.0)
    )
    kind = F.when((F.col("video") > 0) & (F.col("archive") > 0), "video_archive").when(F.col("video") > 0, "video").when(F.col("audio") > 0, "audio").when(F.col("archive") > 0, "archive").when(F.col("par") > 0, "repair_set").otherwise("misc")
    return one.select(
        "release_id", "file_count", "dominant_poster", F.round(ratio, 4).alias("poster_ratio"), F.round(hours, 4).alias("span_hours"), F.round(completion, 4).alias("completion"),
        F.round(F.least(F.lit(100.0), availability(completion, F.col("par") > 0, F.col("file_count"), average)), 4).alias("availability"),
        F.round(60 * F.least(F.lit(1.0), cluster) + 40 * average, 4).alias("identity"), kind.alias("classification"),
    )
