"""Upkeep analytics: group profiles, daily statistics, popularity, audits, retention and purge sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_profiles(articles: DataFrame, binaries: DataFrame, releases: DataFrame, recovery: DataFrame) -> DataFrame:
    """Score and tier of each group from four aggregates by group_id.

    Score: 1000 a release, 1 a binary, 10000 times binaries by articles, 250 times the recovery rate, less
    queued work (a hundredth by release, or a thousandth without). recovery: group_id, ok, queued.
    """
    a = articles.groupBy("group_id").agg(F.count("*").alias("articles"))
    b = binaries.groupBy("group_id").agg(F.count("*").alias("binaries"))
    r = releases.groupBy("group_id").agg(F.count("*").alias("releases"))
    y = recovery.groupBy("group_id").agg(F.count_if(~F.col("queued")).alias("attempted"), F.count_if("ok").alias("ok"), F.count_if("queued").alias("queued"))
    rows = a.join(b, "group_id", "left").join(r, "group_id", "left").join(y, "group_id", "left").na.fill(0)
    rate = F.when(F.col("attempted") > 0, F.col("ok") / F.col("attempted")).otherwise(0.0)
    load = F.when(F.col("releases") > 0, F.col("queued") / F.col("releases") / 100).otherwise(F.col("queued") / 1000)
    score = F.round(1000 * F.col("releases") + F.col("binaries") + 10000 * F.col("binaries") / F.col("articles") + 250 * rate - load, 4)
    tier = F.when((F.col("releases") >= 5) & (F.col("score") >= 750), "hot").when((F.col("releases") >= 1) | (F.col("binaries") >= 250), "warm").when((F.col("queued") >= 10000) & (F.col("releases") == 0), "cold").otherwise("warm")
    return rows.withColumn("score", score).withColumn("tier", tier)


def daily_statistics(rows: DataFrame) -> DataFrame:
    """Per day and kind: rows, those flagged, share of flagged clamped to 0..1, sum of values. rows: at, kind, flagged, value."""
    found = rows.groupBy(F.to_date("at").alias("day"), "kind").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"), F.round(F.sum("value"), 2).alias("total"))
    return found.withColumn("share", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("flagged") / F.col("n"))), 4))


def day_boundaries(rows: DataFrame) -> DataFrame:
    """Per group and day: lowest and highest article with whether the range of ids crosses into the next day."""
    day = rows.groupBy("group_id", F.to_date("at").alias("day")).agg(F.min("article").alias("low"), F.max("article").alias("high"), F.count("*").alias("seen"))
    after = day.select("group_id", F.date_sub("day", 1).alias("day"), F.col("low").alias("__next"))
    both = day.join(after, ["group_id", "day"], "left")
    return both.select("group_id", "day", "low", "high", "seen", F.coalesce(F.col("__next") <= F.col("high"), F.lit(False)).alias("crosses"))


def popularity(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts by group with a delta added: rows of (group_name, articles, posters)."""
    return stored.unionByName(delta).groupBy("group_name").agg(F.sum("articles").alias("articles"), F.sum("posters").alias("posters"))


def age_audit(rows: DataFrame, as_of) -> DataFrame:
    """Rows by status and age bucket at ``as_of``."""
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3_600_000_000
    bucket = F.when(hours < 24, "<24h").when(hours < 72, "24-72h").when(hours < 168, "72h-7d").when(hours < 720, "7d-30d").otherwise(">30d")
    return rows.groupBy("status", bucket.alias("age")).agg(F.count("*").alias("n"))


def purge_set(archived: DataFrame, superseded: DataFrame, referenced: DataFrame) -> DataFrame:
    """item_id of what may be purged: archived or superseded, and not referenced any more."""
    return archived.select("item_id").unionByName(superseded.select("item_id")).distinct().join(referenced.select("item_id"), "item_id", "left_anti")


def retention_blockers(days: DataFrame, **open_work: DataFrame) -> DataFrame:
    """Per day the rows of each kind of open work, and whether its partition can be dropped. days and work: day."""
    out = days.select("day").distinct()
    for name, rows in open_work.items():
        out = out.join(rows.groupBy("day").agg(F.count("*").alias(name)), "day", "left")
    out = out.na.fill(0, list(open_work))
    free = F.lit(True)
    for name in open_work:
        free = free & (F.col(name) == 0)
    return out.withColumn("droppable", free)
