"""Cohorts for scheduling, claim order and recovery capacity: which rows would be taken, in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headerloom.functions.text import micros


def near_time_cohorts(headers: DataFrame, seconds: int = 300, least: int = 20) -> DataFrame:
    """Opaque headers of one group and poster in one stretch of time, scored 1000 a header and up to 999 for megabytes.

    headers: group_id, poster, posted_at, bytes.
    """
    bucket = F.floor(micros(F.col("posted_at")) / (seconds * 1_000_000)).cast("long")
    found = headers.groupBy("group_id", "poster", bucket.alias("bucket")).agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    return found.where(F.col("members") >= least).withColumn("score", F.col("members") * 1000 + F.least(F.lit(999), F.floor(F.col("bytes") / 1_000_000)).cast("long"))


def cohort_members(headers: DataFrame, cohorts: DataFrame, seconds: int = 300) -> DataFrame:
    """Headers of the cohorts, each header once (the best cohort) and each message once (the smallest header)."""
    bucket = F.floor(micros(F.col("posted_at")) / (seconds * 1_000_000)).cast("long")
    rows = headers.withColumn("bucket", bucket).join(cohorts.select("group_id", "poster", "bucket", "score"), ["group_id", "poster", "bucket"])
    one = Window.partitionBy("header_id").orderBy(F.desc("score"), "bucket")
    rows = rows.withColumn("__a", F.row_number().over(one)).where("__a = 1")
    same = Window.partitionBy("group_id", "message_key").orderBy("header_id")
    return rows.withColumn("__b", F.row_number().over(same)).where("__b = 1").select("header_id", "group_id", "poster", "bucket", "score")


def subject_complete_cohorts(parts: DataFrame) -> DataFrame:
    """Subject sets all of whose parts are seen: parts have set_key, part_number, part_total; the cohort key is an md5."""
    found = parts.groupBy("set_key").agg(F.count_distinct("part_number").alias("seen"), F.max("part_total").alias("total"))
    found = found.where(F.col("seen") >= F.col("total"))
    return found.select(F.md5(F.col("set_key").cast("binary")).alias("cohort_key"), "seen", "total", F.least(F.lit(1_000_000).cast("long"), F.col("seen") * 1000).alias("score"))


def claim_lanes(queue: DataFrame, completion: DataFrame, limit: int) -> DataFrame:
    """The next ``limit`` rows: lane A completes known files (same group and name, day within -1 and +1), lane B is the rest by age."""
    known = completion.select("group_id", "name_key", F.explode(F.array(F.col("day"), F.date_add("day", 1))).alias("day")).distinct().withColumn("__known", F.lit(True))
    rows = queue.join(known, ["group_id", "name_key", "day"], "left").withColumn("lane", F.when(F.col("__known"), "A").otherwise("B"))
    return rows.orderBy("lane", "day", "row_id").limit(limit).select("lane", "row_id", "group_id", "day")


def claim_locality(work: DataFrame, per_group: int, limit: int) -> DataFrame:
    """At most ``per_group`` rows a group, by priority and age, then the first ``limit`` of all."""
    inside = Window.partitionBy("group_id").orderBy(F.desc("priority"), "ready_at", "row_id")
    rows = work.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= per_group)
    return rows.orderBy(F.desc("priority"), "ready_at", "row_id").limit(limit).select("row_id", "group_id", "priority", "place")


def fairness_bucket(work: DataFrame, cursor, horizon, seconds: int) -> DataFrame:
    """One row: the newest eligible time before the cursor and not before the horizon, floored to the bucket."""
    newest = work.where((F.col("ready_at") < cursor) & (F.col("ready_at") >= horizon)).agg(F.max("ready_at").alias("newest"))
    return newest.select((F.floor(micros(F.col("newest")) / (seconds * 1_000_000)) * seconds).cast("long").alias("bucket_epoch"))


def recovery_capacity(work: DataFrame, soft_hours: int, per_hour: int, hard_cap: int) -> DataFrame:
    """One row: open and ready work, what the soft and hard caps leave to admit."""
    sums = work.agg(F.count_if("is_open").alias("open_count"), F.count_if(F.col("is_open") & F.col("is_ready")).alias("ready_count"), F.count_if(~F.col("is_open")).alias("done_count"))
    soft = F.lit(soft_hours * per_hour)
    return sums.select("*", F.greatest(F.lit(0), soft - F.col("open_count")).cast("long").alias("soft_room"), F.greatest(F.lit(0), F.least(F.lit(hard_cap), 2 * soft) - F.col("open_count")).cast("long").alias("hard_room"))
