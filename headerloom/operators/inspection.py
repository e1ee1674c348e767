"""Inspection of files and recovery of names: candidates of each stage, what their results change, claims, merged parts, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerloom.functions import probes
from headerloom.operators.enrich import availability_tier

#: The names of the files that a stage looks at, and the key of which one file a release is enough.
_SET = r"(\.vol\d+\+\d+)?\.par2$"


def _stage(stage: str, name: Column) -> tuple[Column, Column]:
    low = F.lower(F.trim(name))
    return {
        "par2": (low.endswith(".par2"), F.regexp_replace(low, _SET, "")), "archive": (probes.is_archive(name), probes.family_key(name)),
        "media": (low.rlike(r"\.(mkv|mp4|avi|ts|mp3|flac|m4a)$") & ~low.contains("sample"), low), "nfo": (low.endswith(".nfo"), low),
    }[stage]


def candidates(files: DataFrame, results: DataFrame, stage: str, now, hours: int = 6, limit: int | None = None) -> DataFrame:
    """The complete files that a stage should look at: one of each set or family of a release, not yet done or due again.

    files: release_id, file_id, file_name, is_complete, posted_at; results: file_id, stage, status, details (JSON), at. Due again is what
    failed with a retryable error, ``hours`` ago or more. Of a family its representative comes first, then the shorter and lesser name.
    """
    fits, key = _stage(stage, F.col("file_name"))
    last = results.where(F.col("stage") == stage).groupBy("file_id").agg(F.max_by(F.struct("status", "details", "at"), "at").alias("last"))
    due = (F.col("last.status") == "failed") & (F.get_json_object("last.details", "$.error.retryable") == "true") & (F.timestamp_add("HOUR", F.lit(hours), F.col("last.at")) <= F.lit(now).cast("timestamp_ntz"))
    rows = files.where(fits & F.col("is_complete")).withColumn("set_key", key)
    order = F.struct((~probes.is_representative(F.col("file_name"))).alias("a"), F.length("file_name").alias("b"), F.col("file_name").alias("c"), F.col("file_id").alias("d"), F.col("posted_at").alias("e"))
    one = rows.groupBy("release_id", "set_key").agg(F.min_by(F.struct("file_id", "file_name", "posted_at"), order).alias("w")).select("release_id", "set_key", "w.*")
    found = one.join(last, "file_id", "left").where(F.col("last").isNull() | F.coalesce(due, F.lit(False))).select("release_id", "set_key", "file_id", "file_name", F.col("last").isNotNull().alias("again"), "posted_at")
    return found if limit is None else found.orderBy(F.desc_nulls_last("posted_at"), "file_id", "release_id", "set_key").limit(limit)


def backlog(files: DataFrame, results: DataFrame, stages: list[str], now) -> DataFrame:
    """stage, releases and files that wait, for each stage."""
    rows = [candidates(files, results, s, now).agg(F.lit(s).alias("stage"), F.count_distinct("release_id").alias("releases"), F.count("*").alias("files")) for s in stages]
    out = rows[0]
    for one in rows[1:]:
        out = out.unionByName(one)
    return out


def rolled_up(releases: DataFrame) -> DataFrame:
    """releases with availability after inspection and its tier: an unknown password caps it at 60 % of the completion, 25 at least; a known one restores the completion.

    releases: release_id, completion, availability, password_unknown, password_known.
    """
    within = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))
    done, now = within(F.col("completion")), within(F.col("availability"))
    score = F.when(F.col("password_unknown"), F.least(now, F.greatest(done * 0.6, F.lit(25.0)))).when(F.col("password_known") & (now < done), done).otherwise(F.col("availability"))
    return releases.withColumn("availability", score).withColumn("tier", availability_tier(within(score)))


def repair_coverage(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Per release: files that repair sets name, how many of them the release has, and their bytes.

    targets: release_id, name, size; files: release_id, file_name. Names are compared without case and path.
    """
    plain = lambda c: F.regexp_extract(F.lower(F.trim(F.regexp_replace(c, r"\\", "/"))), r"([^/]*)$", 1)
    named = targets.select("release_id", plain(F.col("name")).alias("key"), "size").groupBy("release_id", "key").agg(F.max("size").alias("size"))
    held = files.select("release_id", plain(F.col("file_name")).alias("key"), F.lit(True).alias("there")).distinct()
    return named.join(held, ["release_id", "key"], "left").groupBy("release_id").agg(F.count("*").alias("expected"), F.count("there").alias("present"), F.sum("size").alias("bytes"))


def claimed(work: DataFrame, limit: int) -> DataFrame:
    """Recovery work in the order of its claim: priority, newest minute, poster's and message's host, the rank within these and a group, newest, number, id.

    work: binary_id, group_id, priority, posted_at, updated_at, poster, message_id, article_number.
    """
    host = lambda c: F.when(c.contains("@"), F.lower(F.regexp_replace(F.split_part(c, F.lit("@"), F.lit(2)), "[^a-z0-9._-]", ""))).otherwise("")
    rows = work.withColumns({
        "minute": F.date_trunc("minute", F.coalesce("posted_at", "updated_at")), "poster_host": host(F.coalesce("poster", F.lit(""))),
        "message_host": host(F.regexp_replace(F.coalesce("message_id", F.lit("")), "^[<>]+|[<>]+$", "")),
    })
    newest = [F.desc_nulls_last("posted_at"), F.asc("article_number"), F.asc("binary_id")]
    rank = F.row_number().over(Window.partitionBy("group_id", "priority", "minute", "poster_host", "message_host").orderBy(*newest))
    return rows.withColumn("group_rank", rank).orderBy("priority", F.desc("minute"), "poster_host", "message_host", "group_rank", *newest).limit(limit)


def capacity(attempts: DataFrame, work: DataFrame, hours: float, multiplier: float, most: int, fallback: float) -> DataFrame:
    """One row: probes an hour over the window (attempts by active seconds), soft and hard caps, open work ready and running.

    Without attempts or active time the rate is ``fallback``.
    """
    rate = F.when((F.col("attempted") > 0) & (F.col("seconds") > 0), F.col("attempted") * 3600.0 / F.col("seconds")).otherwise(F.lit(float(fallback)))
    one = attempts.agg(F.coalesce(F.sum("attempted"), F.lit(0)).alias("attempted"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds")).select(rate.alias("rate"))
    soft = F.ceil(F.col("rate") * hours).cast("long")
    caps = one.select(F.round("rate", 4).alias("rate"), soft.alias("soft"), F.least(F.floor(soft * multiplier).cast("long"), F.lit(most).cast("long")).alias("hard"))
    counts = work.agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status").isin("ready", "running")).alias("open"))
    return caps.crossJoin(counts)  # two tables of one row each


def applied(parts: DataFrame, recovered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts under their recovered files, edges from each file to the one that takes its parts).

    parts: binary_id, part_number, bytes, article_id; recovered: binary_id, group_id, file_name, total_parts, file_size of the files whose headers
    were read. Files of one group, name, total and size are one: the least id keeps its own. Of copies of a number the largest, then the least article, stays.
    """
    name = F.lower(F.trim("file_name"))
    keyed = recovered.where((name != "") & (F.col("total_parts") > 0)).withColumn("key", F.sha2(F.concat_ws("|", F.col("group_id").cast("string"), name, F.col("total_parts").cast("string"), F.col("file_size").cast("string")), 256))
    target = keyed.groupBy("key").agg(F.min("binary_id").alias("target_id"))
    edges = keyed.join(target, "key").select("binary_id", "target_id", "total_parts")
    order = F.struct("bytes", (-F.col("article_id")).alias("a"))
    moved = parts.join(edges, "binary_id").where("part_number between 1 and total_parts")
    merged = moved.groupBy("target_id", "part_number").agg(F.max_by(F.struct("bytes", "article_id"), order).alias("w"), F.count("*").alias("copies")).select("target_id", "part_number", "w.*", "copies")
    return merged, edges.where("binary_id <> target_id").select("binary_id", "target_id")


def fed_back(cohorts: DataFrame, results: DataFrame, now, minutes: int = 30, least: int = 100) -> DataFrame:
    """cohorts with the counts of recovered and of identity-less results added; one without any recovered and ``least`` without identity cools down for some minutes.

    cohorts: cohort_key, recovered, no_identity, status, cooldown_until; results: cohort_key, recovered (boolean). One that recovers is active.
    """
    delta = results.groupBy("cohort_key").agg(F.count_if("recovered").alias("yes"), F.count_if(~F.col("recovered")).alias("no"))
    rows = cohorts.join(delta, "cohort_key", "left").fillna(0, ["yes", "no"])
    good, bad = F.col("recovered") + F.col("yes"), F.col("no_identity") + F.col("no")
    cools = (F.col("no") > 0) & (good == 0) & (bad >= least)
    until = F.timestamp_add("MINUTE", F.lit(minutes), F.lit(now).cast("timestamp_ntz"))
    return rows.select(
        "cohort_key", good.alias("recovered"), bad.alias("no_identity"), F.when(F.col("yes") > 0, "active").when(cools, "cooldown").otherwise(F.col("status")).alias("status"), F.when(cools, until).otherwise(F.col("cooldown_until")).alias("cooldown_until"),
    )


def admitted(work: DataFrame, soft: int, hard: int) -> DataFrame:
    """The files that recovery takes on, with rank and reason, best first, up to the hard cap.

    work: binary_id, name_known, is_opaque, total_parts, observed_parts, cohort_size, age_hours. Rank 0 are opaque files of a cohort of 20 or more, 1 those that lack
    a name but have parts, 2 the rest without a name; beyond the soft cap only rank 0 is taken.
    """
    open_ = ~F.col("name_known") & (F.col("observed_parts") > 0)
    rank = F.when(F.col("is_opaque") & (F.col("cohort_size") >= 20), 0).when(F.col("total_parts") > 1, 1).otherwise(2)
    reason = F.when(F.col("rank") == 0, "opaque_near_time").when(F.col("rank") == 1, "multipart_without_name").otherwise("backfill")
    score = F.col("cohort_size") * 1000 + F.least(F.lit(999), F.col("observed_parts"))
    rows = work.where(open_).withColumn("rank", rank)
    first = rows.orderBy("rank", F.desc(score), "age_hours", "binary_id").limit(hard)
    place = F.row_number().over(Window.orderBy("rank", F.desc(score), "age_hours", "binary_id"))  # the hard cap bounds these rows
    return first.withColumn("place", place).where((F.col("place") <= soft) | (F.col("rank") == 0)).select("binary_id", F.col("rank").cast("int").alias("rank"), reason.alias("reason"), score.alias("score"))
