"""Queries on families of files and on cohorts of headers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from headerloom.functions import text
from headerloom.operators import cohorts, readiness
from headerloom.plans.views import FILES, HEADERS, SUBJECTS, WORK, files, headers, subjects, work
from headerloom.sources.tables import table

CURSOR, HORIZON = dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 5)


def readiness_summary(spark, sf_dir):
    return readiness.family_summary(files(spark, sf_dir)).withColumn("coverage", F.round("coverage", 4))


def readiness_bucket(spark, sf_dir):
    return readiness.readiness_bucket(readiness.family_summary(files(spark, sf_dir))).select("family_key", "binary_count", "dominant_kind", "bucket")


def family_shape(spark, sf_dir):
    return readiness.family_shape(files(spark, sf_dir))


def fileset_candidates(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("file_set_key", F.concat_ws("/", "family_key", F.year("posted_at").cast("string")))
    return readiness.fileset_candidates(rows, 24 * 60)


def base_stem_split_join(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("binary_id"), F.lower("p_brand").alias("family_key"), F.upper("p_name").alias("base_stem"))
    family = part.select(F.lit("release_family").alias("key_kind"), F.col("family_key").alias("key"))
    stem = part.select(F.lit("base_stem").alias("key_kind"), F.lower("base_stem").alias("key"))
    return readiness.members_by_key_kind(family.unionByName(stem).distinct(), part).groupBy("key_kind", "key").agg(F.count("*").alias("files"), F.min("binary_id").alias("first_binary"), F.max("binary_id").alias("last_binary"))


def near_time_cohorts(spark, sf_dir):
    return cohorts.near_time_cohorts(headers(spark, sf_dir), 3600, 2)


def cohort_members(spark, sf_dir):
    rows = headers(spark, sf_dir)
    return cohorts.cohort_members(rows, cohorts.near_time_cohorts(rows, 3600, 2), 3600)


def subject_complete_cohorts(spark, sf_dir):
    rows = subjects(spark, sf_dir).select("l_orderkey", "subject")
    c = text.counters(F.col("subject"))
    parts = rows.select(F.col("l_orderkey").cast("string").alias("set_key"), c["part_number"].alias("part_number"), c["part_total"].alias("part_total"))
    return cohorts.subject_complete_cohorts(parts)


def claim_lanes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    queue = o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 5).alias("group_id"), (F.col("o_custkey") % 50).alias("name_key"), F.to_date("o_orderdate").alias("day"))
    done = o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") % 5).alias("group_id"), ((F.col("o_custkey") + 1) % 50).alias("name_key"), F.to_date("o_orderdate").alias("day"))
    return cohorts.claim_lanes(queue, done, 500).withColumn("day", F.col("day").cast("string"))


def claim_locality_order(spark, sf_dir):
    return cohorts.claim_locality(work(spark, sf_dir), 30, 400)


def fairness_bucket(spark, sf_dir):
    return cohorts.fairness_bucket(work(spark, sf_dir).where("is_open"), CURSOR, HORIZON, 3600)


def recovery_capacity(spark, sf_dir):
    return cohorts.recovery_capacity(work(spark, sf_dir), 4, 25_000, 250_000)


def subject_parse(spark, sf_dir):
    c = text.counters(F.col("subject"))
    return subjects(spark, sf_dir).groupBy(*[v.alias(k) for k, v in c.items()]).agg(F.count("*").alias("n"))


def normalize_key(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    key = text.normalize_key(F.col("text"))
    return rows.select("item_id", key.alias("key"), text.search_title(F.col("text")).alias("search_title"), text.is_opaque(key).alias("opaque"))


def posting_window(spark, sf_dir):
    return headers(spark, sf_dir).groupBy(text.posting_window(F.col("posted_at")).alias("window"), F.floor(F.col("header_id") / 5000).cast("long").alias("article_bucket")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        readiness_summary, readiness_bucket, family_shape, fileset_candidates, base_stem_split_join, near_time_cohorts, cohort_members,
        subject_complete_cohorts, claim_lanes, claim_locality_order, fairness_bucket, recovery_capacity, subject_parse, normalize_key, posting_window,
    )
}

_SUMMARY = f"""{FILES},
totals AS (
  SELECT family_key, count(*) AS binary_count, count(*) FILTER (is_main) AS main_count, count(*) FILTER (is_main AND is_complete) AS complete_main_count,
         count(*) FILTER (is_complete) AS complete_count, CAST(coalesce(max(expected_files), 0) AS INTEGER) AS expected_file_count
  FROM files GROUP BY family_key),
kinds AS (
  SELECT family_key, kind AS dominant_kind, row_number() OVER (PARTITION BY family_key ORDER BY count(*) DESC, kind) AS place
  FROM files GROUP BY family_key, kind),
summary AS (
  SELECT t.*, dominant_kind FROM totals t JOIN kinds k ON t.family_key = k.family_key AND place = 1)"""
_NEAR = f"""{HEADERS},
cohorts AS (
  SELECT group_id, poster, CAST(floor(epoch(posted_at) / 3600) AS BIGINT) AS bucket, count(*) AS members, CAST(sum(bytes) AS BIGINT) AS bytes
  FROM headers GROUP BY ALL HAVING count(*) >= 2),
scored AS (
  SELECT *, CAST(members * 1000 + least(999, CAST(floor(bytes / 1000000) AS BIGINT)) AS BIGINT) AS score FROM cohorts)"""

ORACLE_SQL = {
    "readiness_summary": f"""WITH {_SUMMARY}
        SELECT family_key, binary_count, main_count, complete_main_count, complete_count, expected_file_count, dominant_kind,
               round(CASE WHEN expected_file_count > 0 THEN least(1.0::DOUBLE, complete_count::DOUBLE / expected_file_count) ELSE 0.0::DOUBLE END, 4) AS coverage
        FROM summary""",
    "readiness_bucket": f"""WITH {_SUMMARY}
        SELECT family_key, binary_count, dominant_kind,
               CASE WHEN binary_count = 1 AND complete_main_count = 1 AND expected_file_count = 0 THEN 'weak_single_binary'
                    WHEN complete_main_count = 0 THEN 'fragment_only'
                    WHEN dominant_kind IN ('numeric_obfuscated_set', 'opaque_set') THEN 'weak_obfuscated_set' ELSE 'actionable' END AS bucket
        FROM summary""",
    "family_shape": f"""WITH {FILES}
        SELECT family_key, bool_and(is_complete) AS all_complete, count(DISTINCT file_index) FILTER (is_complete) AS complete_indexes,
               count(DISTINCT group_id) AS group_count, CAST(floor(epoch(max(posted_at) - min(posted_at)) / 3600) AS BIGINT) AS span_hours
        FROM files GROUP BY family_key""",
    "fileset_candidates": f"""WITH {FILES}
        SELECT concat(family_key, '/', year(posted_at)) AS file_set_key, count(DISTINCT binary_id) AS binary_count, count(DISTINCT group_id) AS group_count,
               min(posted_at) AS first_at, max(posted_at) AS last_at, count(DISTINCT group_id) > 1 AS bridges_groups
        FROM files GROUP BY 1
        HAVING count(DISTINCT binary_id) >= 2 AND max(posted_at) - min(posted_at) <= INTERVAL 1440 HOUR""",
    "base_stem_split_join": """
        WITH part2 AS (SELECT p_partkey AS binary_id, lower(p_brand) AS family_key, upper(p_name) AS base_stem FROM part),
        keys AS (
          SELECT 'release_family' AS key_kind, family_key AS key FROM part2
          UNION SELECT 'base_stem', lower(base_stem) FROM part2)
        SELECT key_kind, key, count(*) AS files, min(binary_id) AS first_binary, max(binary_id) AS last_binary
        FROM keys JOIN part2 ON key_kind = 'release_family' AND key = family_key OR key_kind = 'base_stem' AND key = lower(base_stem)
        GROUP BY key_kind, key""",
    "near_time_cohorts": f"WITH {_NEAR} SELECT * FROM scored",
    "cohort_members": f"""WITH {_NEAR},
        one AS (
          SELECT h.header_id, h.group_id, h.poster, s.bucket, s.score, h.message_key,
                 row_number() OVER (PARTITION BY h.header_id ORDER BY s.score DESC, s.bucket) AS a
          FROM headers h JOIN scored s ON h.group_id = s.group_id AND h.poster = s.poster AND CAST(floor(epoch(h.posted_at) / 3600) AS BIGINT) = s.bucket),
        two AS (SELECT *, row_number() OVER (PARTITION BY group_id, message_key ORDER BY header_id) AS b FROM one WHERE a = 1)
        SELECT header_id, group_id, poster, bucket, score FROM two WHERE b = 1""",
    "subject_complete_cohorts": """
        SELECT md5(CAST(l_orderkey AS VARCHAR)) AS cohort_key, count(DISTINCT l_linenumber) AS seen, 7::INTEGER AS total,
               CAST(least(1000000, count(DISTINCT l_linenumber) * 1000) AS BIGINT) AS score
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 7""",
    "claim_lanes": """
        WITH queue AS (SELECT o_orderkey AS row_id, o_orderkey % 5 AS group_id, o_custkey % 50 AS name_key, CAST(o_orderdate AS DATE) AS day FROM orders),
        done AS (SELECT DISTINCT o_orderkey % 5 AS group_id, (o_custkey + 1) % 50 AS name_key, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F')
        SELECT CASE WHEN EXISTS (SELECT 1 FROM done d WHERE d.group_id = q.group_id AND d.name_key = q.name_key AND d.day >= q.day - 1 AND d.day < q.day + 1) THEN 'A' ELSE 'B' END AS lane,
               row_id, group_id, CAST(day AS VARCHAR) AS day
        FROM queue q ORDER BY lane, q.day, row_id LIMIT 500""",
    "claim_locality_order": f"""WITH {WORK},
        placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id ORDER BY priority DESC, ready_at, row_id) AS INTEGER) AS place FROM work)
        SELECT row_id, group_id, priority, place FROM placed WHERE place <= 30 ORDER BY priority DESC, ready_at, row_id LIMIT 400""",
    "fairness_bucket": f"""WITH {WORK}
        SELECT CAST(floor(epoch(max(ready_at)) / 3600) * 3600 AS BIGINT) AS bucket_epoch FROM work
        WHERE is_open AND ready_at < TIMESTAMP '2024-01-20' AND ready_at >= TIMESTAMP '2024-01-05'""",
    "recovery_capacity": f"""WITH {WORK}
        SELECT count(*) FILTER (is_open) AS open_count, count(*) FILTER (is_open AND is_ready) AS ready_count, count(*) FILTER (NOT is_open) AS done_count,
               greatest(0, 100000 - count(*) FILTER (is_open))::BIGINT AS soft_room, greatest(0, least(250000, 200000) - count(*) FILTER (is_open))::BIGINT AS hard_room
        FROM work""",
    "subject_parse": f"""WITH {SUBJECTS}
        SELECT CAST(regexp_extract(subject, '\\[(\\d+)/(\\d+)\\]', 1) AS INTEGER) AS file_index, CAST(regexp_extract(subject, '\\[(\\d+)/(\\d+)\\]', 2) AS INTEGER) AS file_total,
               CAST(regexp_extract(subject, '.*\\((\\d+)/(\\d+)\\)', 1) AS INTEGER) AS part_number, CAST(regexp_extract(subject, '.*\\((\\d+)/(\\d+)\\)', 2) AS INTEGER) AS part_total,
               regexp_extract(subject, '"([^"]+)"', 1) AS file_name, contains(lower(subject), 'yenc') AS is_yenc, count(*) AS n
        FROM subjects GROUP BY ALL""",
    "normalize_key": r"""
        WITH keyed AS (
          SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '\s+yenc.*$', ''), '[^\p{L}\p{N}]+', ' ', 'g')) AS key,
                 trim(regexp_replace(lower(text), '[_.\-\s]+', ' ', 'g')) AS search_title
          FROM benchmark)
        SELECT *, regexp_matches(key, '^[a-z0-9]{12,}$') AND regexp_matches(key, '[0-9]') AS opaque FROM keyed""",
    "posting_window": f"""WITH {HEADERS}
        SELECT concat(strftime(posted_at, '%Y%m%d'), '-', hour(posted_at) // 6) AS "window", header_id // 5000 AS article_bucket, count(*) AS n
        FROM headers GROUP BY ALL""",
}
