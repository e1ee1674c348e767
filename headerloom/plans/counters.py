"""Queries on counters, details, audits, fuller cohorts and claims, identities and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from headerloom.operators import admin
from headerloom.plans.views import seen, seen_sql
from headerloom.sources.folders import shared_path
from headerloom.sources.tables import table
from headerloom.streaming import upserts

NOW = dt.datetime(2024, 1, 31)

_AUDIT = ["CASE event_type WHEN 'click' THEN 'ready' WHEN 'view' THEN 'running' WHEN 'error' THEN 'stale' ELSE 'done' END AS status", "user_id % 3 AS rank", "ts AS at", "event_id % 100 AS waited"]
_QUEUE = ["event_id AS header_id", "event_type AS group_id", "user_id % 4 AS poster", "ts AS posted_at", "CAST(floor(value * 100000) AS BIGINT) AS bytes", "CASE WHEN event_id % 5 = 0 THEN 'named' WHEN event_id % 5 = 1 THEN ' ' ELSE NULL END AS name_key", "event_id % 3 AS total_parts"]
_SUBJECTS = [
    "l_orderkey % 2 AS provider_id", "l_suppkey % 3 AS group_id", "CASE WHEN l_partkey % 11 = 0 THEN ' ' WHEN l_orderkey % 2 = 0 THEN concat(' File', CAST(l_partkey % 40 AS STRING)) ELSE concat('file', CAST(l_partkey % 40 AS STRING)) END AS file_name", "l_linenumber % 3 AS file_index", "7 AS file_total",
    "l_linenumber - 1 AS part_number", "l_partkey % 3 AS total_parts", "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey % 5 END AS file_size", "l_orderkey AS article_number",
]
_WAITING = ["o_orderkey AS row_id", "o_orderkey % 5 AS group_id", "CASE WHEN o_custkey % 6 = 0 THEN ' ' ELSE CAST(o_custkey % 50 AS STRING) END AS name_key", "CAST(o_orderdate AS DATE) AS day", "o_orderkey % 3 AS file_index", "o_custkey % 4 AS total_parts"]
_LACKING = ["o_orderkey % 5 AS group_id", "CAST((o_custkey + 1) % 50 AS STRING) AS name_key", "CAST(o_orderdate AS DATE) AS day"]
_SETS = [
    "CASE WHEN o_custkey % 13 = 0 THEN ' ' ELSE concat(CAST(o_custkey % 3 AS STRING), '/', CAST(CAST(o_orderdate AS DATE) AS STRING)) END AS file_set_key", "o_orderkey % 3 AS group_id", "o_orderkey % 7 <> 0 AS is_recovered", "o_orderpriority <> '5-LOW' AS is_main", "o_orderstatus = 'F' AS is_complete", "o_custkey % 9 AS expected_files",
    "o_custkey % 4 AS expected_archives", "o_orderdate AS posted_at",
]


def overview_counters(spark, sf_dir):
    """The numbers of the overview: files, complete ones, families that wait, releases without archive, headers by state."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    done = l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return admin.counters({
        "files": o, "complete": o.where("o_orderstatus = 'F'"), "waiting_families": o.where("o_orderstatus = 'O'").select("o_custkey").distinct(), "to_archive": o.where("o_orderstatus = 'F'").join(done, "o_orderkey", "left_anti"),
        "to_generate": o.where("o_orderpriority like '1%'").join(done.distinct(), "o_orderkey", "left_semi"), "pages": table(spark, sf_dir, "pages"),
    })


def beside_totals(spark, sf_dir):
    """Nations with totals over all of them: scalar subqueries on one aggregate, joined on nothing."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    totals = c.agg(F.sum("customers").alias("all_customers"), F.max("customers").alias("most"))
    return admin.beside(c, totals).withColumn("share", F.round(F.col("customers") / F.col("all_customers"), 6))


def article_refs(spark, sf_dir):
    parts = seen(spark, sf_dir, "lineitem", ["l_orderkey AS binary_id", "l_linenumber AS part_number", "l_partkey AS header_id"])
    headers = seen(spark, sf_dir, "part", ["p_partkey AS header_id", "p_partkey % 3 AS group_id", "p_partkey * 5 % 997 AS article_number", "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 10 END AS posted_at", "p_size AS bytes", "concat('<', CAST(p_partkey AS STRING), '>') AS message_id"])
    return admin.article_refs(seen(spark, sf_dir, "orders", ["o_orderkey AS binary_id", "o_orderkey % 3 AS group_id", "o_custkey % 400 AS low", "o_custkey % 400 + 500 AS high"]), parts, headers)


def release_files_by_id(spark, sf_dir):
    """One release's files with what their binaries hold, in order."""
    files = seen(spark, sf_dir, "lineitem", ["l_orderkey AS release_id", "l_linenumber AS file_index", "l_partkey AS binary_id"], "l_orderkey in (1, 7, 33)")
    return files.join(seen(spark, sf_dir, "part", ["p_partkey AS binary_id", "p_name AS file_name", "p_size AS observed_parts"]), "binary_id", "left").orderBy("release_id", "file_index", "binary_id")


def binary_details(spark, sf_dir):
    """Suppliers in full: a JSON object with their parts and nation."""
    s = seen(spark, sf_dir, "supplier", ["s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"])
    lines = seen(spark, sf_dir, "lineitem", ["l_suppkey AS id", "l_linenumber AS n", "l_returnflag AS flag"]).distinct()
    found = admin.details(s, "id", lines=lines)
    return found.select("id", F.get_json_object("detail", "$.name").alias("name"), F.get_json_object("detail", "$.lines[0].flag").alias("first"), F.coalesce(F.json_array_length(F.get_json_object("detail", "$.lines")), F.lit(0)).alias("lines"))


def popular_groups(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 200).cast("string").alias("group_name")).agg(F.count("*").alias("articles"), F.count_distinct("event_type").alias("posters"))
    return admin.popular_groups(counts, 25)


def storage_audit(spark, sf_dir):
    rows = seen(spark, sf_dir, "events", _AUDIT).withColumn("done_at", F.timestamp_add("MINUTE", F.col("waited").cast("int"), F.col("at")))
    return admin.storage_audit(rows, NOW)


def droppable_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value", "user_id")
    kinds = {"assembly": "event_type = 'error' and value > 90", "recovery": "value > 220", "cohorts": "event_type = 'view' and value > 150", "queue": "user_id % 97 = 3", "running": "user_id % 89 = 5", "files": "event_type = 'purchase' and value > 130"}
    return admin.droppable_days(e, dt.date(2024, 1, 20), **{k: e.where(c) for k, c in kinds.items()}).withColumn("day", F.col("day").cast("string"))


def opaque_cohorts(spark, sf_dir):
    return admin.opaque_cohorts(seen(spark, sf_dir, "events", _QUEUE), 7200, 2, 40)


def subject_cohorts(spark, sf_dir):
    return admin.subject_cohorts(seen(spark, sf_dir, "lineitem", _SUBJECTS))


def claimed_lanes(spark, sf_dir):
    """The next rows in three lanes."""
    queue, lacking = seen(spark, sf_dir, "orders", _WAITING), seen(spark, sf_dir, "orders", _LACKING, "o_orderstatus = 'F'")
    return admin.claimed(seen(spark, sf_dir, "orders", ["o_orderkey AS row_id", "o_custkey % 100 AS score"], "o_orderkey % 40 = 1"), queue, lacking, 600)


def recovered_file_sets(spark, sf_dir):
    return admin.recovered_file_sets(seen(spark, sf_dir, "orders", _SETS))


def chosen_matches(spark, sf_dir):
    m = seen(spark, sf_dir, "lineitem", ["l_orderkey AS release_id", "l_partkey AS match_id", "l_suppkey % 21 / CAST(20 AS DOUBLE) AS score", "l_returnflag AS title"])
    return admin.chosen_matches(m, seen(spark, sf_dir, "orders", ["o_orderkey AS release_id", "o_custkey AS match_id"], "o_orderkey % 6 = 0"), 0.9)


def release_identity(spark, sf_dir):
    """Identity scores where a title may be surer than its cluster, and the poster that reaches the highest count first."""
    files = seen(spark, sf_dir, "orders", ["o_custkey AS release_id", "o_orderpriority AS poster", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS posted_at", "o_orderkey AS binary_id"])
    k = F.col("release_id")
    score = admin.identity_score((k % 10) / 10.0, (k % 7) / 7.0, (k % 11) / 10.0)
    return admin.first_to_reach(files).withColumn("identity", F.round(score, 4))


def tag_maps(spark, sf_dir):
    tags = seen(spark, sf_dir, "lineitem", ["l_orderkey AS release_id", "concat('k', CAST(l_linenumber % 3 AS STRING)) AS name", "l_returnflag AS value"])
    found = admin.grouped_tags(tags)
    return found.select("release_id", "names", F.element_at("tags", "k1").alias("k1"), F.array_join(F.map_keys("tags"), "|").alias("keys"), F.size(F.map_filter("tags", lambda k, v: v.contains("R"))).alias("with_r"))


def stream_sliding_counts(spark, sf_dir):
    """Events by type in windows of two days that start every day, kept by a stream."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))
    target = shared_path(spark, "sliding-out")
    upserts.write_changes(upserts.sliding_counts(events, "at", "2 days", "1 day", "1 day", "event_type"), target, shared_path(spark, "sliding-state")).awaitTermination()
    found = upserts.compacted(spark, target, ["event_type", "window_start"], "event_type string, window_start timestamp, n long", shared_path(spark, "sliding-table"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_dirty_keys(spark, sf_dir):
    """The families that a stream of changes touched, each with its latest change."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").select((F.col("user_id") % 500).alias("family_key"), "ts")
    target = shared_path(spark, "dirty-out")
    upserts.write_dirty(events, ["family_key"], "ts", target, shared_path(spark, "dirty-state")).awaitTermination()
    return upserts.dirty_keys(spark, target, ["family_key"], "family_key long, dirty_at timestamp_ntz")


QUERIES = {
    f.__name__: f
    for f in (
        overview_counters, beside_totals, article_refs, release_files_by_id, binary_details, popular_groups, storage_audit, droppable_days, opaque_cohorts, subject_cohorts, claimed_lanes, recovered_file_sets, chosen_matches, release_identity, tag_maps,
        stream_sliding_counts, stream_dirty_keys,
    )
}

ORACLE_SQL = {
    "overview_counters": """
        SELECT 'files' AS counter, count(*) AS n FROM orders UNION ALL SELECT 'complete', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'waiting_families', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O'
        UNION ALL SELECT 'to_archive', count(*) FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
        UNION ALL SELECT 'to_generate', count(*) FROM orders WHERE starts_with(o_orderpriority, '1') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') UNION ALL SELECT 'pages', count(*) FROM pages""",
    "beside_totals": """
        WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1)
        SELECT *, (SELECT CAST(sum(customers) AS BIGINT) FROM c) AS all_customers, (SELECT max(customers) FROM c) AS most, round(customers::DOUBLE / (SELECT sum(customers) FROM c), 6) AS share FROM c""",
    "article_refs": """
        WITH r AS (
          SELECT o_orderkey AS binary_id, l_linenumber AS part_number, p_partkey AS header_id, p_partkey * 5 % 997 AS article_number, p_size AS bytes, concat('<', p_partkey, '>') AS message_id, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 10 END AS posted
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_partkey % 3 = o_orderkey % 3 AND p_partkey * 5 % 997 >= o_custkey % 400 AND p_partkey * 5 % 997 <= o_custkey % 400 + 500)
        SELECT binary_id, part_number, header_id, article_number, bytes, message_id, count(*) OVER (PARTITION BY binary_id, part_number) AS copies FROM r
        QUALIFY row_number() OVER (PARTITION BY binary_id, part_number ORDER BY posted ASC NULLS LAST, article_number, header_id) = 1""",
    "release_files_by_id": """
        SELECT l_orderkey AS release_id, l_linenumber AS file_index, l_partkey AS binary_id, p_name AS file_name, p_size AS observed_parts FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (1, 7, 33)""",
    "binary_details": """
        WITH l AS (SELECT DISTINCT l_suppkey AS id, l_linenumber AS n, l_returnflag AS flag FROM lineitem)
        SELECT s_suppkey AS id, s_name AS name, min(flag) FILTER (n = (SELECT min(n) FROM l k WHERE k.id = s_suppkey)) AS "first", CAST(count(n) AS INTEGER) AS lines FROM supplier LEFT JOIN l ON l.id = s_suppkey GROUP BY 1, 2""",
    "popular_groups": """
        WITH c AS (SELECT CAST(user_id % 200 AS VARCHAR) AS group_name, count(*) AS articles, count(DISTINCT event_type) AS posters FROM events GROUP BY 1)
        SELECT *, CAST(row_number() OVER (ORDER BY articles DESC, posters DESC, group_name) AS INTEGER) AS place FROM c QUALIFY place <= 25""",
    "storage_audit": f"""WITH {seen_sql("a", "events", _AUDIT).replace("ts AS at", "ts AS t")},
        h AS (SELECT *, epoch(TIMESTAMP '2024-01-31' - t) / 3600 AS old FROM a)
        SELECT status, rank, CASE WHEN old < 24 THEN '<24h' WHEN old < 72 THEN '24-72h' WHEN old < 168 THEN '72h-7d' WHEN old < 720 THEN '7d-30d' ELSE '>30d' END AS age, count(*) AS n, count(*) FILTER (status IN ('ready', 'running')) AS blocking, min(t) AS first_at, max(t) AS last_at,
               round(avg(waited / 60.0::DOUBLE) FILTER (status = 'done'), 4) AS average_wait, round(max(waited / 60.0::DOUBLE) FILTER (status = 'done'), 4) AS longest_wait
        FROM h GROUP BY 1, 2, 3""",
    "droppable_days": """
        WITH d AS (
          SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error' AND value > 90) AS assembly, count(*) FILTER (value > 220) AS recovery, count(*) FILTER (event_type = 'view' AND value > 150) AS cohorts, count(*) FILTER (user_id % 97 = 3) AS queue,
                 count(*) FILTER (user_id % 89 = 5) AS running, count(*) FILTER (event_type = 'purchase' AND value > 130) AS files FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
        b AS (SELECT *, assembly + recovery + cohorts + queue + running + files AS blockers FROM d)
        SELECT b.* REPLACE (CAST(day AS VARCHAR) AS day), CASE WHEN blockers = 0 THEN CAST(row_number() OVER (PARTITION BY blockers = 0 ORDER BY b.day) AS INTEGER) END AS place FROM b""",
    "opaque_cohorts": f"""WITH {seen_sql("q", "events", _QUEUE)},
        s AS (SELECT *, CAST(posted_at AS DATE) AS day FROM q WHERE trim(coalesce(name_key, '')) = '' AND total_parts <= 1),
        d AS (SELECT day, count(*) AS many FROM s GROUP BY 1),
        c AS (SELECT coalesce(max(day) FILTER (many >= 40), (SELECT day FROM d ORDER BY many DESC, day DESC LIMIT 1)) AS day FROM d)
        SELECT group_id, poster, CAST(floor(epoch(posted_at) / 7200) AS BIGINT) AS bucket, count(*) AS members, CAST(sum(bytes) AS BIGINT) AS bytes, min(header_id) AS "first", max(header_id) AS "last", CAST(count(*) * 1000 + least(999, sum(bytes) // 1000000) AS BIGINT) AS score
        FROM s WHERE day = (SELECT day FROM c) GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "subject_cohorts": f"""WITH {seen_sql("h", "lineitem", _SUBJECTS)}
        SELECT concat('subject:', provider_id, ':', group_id, ':', md5(concat(lower(trim(file_name)), ':', file_index, ':', file_total, ':', total_parts, ':', coalesce(file_size, 0)))) AS cohort_key, count(*) AS articles, min(article_number) AS "first", max(article_number) AS "last",
               CAST(least(1000000, count(*) * 1000) AS BIGINT) AS score
        FROM h WHERE trim(file_name) <> '' AND file_index > 0 AND part_number > 0 AND total_parts > 1 GROUP BY 1""",
    "claimed_lanes": f"""WITH {seen_sql("q", "orders", _WAITING)}, {seen_sql("k", "orders", _LACKING, "o_orderstatus = 'F'")},
        c AS (SELECT o_orderkey AS row_id, o_custkey % 100 AS score FROM orders WHERE o_orderkey % 40 = 1 ORDER BY score DESC, row_id LIMIT 600),
        r AS (SELECT *, trim(name_key) <> '' AND file_index > 0 AND total_parts > 1 AND EXISTS (SELECT 1 FROM k WHERE k.group_id = q.group_id AND k.name_key = q.name_key AND k.day >= q.day - 1 AND k.day < q.day + 1) AS hit FROM q WHERE row_id % 40 <> 1),
        a AS (SELECT row_id, day FROM r WHERE hit ORDER BY day, row_id LIMIT 420),
        b AS (SELECT row_id, day FROM r WHERE row_id NOT IN (SELECT row_id FROM a) ORDER BY day, row_id LIMIT 600),
        u AS (SELECT -1 AS lane, row_id, NULL::DATE AS day FROM c UNION ALL SELECT 0, row_id, day FROM a WHERE (SELECT count(*) FROM c) < 600 UNION ALL SELECT 1, row_id, day FROM b WHERE (SELECT count(*) FROM c) < 600)
        SELECT lane, row_id FROM u ORDER BY lane, day, row_id LIMIT 600""",
    "recovered_file_sets": f"""WITH {seen_sql("f", "orders", _SETS)},
        g AS (SELECT file_set_key, count(DISTINCT group_id) AS groups, count(*) FILTER (is_main) AS main, count(*) FILTER (is_main AND is_complete) AS complete_main, max(expected_files) AS e, max(expected_archives) AS a, max(posted_at) - min(posted_at) AS span FROM f WHERE is_recovered AND file_set_key <> ' ' GROUP BY 1)
        SELECT file_set_key, groups, main, complete_main, CASE WHEN e > 0 THEN round(least(100, 100.0::DOUBLE * complete_main / e), 4) ELSE 0 END::DOUBLE AS file_coverage, CASE WHEN a > 0 THEN round(least(100, 100.0::DOUBLE * complete_main / a), 4) ELSE 0 END::DOUBLE AS archive_coverage
        FROM g WHERE groups > 1 AND main >= 2 AND span <= INTERVAL 24 HOUR""",
    "chosen_matches": """
        WITH m AS (SELECT l_orderkey AS r, l_partkey AS id, l_suppkey % 21 / 20.0::DOUBLE AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 21 DESC, l_partkey) = 1),
        h AS (SELECT o_orderkey AS r, o_custkey AS id FROM orders WHERE o_orderkey % 6 = 0)
        SELECT coalesce(m.r, h.r) AS release_id, CASE WHEN h.r IS NOT NULL THEN h.id WHEN m.score >= 0.9 THEN m.id END AS match_id, CASE WHEN h.r IS NOT NULL THEN 'manual' WHEN m.score >= 0.9 THEN 'auto' ELSE 'none' END AS how FROM m FULL JOIN h ON m.r = h.r""",
    "release_identity": """
        WITH f AS (SELECT o_custkey AS r, o_orderpriority AS poster, o_orderkey AS id, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS d FROM orders),
        n AS (SELECT *, count(*) OVER (PARTITION BY r, poster ORDER BY d ASC NULLS FIRST, id) AS running, row_number() OVER (PARTITION BY r ORDER BY d ASC NULLS FIRST, id) AS step FROM f),
        t AS (SELECT r, poster, running AS n FROM n QUALIFY row_number() OVER (PARTITION BY r ORDER BY running DESC, step) = 1)
        SELECT r AS release_id, poster, n, round(greatest(6.0::DOUBLE * (r % 10) + 40.0::DOUBLE * (r % 7) / 7, 10.0::DOUBLE * (r % 11)), 4) AS identity FROM t""",
    "tag_maps": """
        WITH t AS (SELECT DISTINCT l_orderkey AS r, l_linenumber % 3 AS k, l_returnflag AS v FROM lineitem)
        SELECT r AS release_id, CAST(count(DISTINCT k) AS INTEGER) AS names, string_agg(v, ',' ORDER BY v) FILTER (k = 1) AS k1, (SELECT string_agg('k' || k, '|' ORDER BY k) FROM (SELECT DISTINCT k FROM t u WHERE u.r = t.r)) AS keys, CAST(count(DISTINCT k) FILTER (v = 'R') AS INTEGER) AS with_r
        FROM t GROUP BY r""",
    "stream_sliding_counts": """
        SELECT event_type, CAST(CAST(ts AS DATE) - CAST(o AS INTEGER) AS TIMESTAMP) AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) v(o) GROUP BY ALL""",
    "stream_dirty_keys": "SELECT user_id % 500 AS family_key, max(ts) AS dirty_at FROM events GROUP BY 1",
}
