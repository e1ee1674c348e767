"""Queries on write semantics and on upkeep of the archive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from headerloom.operators import merge, parts, upkeep
from headerloom.plans.views import HEADERS, headers
from headerloom.sources.tables import table

AS_OF = dt.datetime(2024, 1, 31)


def insert_absent(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    incoming = c.select(F.col("c_custkey").alias("poster_id"), F.col("c_name").alias("poster"))
    return merge.insert_absent(o.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("poster_id")), incoming, ["poster_id"])


def change_detection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 10 <> 0")
    status = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_orderstatus"))
    return merge.changed(old, o.where("o_orderkey % 9 <> 0").withColumn("o_orderstatus", status), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


def upsert_latest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return merge.latest(e, ["user_id", "event_type"], ["ts", "event_id"])


def merge_greatest_least(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda df: df.groupBy("user_id").agg(F.max("value").alias("best"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.max("event_type").alias("kind"))
    return merge.sticky(side(e.where("event_id % 2 = 0 and user_id % 3 <> 0")), side(e.where("event_id % 2 = 1")), ["user_id"], {"best": "greatest", "first_at": "least", "last_at": "greatest", "failed": "or", "kind": "keep"})


def part_winners(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("binary_id"), F.col("l_linenumber").alias("part_number"), F.floor("l_extendedprice").cast("long").alias("segment_bytes"),
        F.col("l_partkey").alias("article_id"), F.col("l_shipdate").alias("posted_at"),
    )
    return parts.logical_parts(lines)


def group_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    group = (F.col("user_id") % 40).alias("group_id")
    recovery = e.where("event_type in ('error', 'click')").select(group, (F.col("value") >= 30).alias("ok"), (F.col("event_type") == "error").alias("queued"))
    return upkeep.group_profiles(e.select(group), e.where("event_type = 'view'").select(group), e.where("event_type = 'purchase' and value > 60").select(group), recovery)


def daily_bucket_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return upkeep.daily_statistics(e.select(F.col("ts").alias("at"), F.col("event_type").alias("kind"), (F.col("value") >= 40).alias("flagged"), "value")).withColumn("day", F.col("day").cast("string"))


def day_boundaries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return upkeep.day_boundaries(e.select(F.col("event_type").alias("group_id"), F.col("ts").alias("at"), F.col("event_id").alias("article"))).withColumn("day", F.col("day").cast("string"))


def popularity_delta(spark, sf_dir):
    h = headers(spark, sf_dir)
    count = lambda df: df.groupBy(F.col("group_id").alias("group_name")).agg(F.count("*").alias("articles"), F.count_distinct("poster").alias("posters"))
    return upkeep.popularity(count(h.where("header_id % 3 <> 0")), count(h.where("header_id % 3 = 0")))


def age_bucket_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return upkeep.age_audit(e.select(F.col("event_type").alias("status"), F.col("ts").alias("at")), AS_OF)


def purge_set(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    item = F.col("o_orderkey").alias("item_id")
    return upkeep.purge_set(o.where("o_orderstatus = 'F'").select(item), o.where("o_orderkey % 4 = 0").select(item), l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id")))


def retention_blockers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    return upkeep.retention_blockers(e, assembly=e.where("event_type = 'error' and value > 60"), recovery=e.where("value > 190"), inspection=e.where("event_type = 'click' and value > 120")).withColumn("day", F.col("day").cast("string"))


def crosspost_explode(spark, sf_dir):
    """Articles and posts of each group: the words of a document stand for its cross-post list."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("group_name")).where("group_name <> ''").groupBy("group_name").agg(F.count_distinct("doc_id").alias("articles"), F.count("*").alias("posts"))


def ordinality_explode(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "word")).select("conv_id", "turn", (F.col("at") + 1).cast("long").alias("place"), "word")


def json_rerun_predicate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.where("k is not null and (k % 10 = 0 or k > 95)").groupBy("event_type", "k").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        insert_absent, change_detection, upsert_latest_wins, merge_greatest_least, part_winners, group_profiles, daily_bucket_stats, day_boundaries,
        popularity_delta, age_bucket_audit, purge_set, retention_blockers, crosspost_explode, ordinality_explode, json_rerun_predicate,
    )
}

ORACLE_SQL = {
    "insert_absent": "SELECT c_custkey AS poster_id, c_name AS poster FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    "change_detection": """
        WITH old AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0),
        new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 9 <> 0)
        SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
               CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'updated' END AS change
        FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
        WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o_orderstatus IS DISTINCT FROM s OR o_orderpriority IS DISTINCT FROM p""",
    "upsert_latest_wins": """
        SELECT user_id, event_type, ts, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "merge_greatest_least": """
        WITH a AS (SELECT user_id, max(value) AS best, min(ts) AS f, max(ts) AS l, bool_or(event_type = 'error') AS e, max(event_type) AS k FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY 1),
        b AS (SELECT user_id, max(value) AS best, min(ts) AS f, max(ts) AS l, bool_or(event_type = 'error') AS e, max(event_type) AS k FROM events WHERE event_id % 2 = 1 GROUP BY 1)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(a.best, b.best) AS best, least(a.f, b.f) AS first_at, greatest(a.l, b.l) AS last_at,
               coalesce(a.e, false) OR coalesce(b.e, false) AS failed, coalesce(a.k, b.k) AS kind
        FROM a FULL JOIN b ON a.user_id = b.user_id""",
    "part_winners": """
        SELECT l_orderkey AS binary_id, l_linenumber AS part_number, CAST(floor(l_extendedprice) AS BIGINT) AS segment_bytes, l_partkey AS article_id, l_shipdate AS posted_at
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY floor(l_extendedprice) DESC, l_partkey, l_shipdate) = 1""",
    "group_profiles": """
        WITH g AS (
          SELECT user_id % 40 AS group_id, count(*) AS articles, count(*) FILTER (event_type = 'view') AS binaries, count(*) FILTER (event_type = 'purchase' AND value > 60) AS releases,
                 count(*) FILTER (event_type = 'click') AS attempted, count(*) FILTER (event_type IN ('click', 'error') AND value >= 30) AS ok, count(*) FILTER (event_type = 'error') AS queued
          FROM events GROUP BY 1),
        s AS (
          SELECT *, round(1000 * releases + binaries + 10000 * binaries::DOUBLE / articles + 250 * CASE WHEN attempted > 0 THEN ok::DOUBLE / attempted ELSE 0 END
                          - CASE WHEN releases > 0 THEN queued::DOUBLE / releases / 100 ELSE queued::DOUBLE / 1000 END, 4) AS score FROM g)
        SELECT *, CASE WHEN releases >= 5 AND score >= 750 THEN 'hot' WHEN releases >= 1 OR binaries >= 250 THEN 'warm' WHEN queued >= 10000 AND releases = 0 THEN 'cold' ELSE 'warm' END AS tier FROM s""",
    "daily_bucket_stats": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(*) AS n, count(*) FILTER (value >= 40) AS flagged, round(sum(value), 2) AS total,
               round(count(*) FILTER (value >= 40)::DOUBLE / count(*), 4) AS share
        FROM events GROUP BY 1, 2""",
    "day_boundaries": """
        WITH d AS (SELECT event_type AS group_id, CAST(ts AS DATE) AS day, min(event_id) AS low, max(event_id) AS high, count(*) AS seen FROM events GROUP BY 1, 2)
        SELECT d.* REPLACE (CAST(d.day AS VARCHAR) AS day), coalesce(n.low <= d.high, false) AS crosses FROM d LEFT JOIN d n ON n.group_id = d.group_id AND n.day = d.day + 1""",
    "popularity_delta": f"""WITH {HEADERS},
        u AS (
          SELECT group_id AS group_name, count(*) AS articles, count(DISTINCT poster) AS posters FROM headers WHERE header_id % 3 <> 0 GROUP BY 1
          UNION ALL SELECT group_id, count(*), count(DISTINCT poster) FROM headers WHERE header_id % 3 = 0 GROUP BY 1)
        SELECT group_name, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(posters) AS BIGINT) AS posters FROM u GROUP BY 1""",
    "age_bucket_audit": """
        WITH h AS (SELECT event_type AS status, epoch(TIMESTAMP '2024-01-31' - ts) / 3600 AS hours FROM events)
        SELECT status, CASE WHEN hours < 24 THEN '<24h' WHEN hours < 72 THEN '24-72h' WHEN hours < 168 THEN '72h-7d' WHEN hours < 720 THEN '7d-30d' ELSE '>30d' END AS age, count(*) AS n
        FROM h GROUP BY 1, 2""",
    "purge_set": """
        SELECT DISTINCT o_orderkey AS item_id FROM orders
        WHERE (o_orderstatus = 'F' OR o_orderkey % 4 = 0) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
    "retention_blockers": """
        WITH d AS (
          SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'error' AND value > 60) AS assembly, count(*) FILTER (value > 190) AS recovery,
                 count(*) FILTER (event_type = 'click' AND value > 120) AS inspection
          FROM events GROUP BY 1)
        SELECT *, assembly = 0 AND recovery = 0 AND inspection = 0 AS droppable FROM d""",
    "crosspost_explode": r"""
        WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS group_name FROM documents)
        SELECT group_name, count(DISTINCT doc_id) AS articles, count(*) AS posts FROM w WHERE group_name <> '' GROUP BY 1""",
    "ordinality_explode": """
        WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS s FROM conversations)
        SELECT conv_id, turn, unnest(generate_series(1, len(s))) AS place, unnest(s) AS word FROM w""",
    "json_rerun_predicate": """
        WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
        SELECT event_type, k, count(*) AS n FROM k WHERE k % 10 = 0 OR k > 95 GROUP BY 1, 2""",
}
