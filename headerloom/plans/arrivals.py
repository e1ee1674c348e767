"""Queries on what arrives: overview rows, header keys, cross-posts, group lists, day boundaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from headerloom.functions import overview
from headerloom.operators import ingest
from headerloom.sources.tables import table

_N = "l_orderkey * 7 + l_linenumber"
_DAY = "DATE '2024-01-01' + CAST(l_orderkey % 200 AS INT)"
# The date of an overview row in one of eight layouts, from the day of the month, month, year and the time 0h:05:09.
_TEXT = """CASE l_orderkey % 9 WHEN 0 THEN concat('Mon, ', dd, ' ', mon, ' 2024 0', h, ':05:09 +0000') WHEN 1 THEN concat('Tue, ', d, ' ', mon, ' 24 0', h, ':05:09 GMT') WHEN 2 THEN concat(d, ' ', mon, ' 2024 0', h, ':05:09 -0130')
  WHEN 3 THEN concat(d, ' ', mon, ' 24 0', h, ':05:09 CET') WHEN 4 THEN concat('2024-', mm, '-', dd, 'T0', h, ':05:09Z') WHEN 5 THEN concat('2024-', mm, '-', dd, 'T0', h, ':05:09.25+02:00') WHEN 6 THEN concat(d, ' ', mon, ' 2024 0', h, ':05:09 UTC')
  WHEN 7 THEN '' ELSE concat('Wed, ', d, ' ', mon, ' 24 0', h, ':05:09 +0100') END"""
_NUMBER = "CASE l_partkey % 17 WHEN 1 THEN 'x7' WHEN 2 THEN '0' WHEN 3 THEN '-4' ELSE CAST(n AS STRING) END"
_MESSAGE = "CASE WHEN l_partkey % 13 = 1 THEN ' ' ELSE concat('<', CAST(n AS STRING), '@host>') END"
_XREF = "CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Xref: news.x alt.A:12 alt.b:9 broken' ELSE concat('news.x alt.b:', CAST(n AS STRING), ' ALT.C:7  alt.c:5') END"


def _lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{_N} AS n", f"{_DAY} AS day", "CAST(l_orderkey % 9 AS STRING) AS h")
    rows = rows.selectExpr("*", "date_format(day, 'dd') AS dd", "CAST(day(day) AS STRING) AS d", "date_format(day, 'MM') AS mm", "element_at(array('Jan','Feb','Mar','Apr','May','Jun','Jul'), month(day)) AS mon")
    tail = F.when(F.col("l_partkey") % 19 == 1, F.lit("")).otherwise(F.concat(F.lit("\t"), F.col("l_partkey").cast("string"), F.lit("\t 5 \t"), F.expr(_XREF)))
    line = F.concat_ws("\t", F.expr(_NUMBER), F.format_string(" subj\u0000ect %d ", "n"), F.lit("poster@x"), F.expr(_TEXT), F.expr(_MESSAGE), F.lit(""))
    # A row of its own: filters on the line are not pushed below it, where they would put it together again.
    return rows.select((F.col("l_orderkey") % 3).alias("group_id"), F.inline(F.array(F.struct(F.concat(line, tail).alias("line")))))


def overview_rows(spark, sf_dir):
    """Accepted headers of overview rows with dates in nine layouts."""
    found = ingest.accepted(ingest.parsed(_lines(spark, sf_dir)), dt.datetime(2024, 2, 1))
    return found.select("group_id", "article_number", "subject", "poster", F.col("posted_at").cast("string").alias("posted_at"), "message_id", "bytes", "lines", "xref")


def two_key_headers(spark, sf_dir):
    """Orders as incoming headers with repeated numbers and message ids, against stored ones."""
    o = table(spark, sf_dir, "orders")
    incoming = o.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS ord", "o_orderkey % 3 AS group_id", "o_custkey * 3 % 1009 AS article_number", "concat('m', CAST(o_orderkey % 2003 AS STRING)) AS message_id")
    stored = o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey AS header_id", "o_orderkey % 3 AS group_id", "o_custkey * 7 % 4001 AS article_number", "concat('m', CAST(o_orderkey % 4007 AS STRING)) AS message_id")
    return ingest.resolve_by_two_keys(stored, incoming)


def xref_groups(spark, sf_dir):
    """Groups that articles were also posted to, by group."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{_N} AS n").selectExpr("n AS header_id", "CASE WHEN l_partkey % 2 = 0 THEN 'alt.B' ELSE 'alt.x' END AS group_name", f"{_XREF} AS xref")
    return ingest.crosspost_groups(rows).groupBy("group_name").agg(F.count("*").alias("articles"), F.min("article_number").alias("low"), F.max("article_number").alias("high"))


def group_lists(spark, sf_dir):
    """A page of the group list, from lines some of which are none."""
    lines = table(spark, sf_dir, "customer").selectExpr("concat('alt.', lower(c_mktsegment), '.g_', CAST(c_custkey AS STRING), ' ', CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE CAST(c_custkey * 31 % 9973 AS STRING) END, ' ', CAST(c_custkey % 500 AS STRING), CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ' y' END) AS line")
    listed = lines.select(*[c.alias(k) for k, c in overview.listed_group(F.col("line")).items()]).where("group_name is not null")
    return ingest.group_inventory(listed, "*.g_*", ["alt.b*", "machinery"], 60, 10)


def batch_day_boundaries(spark, sf_dir):
    """Days of each batch of headers, with the boundaries that the batch crosses."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.floor(F.col("event_id") / 700).cast("string")).alias("batch"), F.col("event_id").alias("article_number"), F.col("ts").alias("posted_at"))
    return ingest.day_boundaries(e).withColumn("day", F.col("day").cast("string"))


def deferred_ranges(spark, sf_dir):
    """Ranges put off, by priority."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS range_id", "CASE o_orderkey % 3 WHEN 0 THEN 'latest' WHEN 1 THEN 'latest_gap' ELSE 'backfill' END AS reason", "o_custkey AS open_count", "o_custkey % 4 * 50 AS hard_cap")
    return o.select("range_id", "reason", ingest.deferred_priority(F.col("reason"), F.col("open_count"), F.col("hard_cap")).alias("priority")).orderBy(F.desc("priority"), "range_id").limit(500)


QUERIES = {f.__name__: f for f in (overview_rows, two_key_headers, xref_groups, group_lists, batch_day_boundaries, deferred_ranges)}

ORACLE_SQL = {
    "overview_rows": f"""
        WITH a AS (SELECT *, {_N} AS n, {_DAY} AS day, l_orderkey % 9 AS h FROM lineitem),
        b AS (SELECT *, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) + INTERVAL 309 SECOND AS t0 FROM a),
        c AS (
          SELECT *, CASE l_orderkey % 9 WHEN 2 THEN t0 + INTERVAL 90 MINUTE WHEN 5 THEN t0 - INTERVAL 2 HOUR WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN t0 - INTERVAL 1 HOUR ELSE t0 END AS posted_at FROM b)
        SELECT l_orderkey % 3 AS group_id, n AS article_number, concat('subject ', n) AS subject, 'poster@x' AS poster, CAST(posted_at AS VARCHAR) AS posted_at, concat('<', n, '@host>') AS message_id, l_partkey AS bytes, 5::INTEGER AS lines, {_XREF} AS xref
        FROM c WHERE l_partkey % 17 NOT IN (1, 2, 3) AND l_partkey % 13 <> 1 AND l_partkey % 19 <> 1 AND (posted_at IS NULL OR posted_at >= TIMESTAMP '2024-02-01')""",
    "two_key_headers": """
        WITH i AS (SELECT o_orderkey AS ord, o_orderkey % 3 AS g, o_custkey * 3 % 1009 AS num, concat('m', o_orderkey % 2003) AS msg FROM orders WHERE o_orderkey % 5 <> 0),
        s AS (SELECT o_orderkey AS id, o_orderkey % 3 AS g, o_custkey * 7 % 4001 AS num, concat('m', o_orderkey % 4007) AS msg FROM orders WHERE o_orderkey % 5 = 0),
        cand AS (SELECT ord, id, 0 AS rank FROM i JOIN s ON i.g = s.g AND i.num = s.num UNION ALL SELECT ord, id, 1 FROM i JOIN s ON i.g = s.g AND i.msg = s.msg),
        best AS (SELECT ord, id FROM cand QUALIFY row_number() OVER (PARTITION BY ord ORDER BY rank, id) = 1),
        fresh AS (SELECT ord, min(ord) OVER (PARTITION BY g, num) AS a, min(ord) OVER (PARTITION BY g, msg) AS b FROM i WHERE ord NOT IN (SELECT ord FROM best))
        SELECT ord, id AS header_id, NULL::BIGINT AS as_ord, 'stored' AS action FROM best
        UNION ALL SELECT ord, NULL, least(a, b), CASE WHEN a = ord AND b = ord THEN 'insert' ELSE 'resolve' END FROM fresh""",
    "xref_groups": f"""
        WITH a AS (SELECT l_partkey, {_N} AS n FROM lineitem),
        x AS (
          SELECT n, 'alt.a' AS g, 12 AS num FROM a WHERE l_partkey % 5 = 1 UNION ALL SELECT n, 'alt.b', 9 FROM a WHERE l_partkey % 5 = 1 AND l_partkey % 2 = 1
          UNION ALL SELECT n, 'alt.b', n FROM a WHERE l_partkey % 5 > 1 AND l_partkey % 2 = 1 UNION ALL SELECT n, 'alt.c', 5 FROM a WHERE l_partkey % 5 > 1)
        SELECT g AS group_name, count(DISTINCT n) AS articles, min(num) AS low, max(num) AS high FROM x GROUP BY g""",
    "group_lists": """
        SELECT concat('alt.', lower(c_mktsegment), '.g_', c_custkey) AS group_name, c_custkey % 500 AS low, c_custkey * 31 % 9973 AS high, 'y' AS status, greatest(c_custkey * 31 % 9973 - c_custkey % 500 + 1, 0) AS articles
        FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY articles DESC, group_name LIMIT 60 OFFSET 10""",
    "batch_day_boundaries": """
        WITH e AS (SELECT concat(event_type, '/', event_id // 700) AS batch, event_id AS n, ts FROM events WHERE event_id > 0 AND ts IS NOT NULL)
        SELECT batch, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min(n) AS low, max(n) AS high, count(*) AS seen,
               (SELECT min(ts) FROM e f WHERE f.batch = e.batch) < CAST(CAST(ts AS DATE) AS TIMESTAMP) AS lower_crossed, (SELECT max(ts) FROM e f WHERE f.batch = e.batch) >= CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS upper_crossed
        FROM e GROUP BY batch, CAST(ts AS DATE)""",
    "deferred_ranges": """
        SELECT o_orderkey AS range_id, ['latest', 'latest_gap', 'backfill'][o_orderkey % 3 + 1] AS reason,
               CAST(CASE WHEN o_orderkey % 3 = 1 THEN 90 ELSE greatest(0, CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 10 END - CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 10 * o_custkey // (o_custkey % 4 * 50) END) END AS INTEGER) AS priority
        FROM orders ORDER BY priority DESC, range_id LIMIT 500""",
}
