"""The query of whole NZB documents with all that stands in for what a file lacks, and its SQL."""

from __future__ import annotations

from headerloom.plans.views import seen, seen_sql
from headerloom.sources import documents

_RELEASES = ["c_custkey AS release_id", "concat(c_mktsegment, ' & <more>') AS title", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS poster", "c_custkey * 1000 AS published_epoch"]
_FILES = [
    "o_custkey AS release_id", "o_orderkey AS file_id", "CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat('\"', o_orderpriority, '\" yEnc') END AS subject", "CASE WHEN o_orderkey % 8 < 5 THEN concat(o_orderstatus, '.rar') ELSE '' END AS file_name",
    "CASE WHEN o_orderkey % 5 < 2 THEN ' ' ELSE concat(' p', o_custkey % 7) END AS poster", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey * 10 END AS posted_epoch", "CASE WHEN o_orderkey % 6 < 2 THEN '' ELSE concat(' alt.', o_orderstatus) END AS group_name",
]
_ARTICLES = [
    "l_orderkey AS file_id", "l_linenumber AS part_number", "l_suppkey * 100 AS bytes", "CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE concat('<', l_partkey, '.', l_suppkey, '@h>') END AS message_id", "CASE WHEN l_partkey % 2 = 0 THEN DATE '2024-01-01' ELSE l_shipdate END AS posted_at",
    "l_suppkey % 5 AS article_number", "l_partkey AS article_id",
]
_GROUPS = ["o_custkey AS release_id", "concat('alt.', CASE WHEN o_orderkey % 2 = 0 THEN 'z' ELSE 'b' END, o_custkey % 3) AS group_name"]


def nzb_exports(spark, sf_dir):
    """Customers as releases of orders as files of lines as articles, a document each."""
    return documents.release_documents(seen(spark, sf_dir, "customer", _RELEASES), seen(spark, sf_dir, "orders", _FILES), seen(spark, sf_dir, "lineitem", _ARTICLES), seen(spark, sf_dir, "orders", _GROUPS, "o_custkey % 10 > 0"))


_ESCAPED = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&#34;')"
QUERIES = {"nzb_exports": nzb_exports}
ORACLE_SQL = {
    "nzb_exports": f"""WITH {seen_sql("r", "customer", _RELEASES)}, {seen_sql("f", "orders", _FILES)}, {seen_sql("a", "lineitem", _ARTICLES)}, {seen_sql("g", "orders", _GROUPS, "o_custkey % 10 > 0")},
        w AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY file_id, part_number ORDER BY posted_at, article_number, article_id, message_id, bytes) = 1),
        s AS (SELECT file_id, string_agg(concat('<segment bytes="', bytes, '" number="', part_number, '">', {_ESCAPED('trim(message_id)')}, '</segment>'), '' ORDER BY part_number) AS x FROM w WHERE trim(message_id) <> '' GROUP BY 1),
        n AS (SELECT release_id, string_agg(concat('<group>', group_name, '</group>'), '' ORDER BY group_name) AS x FROM (SELECT DISTINCT * FROM g) GROUP BY 1),
        d AS (
          SELECT f.release_id, f.file_id, concat('<file poster="', {_ESCAPED("CASE WHEN trim(f.poster) <> '' THEN trim(f.poster) WHEN r.poster <> '' THEN r.poster ELSE 'unknown' END")}, '" date="', coalesce(posted_epoch, published_epoch), '" subject="',
                 {_ESCAPED("CASE WHEN trim(coalesce(subject, '')) <> '' THEN trim(subject) WHEN file_name <> '' THEN file_name ELSE title END")}, '"><groups>',
                 CASE WHEN f.group_name <> '' THEN concat('<group>', trim(f.group_name), '</group>') ELSE n.x END, '</groups><segments>', s.x, '</segments></file>') AS x
          FROM f JOIN s USING (file_id) JOIN r ON r.release_id = f.release_id JOIN n ON n.release_id = f.release_id)
        SELECT release_id, concat('<?xml version="1.0" encoding="UTF-8"?><nzb xmlns="http://www.newzbin.com/DTD/2003/nzb">', string_agg(x, '' ORDER BY file_id), '</nzb>') AS nzb FROM d GROUP BY 1""",
}
