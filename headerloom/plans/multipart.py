"""Queries on files that are put together again by their subjects' counters, and the SQL of the whole merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.operators import subject_regroup
from headerloom.plans.views import seen, seen_sql

_NAME = "concat('name', CAST(o_orderkey % 2 AS {text}), CASE WHEN o_custkey % 4 = 0 THEN '.NFO' ELSE '.part1.rar' END)"
_FILES = [
    "o_orderkey AS binary_id", "o_custkey % 2 AS group_id", "CASE WHEN o_orderkey % 13 = 0 AND o_custkey % 4 > 0 THEN concat('name', CAST(o_orderkey % 2 AS {text}), ' part1::name', CAST(o_orderkey % 2 AS {text}), ' part1 rar') ELSE concat('k', CAST(o_orderkey AS {text})) END AS binary_key",
    "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('fam', CAST(o_custkey AS {text})) END AS release_family_key", "CASE WHEN o_custkey % 6 = 0 THEN '' ELSE concat('stem', CAST(o_custkey AS {text})) END AS base_stem", "concat('src', CAST(o_custkey AS {text})) AS source_key",
    f"CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE {_NAME} END AS file_name", "CASE WHEN o_orderkey % 5 = 0 THEN 'opaque_set' ELSE 'contextual_obfuscated' END AS family_kind",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'opaque_subject_set' ELSE 'contextual_fallback' END AS identity_reason", "CAST(o_orderkey % 4 AS INT) AS file_index", "CAST(o_custkey % 9 AS INT) AS expected_files", "CAST(9 AS INT) AS total_parts", "CAST(o_orderkey % 10 AS INT) AS observed_parts",
    "CASE WHEN o_orderkey % 19 = 0 THEN 'superseded' ELSE 'active' END AS status", "o_orderkey % 10 / CAST(10 AS DOUBLE) AS match_confidence",
]
_PARTS = [
    "l_orderkey * 8 + l_linenumber AS part_id", "l_orderkey AS binary_id", "CAST(l_linenumber + l_orderkey % 5 AS INT) AS part_number", "CAST(9 AS INT) AS total_parts", "CAST(floor(l_extendedprice / 1000) AS BIGINT) AS segment_bytes", "l_shipdate AS posted_at", "'old' AS file_name",
    f"CASE WHEN l_partkey % 11 = 0 THEN 'else.bin' ELSE {_NAME.replace('o_orderkey', 'l_orderkey').replace('o_custkey', 'l_suppkey')} END AS subject_name", "CAST((l_orderkey + l_linenumber) % 3 AS INT) AS subject_index", "CAST(3 AS INT) AS subject_total", "CAST(l_linenumber + l_orderkey % 5 AS INT) AS yenc_part",
    "CAST(12 + l_linenumber % 2 AS INT) AS yenc_total",
]
_EARLIER = ["o_orderkey AS source", "o_orderkey - o_orderkey % 32 + 1 AS target"]
_WAS = "o_orderkey % 19 = 0 AND o_orderkey % 32 <> 1"


def _texts(exprs: list[str], text: str) -> list[str]:
    return [e.replace("{text}", text) for e in exprs]


def _given(spark, sf_dir):
    """Orders as files whose lines are their parts, some merged before."""
    files, parts = (seen(spark, sf_dir, table, _texts(exprs, "STRING")) for table, exprs in (("orders", _FILES), ("lineitem", _PARTS)))
    return files, parts, seen(spark, sf_dir, "orders", _EARLIER, _WAS)


def multipart_edges(spark, sf_dir):
    """Where each file that is merged away ends."""
    return subject_regroup.regrouped_edges(*_given(spark, sf_dir))


def multipart_files(spark, sf_dir):
    """All files after the merge."""
    return subject_regroup.regrouped(*_given(spark, sf_dir))["files"]


def multipart_parts(spark, sf_dir):
    """The parts that the merge leaves, and how many are their file's, by file."""
    return subject_regroup.regrouped(*_given(spark, sf_dir))["parts"].withColumn("posted_at", F.col("posted_at").cast("date"))


_PLAIN = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_STEM = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '\.[^.]+$', ''), '[^a-z0-9]+', ' ', 'g'))"
_SQL = f"""WITH RECURSIVE {seen_sql("files", "orders", _texts(_FILES, "VARCHAR"))}, {seen_sql("parts", "lineitem", _texts(_PARTS, "VARCHAR"))}, {seen_sql("before_", "orders", _EARLIER, _WAS)},
        named AS MATERIALIZED (SELECT *, CASE WHEN release_family_key <> '' THEN release_family_key WHEN base_stem <> '' THEN base_stem ELSE source_key END AS family FROM files),
        loose AS (SELECT * FROM named WHERE family_kind = 'contextual_obfuscated' AND identity_reason = 'contextual_fallback' AND status <> 'superseded' AND observed_parts < 9 AND trim(file_name) <> ''),
        frag AS MATERIALIZED (SELECT * FROM loose l WHERE (SELECT count(*) FROM loose k WHERE k.group_id = l.group_id AND k.family = l.family AND k.file_name = l.file_name) > 1),
        loc AS MATERIALIZED (
          SELECT f.group_id, f.family, p.subject_name, p.subject_index, p.subject_total, p.yenc_total, f.binary_id, p.yenc_part AS num
          FROM frag f JOIN parts p ON p.binary_id = f.binary_id AND lower(trim(p.subject_name)) = lower(trim(f.file_name)) WHERE p.subject_index > 0),
        g0 AS (SELECT group_id, family, subject_name, subject_index, subject_total, yenc_total, min(binary_id) AS least, count(*) AS n FROM loc GROUP BY ALL HAVING count(DISTINCT binary_id) > 1 AND count(DISTINCT num) > 1),
        g AS MATERIALIZED (
          SELECT g0.*, {_STEM('subject_name')} AS stem, {_STEM('subject_name')} || '::' || {_PLAIN('subject_name')} AS ckey,
                 (SELECT min(f.binary_id) FROM files f WHERE f.group_id = g0.group_id AND f.binary_key = {_STEM('subject_name')} || '::' || {_PLAIN('subject_name')} AND f.status <> 'superseded') AS canon FROM g0),
        again AS MATERIALIZED (
          SELECT b.source, b.target FROM before_ b JOIN files t ON t.binary_id = b.target AND t.identity_reason <> 'subject_multipart_obfuscated' WHERE (SELECT count(DISTINCT part_number) FROM parts p WHERE p.binary_id = b.target) > 1),
        raw AS (
          SELECT l.binary_id AS source, coalesce(canon, least) AS target FROM loc l JOIN g USING (group_id, family, subject_name, subject_index, subject_total, yenc_total) WHERE l.binary_id <> coalesce(canon, least)
          UNION SELECT source, target FROM again WHERE source <> target),
        ranked AS (SELECT source, target, CASE WHEN source IN (SELECT canon FROM g WHERE canon IS NOT NULL) THEN 0 ELSE 1 END AS sr, CASE WHEN target IN (SELECT canon FROM g WHERE canon IS NOT NULL) THEN 0 ELSE 1 END AS tr FROM raw),
        turned AS (SELECT CASE WHEN (sr, source) < (tr, target) THEN target ELSE source END AS source, CASE WHEN (sr, source) < (tr, target) THEN source ELSE target END AS target, CASE WHEN (sr, source) < (tr, target) THEN sr ELSE tr END AS rank FROM ranked),
        step AS MATERIALIZED (SELECT source, arg_min(target, (rank, target)) AS target FROM turned GROUP BY source),
        walk AS (SELECT source, target, 1 AS d FROM step UNION ALL SELECT w.source, s.target, d + 1 FROM walk w JOIN step s ON w.target = s.source),
        edges AS MATERIALIZED (SELECT source, arg_max(target, d) AS target FROM walk GROUP BY source),
        voices AS (
          SELECT coalesce(canon, least) AS target, -n AS place, subject_name AS name, family, stem, ckey, subject_index AS idx, subject_total AS many, yenc_total AS total FROM g
          UNION ALL SELECT a.target, 0, f.file_name, f.family, {_STEM('f.file_name')}, {_STEM('f.file_name')} || '::' || {_PLAIN('f.file_name')}, greatest(f.file_index, 1), greatest(f.expected_files, 1), greatest(f.total_parts, 1)
          FROM again a JOIN named f ON f.binary_id = a.source WHERE trim(f.file_name) <> ''),
        placed AS (SELECT coalesce(e.target, v.target) AS id, v.* EXCLUDE (target) FROM voices v LEFT JOIN edges e ON e.source = v.target),
        says AS MATERIALIZED (
          SELECT *, max(total) OVER (PARTITION BY id) AS most_total, max(many) OVER (PARTITION BY id) AS most_many FROM placed
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, name, family, stem, ckey, idx, many, total) = 1),
        moved AS (
          SELECT p.part_id, coalesce(e.target, p.binary_id) AS binary_id, p.part_number, CASE WHEN e.target IS NULL THEN p.total_parts ELSE greatest(p.total_parts, s.most_total) END AS total_parts, p.segment_bytes, CAST(p.posted_at AS DATE) AS posted_at,
                 CASE WHEN e.target IS NULL THEN p.file_name ELSE s.name END AS file_name, s.id IS NOT NULL AS merged
          FROM parts p LEFT JOIN edges e ON e.source = p.binary_id LEFT JOIN says s ON s.id = coalesce(e.target, p.binary_id)),
        stay AS MATERIALIZED (SELECT * FROM moved QUALIFY NOT merged OR row_number() OVER (PARTITION BY binary_id, part_number ORDER BY segment_bytes DESC, part_id, posted_at, file_name, total_parts) = 1)"""

QUERIES = {f.__name__: f for f in (multipart_edges, multipart_files, multipart_parts)}
ORACLE_SQL = {
    "multipart_edges": f"{_SQL} SELECT source, target FROM edges",
    "multipart_parts": f"{_SQL} SELECT binary_id, part_number, part_id, total_parts, segment_bytes, posted_at, file_name FROM stay",
    "multipart_files": rf"""{_SQL},
        counted AS (SELECT binary_id, count(*) AS seen, CAST(sum(segment_bytes) AS BIGINT) AS bytes FROM stay WHERE merged GROUP BY 1),
        rows_ AS (SELECT f.*, s.* EXCLUDE (id), c.seen, c.bytes, e.target, s.id IS NOT NULL AND e.target IS NULL AS hit FROM files f LEFT JOIN says s ON s.id = f.binary_id LEFT JOIN counted c ON c.binary_id = f.binary_id LEFT JOIN edges e ON e.source = f.binary_id)
        SELECT binary_id, group_id, CASE WHEN hit THEN ckey ELSE binary_key END AS binary_key, CASE WHEN hit THEN family ELSE release_family_key END AS release_family_key, CASE WHEN hit THEN stem ELSE base_stem END AS base_stem, CASE WHEN hit THEN family ELSE source_key END AS source_key,
               CASE WHEN hit THEN name ELSE file_name END AS file_name, CASE WHEN hit THEN 'subject_multipart_obfuscated' ELSE family_kind END AS family_kind, CASE WHEN hit THEN 'subject_multipart_obfuscated' ELSE identity_reason END AS identity_reason,
               CAST(CASE WHEN hit THEN greatest(idx, 1) ELSE file_index END AS INTEGER) AS file_index, CAST(CASE WHEN hit THEN greatest(expected_files, most_many) ELSE expected_files END AS INTEGER) AS expected_files,
               CAST(CASE WHEN hit THEN greatest(total_parts, most_total) ELSE total_parts END AS INTEGER) AS total_parts, CAST(CASE WHEN hit THEN seen ELSE observed_parts END AS BIGINT) AS observed_parts,
               CASE WHEN target IS NOT NULL THEN 'superseded' WHEN hit THEN 'active' ELSE status END AS status, CASE WHEN hit THEN greatest(match_confidence, 0.86::DOUBLE) ELSE match_confidence END AS match_confidence, target AS superseded_by,
               CASE WHEN hit THEN regexp_matches(lower(name), '(\.par2|\.nfo|\.sfv|\.srr|\.srs|\.jpg|\.jpeg|\.png|\.gif|\.txt)$') END AS is_auxiliary, CASE WHEN hit THEN bytes END AS total_bytes
        FROM rows_""",
}
