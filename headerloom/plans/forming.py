"""Queries on the way from files to releases and on what is merged, kept and cleaned up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from headerloom.operators import lifecycle, merge
from headerloom.plans.views import seen, seen_sql

NOW = dt.datetime(2024, 1, 25)

_KINDS = "CASE k % 5 WHEN 0 THEN 'contextual_obfuscated' WHEN 1 THEN 'numeric_obfuscated_set' WHEN 2 THEN 'opaque_set' WHEN 3 THEN 'readable_title' ELSE 'archive_stem' END"
_NAMES = "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN concat('f', CAST(k AS STRING), '.part03.rar') WHEN 2 THEN concat('f', CAST(k AS STRING), '.MKV ') WHEN 3 THEN concat('f', CAST(k AS STRING), '.bin') WHEN 4 THEN NULL WHEN 5 THEN 'a.7z.002' ELSE 'b.r07' END"
_IDENTITY = [
    "o_orderkey AS binary_id", f"{_KINDS.replace('k %', 'o_orderkey %')} AS kind", "CASE o_custkey % 3 WHEN 0 THEN 'weak' WHEN 1 THEN ' Provisional' ELSE 'strong' END AS strength", f"{_NAMES.replace('k %', 'o_orderkey %').replace('CAST(k', 'CAST(o_orderkey')} AS file_name",
    "concat('fam ', CAST(o_custkey AS STRING)) AS family_key", "concat('set ', CAST(o_custkey AS STRING)) AS file_set_key", "concat('stem', CAST(o_custkey AS STRING)) AS base_stem",
]
_HEADERS = [
    "l_orderkey * 10 + l_linenumber AS header_id", "l_orderkey % 3 AS group_id", "CASE WHEN l_partkey % 29 = 0 THEN ' ' ELSE concat('bin', CAST(l_orderkey % 4000 AS STRING)) END AS binary_key", "l_partkey % 100 / CAST(100 AS DOUBLE) AS confidence",
    "concat('n', CAST(l_partkey AS STRING)) AS file_name", "CASE WHEN l_partkey % 2 = 0 THEN 'archive_stem' ELSE 'opaque_set' END AS kind", "l_linenumber AS part_number", "CAST(l_suppkey % 9 AS INT) AS total_parts", "CAST(floor(l_extendedprice) AS BIGINT) AS bytes",
]
_INCOMPLETE = [
    "o_orderkey % 4 AS group_id", "o_orderkey AS binary_id", "CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE concat(' Name', CAST(o_custkey AS STRING), '.RAR') END AS file_name", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS binary_name",
    "o_custkey % 11 AS total_parts", "o_orderkey % 9 AS observed_parts",
]
_OLD = [
    "o_orderkey AS binary_id", "concat('old', CAST(o_custkey AS STRING)) AS family_key", "o_orderkey % 10 / CAST(10 AS DOUBLE) AS confidence", "o_orderkey % 8 AS file_index", "o_orderkey % 5 AS expected_files",
]
_NEW = [
    "o_orderkey AS binary_id", "concat('new', CAST(o_custkey AS STRING)) AS family_key", "o_custkey % 10 / CAST(10 AS DOUBLE) AS confidence", "o_custkey % 6 AS file_index", "o_custkey % 7 AS expected_files",
]


def _release(n: int) -> list[str]:
    k = f"(p_partkey * {n} + {n})"
    return [
        "p_partkey AS release_id", f"concat('title ', CAST({k} AS STRING)) AS title", f"CASE {k} % 4 WHEN 0 THEN 'source' WHEN 1 THEN '' WHEN 2 THEN 'predb' ELSE 'nfo' END AS title_source", f"{k} % 10 / CAST(10 AS DOUBLE) AS title_confidence",
        f"concat('search ', CAST({k} AS STRING)) AS search_title", f"{k} % 9 AS expected_files", f"{k} % 4 AS archive_count", f"{k} % 100 AS media_quality", f"{k} % 6 = 1 AS password_known", f"{k} % 5 < 2 AS password_unknown", f"{k} % 3 = 0 AS has_par2",
        f"{k} % 7 = 0 AS has_nfo", f"CASE WHEN {k} % 3 = 1 THEN '' ELSE concat(CAST({k} % 5 AS STRING), '80p') END AS resolution", f"CASE WHEN {k} % 2 = 1 THEN '' ELSE 'h264' END AS video_codec", f"{k} % 3 * 100 AS runtime", f"{k} * 17 % 999 AS size_bytes",
        f"{k} % 50 AS metadata_at", f"{k} % 1000 AS updated_at",
    ]


_COHORTS = lambda n: ["o_custkey AS cohort_key", f"max(o_orderkey * {n} % 1000) AS score", f"min(o_orderkey * {n} % 7) AS priority"]
_FAMILY = [
    "o_custkey % 120 AS family_key", "CASE WHEN o_custkey % 120 < 60 THEN 'contextual_obfuscated' ELSE " + _KINDS.replace("k %", "o_orderkey %") + " END AS kind", "o_orderkey % 4 AS file_index", "o_custkey % 120 % 6 AS expected_files",
    "CASE o_custkey % 120 % 3 WHEN 0 THEN concat('s', CAST(o_orderkey AS STRING)) WHEN 1 THEN concat('s', CAST(o_orderkey % 3 AS STRING)) ELSE ' ' END AS stem", f"CASE WHEN o_custkey % 120 % 4 = 0 THEN 'x.bin' ELSE {_NAMES.replace('k %', 'o_orderkey %').replace('CAST(k', 'CAST(o_orderkey')} END AS file_name",
    "o_orderstatus = 'F' AND o_custkey % 120 % 7 <> 3 AS is_complete", "o_orderkey % 200 = 3 AS recoverable", "o_orderkey AS binary_id",
]
_CANDIDATES = [
    "CASE o_orderkey % 3 WHEN 0 THEN 'release_family' WHEN 1 THEN 'base_stem' ELSE 'recovered_file_set' END AS key_kind", "concat('f', CAST(o_orderkey AS STRING)) AS family_key", "CASE WHEN o_orderkey % 4 = 0 THEN 'fragment_only' ELSE 'actionable' END AS bucket",
    "o_orderkey % 5 AS expected_files", "o_custkey % 3 AS expected_archives", "o_orderkey % 11 * 10 AS file_coverage", "o_custkey % 11 * 10 AS archive_coverage", "o_orderkey % 4 AS complete_main", "o_custkey % 6 AS complete", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey * 7 % 500 END AS updated_at",
]
_ACKS = ["CASE o_orderkey % 3 WHEN 0 THEN 'release_family' WHEN 1 THEN 'base_stem' ELSE 'recovered_file_set' END AS key_kind", "concat('f', CAST(o_orderkey AS STRING)) AS family_key", "o_custkey % 500 AS processed_at"]
_GATE = [
    "o_orderkey AS release_id", "o_orderkey % 4 AS main", "o_custkey % 3 AS complete_main", "o_orderkey % 5 - 1 AS expected_files", "o_custkey % 4 - 1 AS expected_archives", "o_orderkey % 7 = 0 AS is_file_set", "o_custkey % 6 = 0 AS strong_title", "o_orderkey % 3 = 0 AS usable_name",
    "o_custkey % 5 < 2 AS split_archives", "o_orderkey % 9 < 3 AS weak_title", "o_custkey % 7 < 2 AS contextual", "o_orderkey % 11 < 4 AS standalone", "o_custkey % 13 = 0 AS auxiliary_evidence",
]
_TITLES = [
    "l_partkey AS release_id", "CASE l_linenumber WHEN 1 THEN 'predb' WHEN 2 THEN 'inspection' WHEN 3 THEN 'nfo' WHEN 4 THEN 'file' ELSE 'source' END AS source", "l_suppkey % 6 / CAST(5 AS DOUBLE) AS confidence",
    "CASE l_orderkey % 8 WHEN 0 THEN 'a1b2c3d4e5f6g7' WHEN 1 THEN concat('The.Great_Film.', CAST(1990 + l_linenumber AS STRING)) WHEN 2 THEN concat('Holiday ', CAST(2001 + l_linenumber AS STRING)) WHEN 3 THEN 'deadbeef99' WHEN 4 THEN '12.34_56' WHEN 5 THEN ' ' WHEN 6 THEN 'Two Words  here' ELSE 'x y z' END AS title",
]
_STORED = ["o_orderkey % 700 AS release_id", "concat('file', CAST(o_orderkey % 5 AS STRING)) AS file_name", "o_orderkey AS binary_id"]
_BINARIES = ["o_orderkey AS binary_id", "o_custkey % 20 AS observed_parts", "o_custkey % 30 AS total_parts", "o_orderkey % 100 / CAST(100 AS DOUBLE) AS confidence"]
_RELEASED = ["o_orderkey AS release_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'release_family' ELSE 'base_stem' END AS key_kind", "o_custkey AS family_key", "CONCAT('g', CAST(o_orderkey % 4 AS STRING)) AS group_name", "o_orderkey % 3 AS payload_files", "o_orderdate AS posted_at"]
_RAW = ["event_id AS header_id", "CASE event_type WHEN 'click' THEN 'hot' WHEN 'view' THEN 'warm' WHEN 'error' THEN 'cold' ELSE 'none' END AS tier", "ts AS posted_at"]
_RANGES = ["event_type AS group_name", "user_id % 5 AS provider_id", "ts AS oldest_at", "ts AS newest_at", "value > 3 OR event_type = 'view' AS cutoff_reached", "event_id % 50 AS articles"]


def blanked_keys(spark, sf_dir):
    return lifecycle.blanked_keys(seen(spark, sf_dir, "orders", _IDENTITY))


def assembled_files(spark, sf_dir):
    """Files that matched headers make, with their parts counted."""
    files, parts = lifecycle.assembled(seen(spark, sf_dir, "lineitem", _HEADERS))
    counted = parts.groupBy("binary_id").agg(F.count_distinct("part_number").alias("parts"), F.sum("bytes").alias("bytes"))
    return files.join(counted, "binary_id").drop("binary_id")


def completion_keys(spark, sf_dir):
    return lifecycle.completion_keys(seen(spark, sf_dir, "orders", _INCOMPLETE)).withColumn("ratio", F.round("ratio", 4))


def hydrated_candidates(spark, sf_dir):
    """Requested lines with their order's payload and customer, in the order of the request."""
    requests = seen(spark, sf_dir, "orders", ["o_orderkey AS header_id", "o_custkey % 3 AS day", "o_orderkey * 7919 % 100003 AS ord"], "o_orderkey % 9 = 1")
    headers = seen(spark, sf_dir, "orders", ["o_orderkey AS header_id", "o_custkey % 3 AS day", "o_custkey % 500 AS poster_id"], "o_orderkey % 2 = 1")
    payloads = seen(spark, sf_dir, "orders", ["o_orderkey AS header_id", "o_custkey % 3 AS day", "o_orderpriority AS payload"], "o_orderkey % 3 <> 0")
    return lifecycle.hydrated(requests, headers, payloads, seen(spark, sf_dir, "customer", ["c_custkey AS poster_id", "c_name AS poster"])).select("ord", "header_id", "day", "payload", "poster")


def identity_no_downgrade(spark, sf_dir):
    stored, incoming = seen(spark, sf_dir, "orders", _OLD, "o_orderkey % 3 <> 0"), seen(spark, sf_dir, "orders", _NEW, "o_orderkey % 4 <> 0")
    return merge.merged(stored, incoming, ["binary_id"], merge.no_downgrade(["family_key"]))


def release_upsert(spark, sf_dir):
    stored, incoming = seen(spark, sf_dir, "part", _release(3), "p_partkey % 5 <> 0"), seen(spark, sf_dir, "part", _release(7), "p_partkey % 7 <> 0")
    return merge.merged(stored, incoming, ["release_id"], merge.release_rules() | merge.touched(["size_bytes", "has_nfo", "resolution"]))


def cohort_upsert(spark, sf_dir):
    """Cohorts scheduled again: scores, priorities, and statuses that stick."""
    side = lambda n, status, cool: seen(spark, sf_dir, "orders", ["*"]).groupBy(F.col("o_custkey").alias("cohort_key")).agg(F.max(F.col("o_orderkey") * n % 1000).alias("score"), F.min(F.col("o_orderkey") * n % 7).alias("priority")).selectExpr("*", f"{status} AS status", f"{cool} AS cooldown_until")
    stored = side(3, "CASE cohort_key % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'cooldown' WHEN 2 THEN 'cooldown' ELSE 'active' END", "CASE cohort_key % 4 WHEN 1 THEN TIMESTAMP_NTZ '2024-01-30 00:00:00' WHEN 2 THEN TIMESTAMP_NTZ '2024-01-20 00:00:00' END")
    incoming = side(7, "'active'", "CAST(NULL AS TIMESTAMP_NTZ)")
    return merge.merged(stored, incoming, ["cohort_key"], merge.cohort_rules(NOW)).drop("cooldown_until")


def replaced_children(spark, sf_dir):
    """Matches of orders: those of the orders that were matched again are the new ones, even if there are none."""
    match = ["l_orderkey AS release_id", "l_partkey AS match_id", "l_returnflag AS chosen"]
    parents = seen(spark, sf_dir, "orders", ["o_orderkey AS release_id"], "o_custkey % 3 = 0")
    out = merge.replace_children(seen(spark, sf_dir, "lineitem", match, "l_linenumber <= 3"), seen(spark, sf_dir, "lineitem", match, "l_linenumber > 3"), parents, "release_id")
    return out.groupBy("chosen").agg(F.count("*").alias("n"), F.sum("release_id").alias("releases"), F.sum("match_id").alias("matches"))


def standalone_buckets(spark, sf_dir):
    """Buckets of families of a single dominant file, with the standalone exception."""
    rows = seen(spark, sf_dir, "orders", ["o_orderkey AS family_key", f"{_KINDS.replace('k %', 'o_custkey %')} AS kind", "o_orderkey % 3 AS binaries", "o_custkey % 2 AS complete_main", "o_orderkey % 4 - 1 AS expected_files", "o_custkey % 20 / CAST(20 AS DOUBLE) AS confidence",
        "CASE o_orderkey % 5 WHEN 0 THEN 'a.MKV' WHEN 1 THEN 'b.mp3' WHEN 2 THEN 'c.rar' WHEN 3 THEN NULL ELSE 'mkv' END AS file_name", "CASE WHEN o_custkey % 3 = 0 THEN 'abcdef123456' ELSE 'film one' END AS stem"])
    return lifecycle.bucket(rows).select("family_key", "bucket")


def refined_families(spark, sf_dir):
    files = seen(spark, sf_dir, "orders", _FAMILY)
    summary = files.groupBy("family_key").agg(F.count("*").alias("binaries"), F.count_if("is_complete").alias("c")).select(
        "family_key", "binaries", F.when(F.col("family_key") % 9 == 0, F.concat(F.col("family_key") + 10000, F.lit(" a bc"))).otherwise("a name").alias("name"), F.when((F.col("c") > 0) & (F.col("family_key") % 5 != 1), "actionable").otherwise("fragment_only").alias("bucket"))
    return lifecycle.refined(summary, lifecycle.shapes(files))


def release_candidates(spark, sf_dir):
    return lifecycle.candidates(seen(spark, sf_dir, "orders", _CANDIDATES), seen(spark, sf_dir, "orders", _ACKS, "o_custkey % 2 = 0"), 400)


def ready_candidates(spark, sf_dir):
    """Families whose summary is actionable: what is kept as ready."""
    return seen(spark, sf_dir, "orders", _CANDIDATES).where("bucket = 'actionable' and complete_main > 0").groupBy("key_kind").agg(F.count("*").alias("ready"), F.max("updated_at").alias("last_change"))


def dirty_windows(spark, sf_dir):
    keys = seen(spark, sf_dir, "orders", ["o_custkey AS family_key", "CASE o_custkey % 5 WHEN 0 THEN 'actionable' WHEN 1 THEN NULL WHEN 2 THEN 'fragment_only' ELSE 'weak_single_binary' END AS bucket", "o_orderkey * 37 % 9001 AS dirty_at"])
    return lifecycle.dirty_windows(keys, 120, 60)


def persist_gate(spark, sf_dir):
    rows = seen(spark, sf_dir, "orders", _GATE)
    reason = lifecycle.persist_reason({c: F.col(c) for c in rows.columns})
    return rows.select("release_id", reason.isNull().alias("stored"), reason.alias("reason"))


def resolved_titles(spark, sf_dir):
    return lifecycle.resolved_titles(seen(spark, sf_dir, "lineitem", _TITLES))


def catalog_files(spark, sf_dir):
    return lifecycle.catalog_files(seen(spark, sf_dir, "orders", _STORED), seen(spark, sf_dir, "orders", _BINARIES, "o_orderkey % 4 <> 0"))


def stale_releases(spark, sf_dir):
    """Releases that a new forming leaves without a place, and auxiliary siblings."""
    released = seen(spark, sf_dir, "orders", _RELEASED)
    stale = lifecycle.stale_releases(released, released.where("family_key % 3 = 0 and group_name <> 'g2'"))
    siblings = lifecycle.auxiliary_only_siblings(released.where("family_key % 3 = 1"))
    return stale.select("release_id", F.lit("stale").alias("why")).unionByName(siblings.select("release_id", F.lit("auxiliary").alias("why")))


def nzb_candidates(spark, sf_dir):
    released = seen(spark, sf_dir, "orders", _RELEASED, "o_orderstatus <> 'P'").select("release_id", "posted_at")
    cached, archived = seen(spark, sf_dir, "orders", ["o_orderkey AS release_id"], "o_custkey % 4 = 0"), seen(spark, sf_dir, "orders", ["o_orderkey AS release_id", "CASE WHEN o_custkey % 5 < 2 THEN 'archived' ELSE 'failed' END AS archive_status"])
    return lifecycle.export_candidates(released, cached, archived, 300)


def raw_retention(spark, sf_dir):
    """Headers that may go, by tier: older than their tier's hours, and in no keep set."""
    h = seen(spark, sf_dir, "events", _RAW)
    gone = lifecycle.raw_expired(h, {"hot": 300, "warm": 200, "cold": 100}, NOW, seen(spark, sf_dir, "events", ["event_id AS header_id"], "value > 60"), seen(spark, sf_dir, "events", ["event_id AS header_id"], "user_id % 7 = 0"))
    return gone.groupBy("tier").agg(F.count("*").alias("n"), F.min("header_id").alias("first"), F.max("header_id").alias("last"))


def orphan_cleanup(spark, sf_dir):
    """Lines of orders that are gone, by part of the supply."""
    return lifecycle.orphans(seen(spark, sf_dir, "lineitem", ["l_orderkey AS release_id", "l_linenumber"]), seen(spark, sf_dir, "orders", ["o_orderkey AS release_id"], "o_orderstatus <> 'O'"), "release_id").groupBy("l_linenumber").agg(F.count("*").alias("n"))


def poster_keys(spark, sf_dir):
    """The poster dimension with its new names; keys of new names are there and differ."""
    known = seen(spark, sf_dir, "customer", ["c_name AS poster", "c_custkey AS poster_id"], "c_custkey % 3 <> 0")
    out = lifecycle.assigned_keys(known, seen(spark, sf_dir, "customer", ["c_name AS poster"]), "poster", "poster_id")
    return out.groupBy("is_new").agg(F.count("*").alias("n"), F.count_distinct("poster_id").alias("different"), F.min("poster").alias("first"))


def bounded_scan(spark, sf_dir):
    """Two cuts: of the newest 400 files those that are open, of these the 100 largest."""
    o = seen(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus", "CAST(floor(o_totalprice) AS BIGINT) AS size"])
    return lifecycle.bounded_scan(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 100, 4, F.col("o_orderstatus") == "O", [F.desc("size"), F.asc("o_orderkey")]).select("o_orderkey", "size")


def backfill_progress(spark, sf_dir):
    return lifecycle.progress(seen(spark, sf_dir, "events", _RANGES))


QUERIES = {
    f.__name__: f
    for f in (
        blanked_keys, assembled_files, completion_keys, hydrated_candidates, identity_no_downgrade, release_upsert, cohort_upsert, replaced_children, standalone_buckets, refined_families, release_candidates, ready_candidates, dirty_windows,
        persist_gate, resolved_titles, catalog_files, stale_releases, nzb_candidates, raw_retention, orphan_cleanup, poster_keys, bounded_scan, backfill_progress,
    )
}

_READABLE = "NOT (t = '' OR regexp_full_match(t, '[a-z0-9]{12,}') OR regexp_full_match(t, '[0-9a-f]{8,}') OR regexp_full_match(t, '[0-9\\s._-]+')) AND (len(regexp_extract_all(t, '\\p{L}{3,}')) >= 2 OR len(regexp_extract_all(t, '\\p{L}{3,}')) = 1 AND regexp_matches(t, '(^|\\D)(19[5-9]\\d|20\\d\\d)(\\D|$)'))"
_MAIN = "regexp_matches(lower(trim(coalesce(file_name, ''))), '\\.(rar|r\\d\\d|7z|7z\\.\\d+|zip|zip\\.\\d+|par2|nfo|sfv|mkv|mp4|avi|mov|mp3|flac|m4a|wav)$')"

ORACLE_SQL = {
    "blanked_keys": f"""WITH {seen_sql("i", "orders", _IDENTITY)},
        w AS (SELECT *, binary_id % 5 < 3 AND strength <> 'strong' AND binary_id % 7 IN (0, 3, 4) AS weak FROM i)
        SELECT binary_id, kind, strength, file_name, CASE WHEN weak THEN '' ELSE family_key END AS family_key, CASE WHEN weak THEN '' ELSE file_set_key END AS file_set_key, CASE WHEN weak THEN '' ELSE base_stem END AS base_stem FROM w""",
    "assembled_files": f"""WITH {seen_sql("h", "lineitem", _HEADERS)},
        f AS (SELECT *, row_number() OVER (PARTITION BY group_id, binary_key ORDER BY confidence DESC, header_id, file_name DESC) AS place FROM h WHERE binary_key <> ' '),
        g AS (SELECT group_id, binary_key, max(total_parts) AS total_parts, count(*) AS headers, count(DISTINCT part_number) AS parts, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY 1, 2)
        SELECT g.*, confidence, file_name, kind FROM g JOIN f ON f.group_id = g.group_id AND f.binary_key = g.binary_key AND place = 1""",
    "completion_keys": f"""WITH {seen_sql("f", "orders", _INCOMPLETE)},
        n AS (SELECT *, lower(trim(CASE WHEN trim(coalesce(file_name, '')) <> '' THEN trim(file_name) ELSE binary_name END)) AS name_key FROM f)
        SELECT group_id, name_key, binary_id, round(observed_parts::DOUBLE / total_parts, 4) AS ratio FROM n WHERE total_parts > observed_parts AND total_parts > 0 AND name_key <> ''""",
    "hydrated_candidates": """
        SELECT q.o_orderkey * 7919 % 100003 AS ord, q.o_orderkey AS header_id, q.o_custkey % 3 AS day, CASE WHEN q.o_orderkey % 3 <> 0 THEN q.o_orderpriority END AS payload, c_name AS poster
        FROM orders q LEFT JOIN customer ON c_custkey = q.o_custkey % 500 WHERE q.o_orderkey % 9 = 1 AND q.o_orderkey % 2 = 1""",
    "identity_no_downgrade": f"""WITH {seen_sql("a", "orders", _OLD, "o_orderkey % 3 <> 0")}, {seen_sql("b", "orders", _NEW, "o_orderkey % 4 <> 0")}
        SELECT coalesce(a.binary_id, b.binary_id) AS binary_id, CASE WHEN a.binary_id IS NULL OR b.confidence >= a.confidence THEN b.family_key ELSE a.family_key END AS family_key, greatest(a.confidence, b.confidence) AS confidence,
               CASE WHEN a.binary_id IS NULL OR b.confidence >= a.confidence AND b.file_index > 0 THEN b.file_index ELSE a.file_index END AS file_index, greatest(a.expected_files, b.expected_files) AS expected_files
        FROM a FULL JOIN b ON a.binary_id = b.binary_id""",
    "release_upsert": f"""WITH {seen_sql("a", "part", _release(3), "p_partkey % 5 <> 0")}, {seen_sql("b", "part", _release(7), "p_partkey % 7 <> 0")},
        j AS (SELECT a.release_id AS x, b.release_id AS y, a.title_source IN ('predb', 'nfo') AND b.title_source IN ('', 'source') OR b.release_id IS NULL AS sticks, a, b FROM a FULL JOIN b ON a.release_id = b.release_id)
        SELECT coalesce(x, y) AS release_id, CASE WHEN sticks THEN a.title ELSE b.title END AS title, CASE WHEN sticks THEN a.title_source ELSE b.title_source END AS title_source, CASE WHEN sticks THEN a.title_confidence ELSE b.title_confidence END AS title_confidence,
               CASE WHEN sticks THEN a.search_title ELSE b.search_title END AS search_title, greatest(a.expected_files, b.expected_files) AS expected_files, greatest(a.archive_count, b.archive_count) AS archive_count, greatest(a.media_quality, b.media_quality) AS media_quality,
               coalesce(a.password_known, false) OR coalesce(b.password_known, false) AS password_known,
               CASE WHEN x IS NULL THEN b.password_unknown WHEN y IS NULL THEN a.password_unknown ELSE NOT (a.password_known OR b.password_known) AND (a.password_unknown OR b.password_unknown) END AS password_unknown,
               coalesce(a.has_par2, false) OR coalesce(b.has_par2, false) AS has_par2, coalesce(a.has_nfo, false) OR coalesce(b.has_nfo, false) AS has_nfo,
               CASE WHEN x IS NULL THEN b.resolution ELSE coalesce(nullif(b.resolution, ''), a.resolution) END AS resolution, CASE WHEN x IS NULL THEN b.video_codec ELSE coalesce(nullif(b.video_codec, ''), a.video_codec) END AS video_codec,
               CASE WHEN x IS NULL OR b.runtime > 0 THEN b.runtime ELSE a.runtime END AS runtime, coalesce(b.size_bytes, a.size_bytes) AS size_bytes, greatest(a.metadata_at, b.metadata_at) AS metadata_at,
               CASE WHEN x IS NULL OR y IS NOT NULL AND (a.size_bytes <> b.size_bytes OR a.has_nfo <> b.has_nfo OR a.resolution <> b.resolution) THEN b.updated_at ELSE a.updated_at END AS updated_at
        FROM j""",
    "cohort_upsert": """
        SELECT o_custkey AS cohort_key, greatest(max(o_orderkey * 3 % 1000), max(o_orderkey * 7 % 1000)) AS score, least(min(o_orderkey * 3 % 7), min(o_orderkey * 7 % 7)) AS priority,
               CASE o_custkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'cooldown' ELSE 'active' END AS status FROM orders GROUP BY o_custkey""",
    "replaced_children": """
        SELECT l_returnflag AS chosen, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS releases, CAST(sum(l_partkey) AS BIGINT) AS matches FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_custkey % 3 = 0
        WHERE o_orderkey IS NULL AND l_linenumber <= 3 OR o_orderkey IS NOT NULL AND l_linenumber > 3 GROUP BY 1""",
    "standalone_buckets": """
        WITH f AS (SELECT o_orderkey AS family_key, o_custkey % 5 AS kind, o_orderkey % 3 AS n, o_custkey % 2 AS main, o_orderkey % 4 - 1 AS expected, o_custkey % 5 <> 0 AND o_custkey % 20 >= 17 AND o_orderkey % 5 IN (0, 1) AND o_custkey % 3 <> 0 AS alone FROM orders)
        SELECT family_key, CASE WHEN n = 0 THEN 'stale_cleanup_only' WHEN n = 1 AND main = 1 AND expected <= 0 AND NOT alone THEN 'weak_single_binary' WHEN main = 0 THEN 'fragment_only' WHEN kind IN (1, 2) THEN 'weak_obfuscated_set' ELSE 'actionable' END AS bucket FROM f""",
    "refined_families": f"""WITH {seen_sql("f", "orders", _FAMILY)},
        s AS (
          SELECT family_key, count(*) AS n, bool_and(kind = 'contextual_obfuscated') AS ctx, max(expected_files) AS most, count(*) FILTER (file_index > 0) AS indexed, count(*) FILTER (trim(stem) <> '') AS have, count(DISTINCT stem) FILTER (trim(stem) <> '') AS stems,
                 bool_or({_MAIN}) AS usable, bool_or(NOT is_complete AND recoverable) AS may, count(*) FILTER (is_complete) > 0 AND family_key % 5 <> 1 AS act FROM f GROUP BY 1),
        r AS (
          SELECT *, CASE WHEN NOT act AND family_key % 9 = 0 AND NOT usable THEN 'weak_obfuscated_set' WHEN NOT act THEN 'fragment_only' WHEN ctx AND most > 1 AND indexed >= 2 AND have = stems AND stems >= 8 AND stems >= most AND n >= 24 AND n >= 3 * most THEN 'overgrouped_contextual'
                         WHEN ctx AND most > 1 AND indexed >= 2 AND have >= 2 AND stems < have THEN 'prefer_base_stem' ELSE 'actionable' END AS bucket FROM s)
        SELECT family_key, bucket, bucket NOT IN ('actionable', 'prefer_base_stem') AND may AS recover_pending FROM r""",
    "release_candidates": f"""WITH {seen_sql("c", "orders", _CANDIDATES)}, {seen_sql("k", "orders", _ACKS, "o_custkey % 2 = 0")},
        d AS (SELECT c.*, CASE WHEN expected_archives > 0 THEN archive_coverage ELSE file_coverage END AS coverage, processed_at FROM c LEFT JOIN k ON c.key_kind = k.key_kind AND c.family_key = k.family_key WHERE bucket = 'actionable')
        SELECT key_kind, family_key, coverage, complete_main FROM d WHERE processed_at IS NULL OR updated_at > processed_at
        ORDER BY coverage DESC, complete_main DESC, complete DESC, (expected_files > 0 OR expected_archives > 0) DESC, CASE key_kind WHEN 'recovered_file_set' THEN 0 WHEN 'base_stem' THEN 1 ELSE 2 END, updated_at ASC NULLS LAST, family_key LIMIT 400""",
    "ready_candidates": f"WITH {seen_sql('c', 'orders', _CANDIDATES)} SELECT key_kind, count(*) AS ready, max(updated_at) AS last_change FROM c WHERE bucket = 'actionable' AND complete_main > 0 GROUP BY 1",
    "dirty_windows": """
        WITH d AS (SELECT o_custkey AS family_key, min(o_orderkey * 37 % 9001) AS dirty_at, CASE WHEN o_custkey % 5 < 2 THEN 'hot' ELSE 'cold' END AS lane FROM orders GROUP BY o_custkey),
        p AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY dirty_at, family_key) AS place FROM d)
        SELECT lane, family_key, dirty_at FROM p WHERE place <= CASE lane WHEN 'hot' THEN 120 ELSE 60 END""",
    "persist_gate": f"""WITH {seen_sql("g", "orders", _GATE)},
        r AS (
          SELECT release_id, CASE WHEN main = 0 OR complete_main = 0 THEN 'no_main_payload' WHEN greatest(expected_files, expected_archives) > 1 AND main < 2 AND NOT strong_title AND NOT usable_name THEN 'multi_file_single_main_payload'
            WHEN NOT is_file_set AND (greatest(expected_files, expected_archives) <= 0 AND (main > 1 AND split_archives AND NOT strong_title AND weak_title OR contextual AND NOT standalone) OR NOT usable_name AND weak_title) THEN 'contextual_weak'
            WHEN main = 1 AND NOT (standalone OR strong_title OR auxiliary_evidence) THEN 'single_main_payload' END AS reason FROM g)
        SELECT release_id, reason IS NULL AS stored, reason FROM r""",
    "resolved_titles": f"""WITH {seen_sql("a", "lineitem", _TITLES)},
        b AS (SELECT release_id, source, confidence, trim(regexp_replace(translate(title, '._', '  '), '\\s+', ' ', 'g')) AS title FROM a),
        c AS (SELECT *, lower(title) AS t, count(*) OVER (PARTITION BY release_id) AS candidates FROM b WHERE title <> ''),
        d AS (SELECT *, {_READABLE} AS readable FROM c)
        SELECT release_id, title, source, confidence, readable, candidates FROM d
        QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY readable DESC, confidence DESC, list_position(['predb', 'inspection', 'nfo', 'file', 'source'], source), length(title) DESC, title) = 1""",
    "catalog_files": """
        SELECT o_orderkey % 700 AS release_id, concat('file', o_orderkey % 5) AS file_name, coalesce(max(o_custkey % 20) FILTER (o_orderkey % 4 <> 0), 0) AS article_count, coalesce(max(o_custkey % 30) FILTER (o_orderkey % 4 <> 0), 0) AS total_parts,
               coalesce(max(o_orderkey % 100 / 100.0::DOUBLE) FILTER (o_orderkey % 4 <> 0), 0.0::DOUBLE) AS confidence
        FROM orders GROUP BY 1, 2""",
    "stale_releases": """
        SELECT o_orderkey AS release_id, 'stale' AS why FROM orders r WHERE o_custkey % 3 = 0 AND o_orderkey % 4 = 2 AND EXISTS (SELECT 1 FROM orders k WHERE k.o_custkey = r.o_custkey AND k.o_orderkey % 2 = 0 AND k.o_orderkey % 4 <> 2)
        UNION ALL SELECT o_orderkey, 'auxiliary' FROM orders r WHERE o_custkey % 3 = 1 AND o_orderkey % 3 = 0 AND EXISTS (SELECT 1 FROM orders k WHERE k.o_custkey = r.o_custkey AND k.o_orderkey % 3 > 0)""",
    "nzb_candidates": """
        SELECT o_orderkey AS release_id, o_orderdate AS posted_at FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 4 <> 0 AND o_custkey % 5 >= 2 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 300""",
    "raw_retention": """
        WITH h AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'hot' WHEN 'view' THEN 'warm' WHEN 'error' THEN 'cold' ELSE 'none' END AS tier, epoch(TIMESTAMP '2024-01-25' - ts) / 3600 AS age FROM events WHERE NOT (value > 60 OR user_id % 7 = 0))
        SELECT tier, count(*) AS n, min(event_id) AS "first", max(event_id) AS "last" FROM h WHERE age > CASE tier WHEN 'hot' THEN 300 WHEN 'warm' THEN 200 WHEN 'cold' THEN 100 END GROUP BY 1""",
    "orphan_cleanup": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'O') GROUP BY 1",
    "poster_keys": "SELECT c_custkey % 3 = 0 AS is_new, count(*) AS n, count(*) AS different, min(c_name) AS \"first\" FROM customer GROUP BY 1",
    "bounded_scan": """
        WITH n AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 400)
        SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size FROM n WHERE o_orderstatus = 'O' ORDER BY size DESC, o_orderkey LIMIT 100""",
    "backfill_progress": """
        SELECT event_type AS group_name, count(DISTINCT user_id % 5) AS providers, min(ts) AS oldest_at, max(ts) AS newest_at, bool_or(value > 3 OR event_type = 'view') AS any_reached, bool_and(value > 3 OR event_type = 'view') AS all_reached, CAST(sum(event_id % 50) AS BIGINT) AS articles
        FROM events GROUP BY 1""",
}
