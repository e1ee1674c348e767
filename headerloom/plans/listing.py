"""Queries on the catalog as it is served: visibility under each policy, filtered pages, one release, browse categories, the admin list."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from headerloom.operators import policy
from headerloom.operators.policy import Policy
from headerloom.sources.folders import written
from headerloom.sources.tables import table

# The rows that the queries read, in expressions that both engines know.
_K = "p_partkey"
_RELEASES = [
    f"{_K} AS release_id",
    f"CASE {_K} % 37 WHEN 1 THEN 'Unknown-Release' WHEN 2 THEN ' VIP only ' WHEN 3 THEN concat('abcdef', CAST(100000 + {_K} AS STRING), 'xyz') WHEN 4 THEN concat('abcdefghij', CAST(1000000 + {_K} AS STRING), ' part', CAST({_K} % 90 AS STRING)) "
    f"WHEN 5 THEN concat(p_name, ' vol', CAST({_K} % 40 AS STRING), '+2') WHEN 6 THEN '' WHEN 7 THEN NULL ELSE p_name END AS title",
    f"CASE WHEN {_K} % 41 = 1 THEN '' WHEN {_K} % 41 = 2 THEN concat(lower(p_name), ' test') WHEN {_K} % 41 = 3 THEN NULL ELSE lower(p_name) END AS search_title",
    f"CASE {_K} % 43 WHEN 3 THEN 'alt.binaries.TEST' WHEN 4 THEN 'alt.seed-box' WHEN 5 THEN 'alt.testing' ELSE 'alt.binaries.tv' END AS group_name",
    f"CASE WHEN {_K} % 47 = 1 THEN NULL ELSE ({_K} * 7 % 50 + 52) / CAST(100 AS DOUBLE) END AS match_confidence",
    f"CASE WHEN {_K} % 5 = 1 THEN CAST({_K} % 100 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS completion",
    f"CASE {_K} % 11 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL WHEN 2 THEN 'probable' WHEN 3 THEN 'probable' ELSE 'identified' END AS identity_status",
    f"CASE WHEN {_K} % 53 = 1 THEN 0 WHEN {_K} % 53 = 2 THEN NULL ELSE {_K} * 1000 % 77777 + 1 END AS size_bytes",
    f"CASE WHEN {_K} % 7 = 0 THEN NULL ELSE {_K} % 9 END AS expected_files", f"{_K} * 3 % 11 AS file_count", f"{_K} % 3 AS par_file_count", f"{_K} % 2 AS archive_count",
    f"CASE WHEN {_K} % 13 = 0 THEN NULL ELSE {_K} % 6 END AS expected_archive_files", f"CASE {_K} % 3 WHEN 0 THEN 8010 WHEN 1 THEN 5040 ELSE NULL END AS category_id",
    f"CASE {_K} % 29 WHEN 1 THEN 'source_obfuscated' WHEN 2 THEN 'predb' ELSE 'source' END AS title_source", f"CASE WHEN {_K} % 19 = 0 THEN 'clear name' ELSE '' END AS deobfuscated_title",
    f"CASE WHEN {_K} % 4 = 0 THEN 'A Film' ELSE '' END AS matched_media_title", f"CASE WHEN {_K} % 8 = 0 THEN 'Un Film' ELSE '' END AS original_media_title",
    f"CASE WHEN {_K} % 6 = 0 THEN {_K} ELSE 0 END AS tmdb_id", f"CASE WHEN {_K} % 10 = 0 THEN {_K} % 100 ELSE 0 END AS tvdb_id", f"CASE {_K} % 5 WHEN 0 THEN 'tv' WHEN 1 THEN 'movie' ELSE '' END AS external_media_type",
    f"CASE WHEN {_K} % 2 = 0 THEN {_K} % 7000 ELSE 0 END AS runtime_seconds", f"CASE {_K} % 4 WHEN 0 THEN '1080p' WHEN 1 THEN '720p' ELSE '' END AS primary_resolution",
    f"CASE WHEN {_K} % 4 < 2 THEN 'h264' ELSE '' END AS primary_video_codec", f"CASE WHEN {_K} % 8 < 2 THEN 'aac' ELSE '' END AS primary_audio_codec", f"{_K} % 3 = 1 AS has_nfo",
    f"CASE WHEN {_K} % 17 = 0 THEN NULL ELSE {_K} % 4 = 2 END AS has_par2", f"{_K} % 59 = 1 AS passworded_known", f"{_K} % 31 = 1 AS passworded_unknown", f"{_K} % 61 = 2 AS passworded",
    f"CASE {_K} % 23 WHEN 1 THEN 'password_known' WHEN 2 THEN 'passworded' WHEN 3 THEN NULL WHEN 4 THEN 'odd' ELSE 'not_passworded' END AS password_state",
    f"CASE {_K} % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'tv' WHEN 2 THEN 'audio' ELSE 'misc' END AS classification", f"CASE {_K} % 3 WHEN 0 THEN 'excellent' ELSE 'good' END AS availability_tier",
    f"CASE {_K} % 5 WHEN 0 THEN 'premium' ELSE 'standard' END AS media_quality_tier", f"{_K} * 13 % 101 AS availability_score", f"{_K} * 17 % 101 AS media_quality_score", f"{_K} % 12 AS season", f"{_K} % 24 AS episode",
    f"CASE WHEN {_K} % 27 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST({_K} % 300 AS INT) END AS posted_day", f"DATE '2024-06-01' + CAST({_K} * 7 % 90 AS INT) AS updated_day", f"CASE WHEN {_K} % 3 = 0 THEN DATE '2024-07-01' END AS metadata_day",
]
_OVERRIDES = [
    f"{_K} AS release_id", f"CASE {_K} % 4 WHEN 0 THEN concat('Shown ', p_brand) WHEN 1 THEN '' ELSE NULL END AS o_title", f"{_K} % 24 = 8 AS o_hidden", f"CASE WHEN {_K} % 16 = 0 THEN 'movie' ELSE '' END AS o_classification",
    f"CASE WHEN {_K} % 16 = 4 THEN {_K} + 5 END AS o_tmdb_id", f"CASE WHEN {_K} % 12 = 0 THEN 50 ELSE 0 END AS o_tvdb_id", f"CASE {_K} % 32 WHEN 0 THEN 'TT123' WHEN 8 THEN '123' ELSE NULL END AS o_imdb_id",
]
_LISTED = [
    "l_partkey AS release_id", "l_linenumber AS file_index", "concat('f', CAST(l_orderkey AS STRING), CASE WHEN l_linenumber = 3 AND l_orderkey % 5 = 0 THEN '.SFV' ELSE '.rar' END) AS file_name",
    "CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes",
]
_ARCHIVES = [
    "o_orderkey % 2000 AS release_id", "CASE o_orderkey % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'purged' WHEN 2 THEN 'failed' ELSE 'pending' END AS archive_status", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'key' END AS object_key",
]
POLICIES = {
    "plain": Policy(0.55, 0, False, False, False, False, False), "default": Policy(), "identified": Policy(0.8, 50, True, False, False, False, False), "enriched": Policy(0.55, 0, False, False, True, False, False),
    "clear": Policy(0.55, 0, False, False, False, True, False), "inspected": Policy(0.55, 0, False, True, False, False, False), "payload": Policy(0.55, 0, False, False, False, False, True),
    "expected": Policy(0.55, 0, False, False, False, False, False, True), "par2": Policy(0.55, 0, False, False, False, False, False, False, True),
    "nfo": Policy(0.55, 0, False, False, False, False, False, False, False, True), "sfv": Policy(0.55, 0, False, False, False, False, False, False, False, False, True),
}
PAGES = {
    "all": ({}, "", 50, 0), "oldest": ({"has_nfo": True}, "posted_at_asc", 20, 5), "largest": ({"query": "a"}, "size_desc", 30, 0), "smallest": ({"least_size": 500, "most_size": 60_000}, "size_asc", 30, 0),
    "titles": ({"classification": "tv", "has_par2": False}, "title_asc", 25, 0), "available": ({"availability_tier": "good", "media_quality_tier": "standard"}, "availability_desc", 25, 0),
    "quality": ({"password": "not_passworded", "least_completion": 60, "metadata": "updated"}, "quality_desc", 40, 10), "browse": ({"category": "tv", "subcategory": "hd", "metadata": "missing"}, "", 0, -3),
    "misc": ({"category": "other"}, "", 40, 0), "dates": ({"posted_after": dt.datetime(2024, 2, 1), "posted_before": dt.datetime(2024, 5, 1)}, "", 40, 0), "imdb": ({"imdb_id": " tt123 "}, "", 50, 0),
    "tvdb": ({"tvdb_id": 50}, "", 50, 0), "episode": ({"season": 5, "episode": 5}, "", 50, 0), "blank": ({"query": "  ", "category": "nothing"}, "", 10, 40),
}


def releases(spark, sf_dir):
    r = table(spark, sf_dir, "part").selectExpr(*_RELEASES)
    at = lambda name, day: F.col(day).cast("timestamp_ntz").alias(name)
    r = r.select("*", at("posted_at", "posted_day"), at("updated_at", "updated_day"), at("metadata_updated_at", "metadata_day")).drop("posted_day", "updated_day", "metadata_day")
    listed = table(spark, sf_dir, "lineitem").selectExpr(*_LISTED)
    archives = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").selectExpr(*_ARCHIVES)
    found = policy.evidence(r, listed.where("file_index < 3"), archives, listed.where("file_index >= 3"))
    return policy.with_overrides(found, table(spark, sf_dir, "part").where("p_partkey % 4 <> 3").selectExpr(*_OVERRIDES)), listed


def visibility_policies(spark, sf_dir):
    """policy, release_id of the releases that each of eleven policies shows."""
    r, _ = releases(spark, sf_dir)
    names = F.array_compact(F.array(*[F.when(F.coalesce(policy.visible_if(p), F.lit(False)), name) for name, p in POLICIES.items()]))
    return r.select(F.explode(names).alias("policy"), "release_id")


def public_listing_pages(spark, sf_dir):
    """Pages of the listing under several filters and orders, each row with its place and the number of all that were found."""
    r = written(releases(spark, sf_dir)[0])  # read once for each page and its total
    out = []
    for name, (conditions, sort, limit, offset) in PAGES.items():
        rows, total = policy.page(r, POLICIES["plain"], policy.filters(**conditions), sort, limit, offset)
        out.append(rows.select(F.lit(name).alias("page"), "*").join(total, F.lit(True), "left"))
    return reduce(lambda a, b: a.unionByName(b), out).withColumn("posted_at", F.col("posted_at").cast("string"))


def public_release_detail(spark, sf_dir):
    """Two releases in full: one that is visible and one that is not."""
    r, listed = releases(spark, sf_dir)
    both = policy.detail(r, listed, 16, POLICIES["plain"]).unionByName(policy.detail(r, listed, 32, POLICIES["plain"]))
    files = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["file_index"].cast("string"), f["file_name"], f["size_bytes"].cast("string"))), ";")
    return both.select("release_id", "title", "classification", "password", "tmdb_id", "media", files.alias("files"), "file_bytes")


def browse_categories(spark, sf_dir):
    """Releases by browse category and subcategory."""
    r, _ = releases(spark, sf_dir)
    pairs = [("tv", ""), ("tv", "hd"), ("TV ", "All"), ("other", "misc"), ("movies", "hd"), ("tv", "none")]
    count = lambda c: F.count("*") if c is None else F.count_if(c)
    return r.agg(*[count(policy.browsed(*p)).alias(f"n{i}") for i, p in enumerate(pairs)])


ADMIN = {
    "public": {"public": "public"}, "internal": {"public": "internal_only,hidden"}, "some": {"classification": "tv, video", "identity": "identified,odd", "hidden": "visible"}, "password": {"password": "password_known,password_unknown"},
    "inspected": {"inspected": "no", "enriched": "yes"}, "mismatch": {"mismatch": "yes", "low_confidence": "no"}, "open": {"uncategorized": "yes", "completion": "below_100", "media": ""},
}


def admin_release_filters(spark, sf_dir):
    """Releases that each combination of admin filters finds: their number, the least and the greatest."""
    r = written(releases(spark, sf_dir)[0])
    known = policy.admin_predicates()
    found = [r.where(policy.all_of(policy.admin_filters(v, known))).agg(F.count("*").alias("n"), F.min("release_id").alias("first"), F.max("release_id").alias("last")).select(F.lit(k).alias("filter"), "*") for k, v in ADMIN.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


QUERIES = {f.__name__: f for f in (visibility_policies, public_listing_pages, public_release_detail, browse_categories, admin_release_filters)}

_R = f"""listed AS (SELECT {', '.join(_LISTED)} FROM lineitem),
archives AS (SELECT {', '.join(_ARCHIVES)} FROM orders WHERE o_orderkey % 7 = 0),
overrides AS (SELECT {', '.join(_OVERRIDES)} FROM part WHERE p_partkey % 4 <> 3),
base AS (SELECT {', '.join(_RELEASES)} FROM part),
r AS (
  SELECT b.*, o.* EXCLUDE (release_id), posted_day::TIMESTAMP AS posted_at, updated_day::TIMESTAMP AS updated_at, lower(trim(coalesce(nullif(o_title, ''), title, ''))) AS t, coalesce(nullif(o_title, ''), title) AS shown,
         CASE WHEN passworded_known OR coalesce(password_state, '') IN ('password_known', 'passworded_known') THEN 'password_known'
              WHEN passworded_unknown OR passworded OR coalesce(password_state, '') IN ('password_unknown', 'passworded_unknown', 'passworded') THEN 'password_unknown'
              WHEN password_state = 'not_passworded' THEN 'not_passworded' ELSE 'unknown' END AS pw,
         runtime_seconds > 0 OR primary_resolution <> '' OR primary_video_codec <> '' OR primary_audio_codec <> '' OR has_nfo OR coalesce(has_par2, false) AS seen,
         tmdb_id > 0 OR tvdb_id > 0 OR external_media_type <> '' OR matched_media_title <> '' AS known
  FROM base b LEFT JOIN overrides o ON o.release_id = b.release_id),
v AS (
  SELECT *, coalesce(identity_status, '') AS who,
    coalesce(search_title, '') <> ''
    AND (EXISTS (SELECT 1 FROM listed f WHERE f.release_id = r.release_id AND file_index < 3)
         OR EXISTS (SELECT 1 FROM archives a WHERE a.release_id = r.release_id AND archive_status IN ('archived', 'purged') AND object_key <> ''))
    AND t <> 'unknown-release' AND coalesce(identity_status, '') IN ('identified', 'probable') AND coalesce(size_bytes, 0) > 0 AND (coalesce(expected_files, 0) <= 1 OR file_count >= 2)
    AND NOT (regexp_matches(search_title, '(^|[^a-z0-9])(seed|test)([^a-z0-9]|$)') OR regexp_matches(lower(group_name), '(^|[._-])(seed|test)([._-]|$)'))
    AND NOT (coalesce(identity_status, '') = 'probable' AND coalesce(category_id, 8010) = 8010 AND (regexp_matches(t, '(^|\\s)(part|vol)\\d+([+._-]\\d+)?$') OR regexp_matches(t, '^[a-z0-9]{{12,}}(\\s+(part|vol)\\d+([+._-]\\d+)?)?$')))
    AND NOT (regexp_matches(t, '^[a-z0-9]{{16,}}(\\s+(part|vol)\\d+([+._-]\\d+)?)?$') AND deobfuscated_title = '' AND matched_media_title = '' AND original_media_title = '' AND tmdb_id <= 0 AND tvdb_id <= 0
             AND external_media_type = '' AND runtime_seconds <= 0 AND primary_resolution = '' AND primary_video_codec = '' AND primary_audio_codec = '' AND NOT has_nfo)
    AND pw IN ('not_passworded', 'password_known') AND NOT coalesce(o_hidden, false) AS fixed,
    t <> '' AND t NOT IN ('unknown-release', 'vip', 'vip only', 'private', 'private release', 'exclusive', 'unknown') AND NOT regexp_matches(t, '^[a-z0-9]{{12,}}(\\s+(part|vol)\\d+([+._-]\\d+)?)?$') AND title_source <> 'source_obfuscated' AS clear,
    CASE WHEN archive_count > 0 THEN coalesce(expected_archive_files, 0) > 0 ELSE false END AND greatest(file_count - par_file_count, 0) >= expected_archive_files
      OR archive_count = 0 AND (coalesce(expected_archive_files, 0) = 0 OR greatest(file_count - par_file_count, 0) >= expected_archive_files) AS whole,
    EXISTS (SELECT 1 FROM listed f WHERE f.release_id = r.release_id AND file_index >= 3 AND ends_with(lower(file_name), '.sfv')) AS sfv
  FROM r)"""
_PLAIN = "fixed AND match_confidence >= 0.55"
_PAGE = lambda name, where, order, limit, offset: f"""(SELECT '{name}' AS page, release_id, shown AS title, CAST(posted_at AS VARCHAR) AS posted_at, size_bytes, category_id, coalesce(nullif(o_classification, ''), classification) AS classification, pw AS password,
          CASE WHEN coalesce(o_tmdb_id, 0) > 0 THEN o_tmdb_id ELSE tmdb_id END AS tmdb_id, CASE WHEN coalesce(o_tvdb_id, 0) > 0 THEN o_tvdb_id ELSE tvdb_id END AS tvdb_id,
          coalesce(nullif(o_title, ''), nullif(original_media_title, ''), title) AS media_title, coalesce(o_imdb_id, '') AS imdb_id, count(*) OVER () AS total
        FROM v WHERE {_PLAIN} AND {where} ORDER BY {order}, release_id LIMIT {limit} OFFSET {offset})"""  # noqa: E731
_NEW = "v.posted_at DESC NULLS LAST, updated_at DESC NULLS FIRST, shown ASC NULLS LAST"
_THEN = "v.posted_at DESC NULLS LAST, shown ASC NULLS LAST"

ORACLE_SQL = {
    "visibility_policies": f"""WITH {_R}
        SELECT 'plain' AS policy, release_id FROM v WHERE {_PLAIN}
        UNION ALL SELECT 'default', release_id FROM v WHERE {_PLAIN} AND completion >= 100 AND seen AND clear AND whole
        UNION ALL SELECT 'identified', release_id FROM v WHERE fixed AND who = 'identified' AND match_confidence >= 0.8 AND completion >= 50
        UNION ALL SELECT 'enriched', release_id FROM v WHERE {_PLAIN} AND known
        UNION ALL SELECT 'clear', release_id FROM v WHERE {_PLAIN} AND clear
        UNION ALL SELECT 'inspected', release_id FROM v WHERE {_PLAIN} AND seen
        UNION ALL SELECT 'payload', release_id FROM v WHERE {_PLAIN} AND whole
        UNION ALL SELECT 'expected', release_id FROM v WHERE {_PLAIN} AND (coalesce(expected_files, 0) <= 0 OR file_count >= expected_files)
        UNION ALL SELECT 'par2', release_id FROM v WHERE {_PLAIN} AND has_par2
        UNION ALL SELECT 'nfo', release_id FROM v WHERE {_PLAIN} AND has_nfo
        UNION ALL SELECT 'sfv', release_id FROM v WHERE {_PLAIN} AND sfv""",
    "public_listing_pages": f"WITH {_R}\n" + "\nUNION ALL ".join([
        _PAGE("all", "true", _NEW, 50, 0), _PAGE("oldest", "has_nfo", "v.posted_at ASC NULLS LAST, updated_at DESC NULLS FIRST, shown ASC NULLS LAST", 20, 5), _PAGE("largest", "contains(search_title, 'a')", f"size_bytes DESC NULLS FIRST, {_THEN}", 30, 0),
        _PAGE("smallest", "size_bytes BETWEEN 500 AND 60000", f"size_bytes ASC NULLS LAST, {_THEN}", 30, 0), _PAGE("titles", "classification = 'tv' AND has_par2 = false", "shown ASC NULLS LAST, v.posted_at DESC NULLS LAST", 25, 0),
        _PAGE("available", "availability_tier = 'good' AND media_quality_tier = 'standard'", f"availability_score DESC NULLS FIRST, {_THEN}", 25, 0),
        _PAGE("quality", "pw = 'not_passworded' AND completion >= 60 AND metadata_day IS NOT NULL", f"media_quality_score DESC NULLS FIRST, {_THEN}", 40, 10), _PAGE("browse", "category_id = 5040 AND metadata_day IS NULL", _NEW, 50, 0),
        _PAGE("misc", "coalesce(category_id, 8010) = 8010", _NEW, 40, 0), _PAGE("dates", "v.posted_at BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-05-01'", _NEW, 40, 0), _PAGE("imdb", "lower(o_imdb_id) IN ('123', 'tt123')", _NEW, 50, 0),
        _PAGE("tvdb", "CASE WHEN o_tvdb_id > 0 THEN o_tvdb_id ELSE tvdb_id END = 50", _NEW, 50, 0), _PAGE("episode", "season = 5 AND episode = 5", _NEW, 50, 0), _PAGE("blank", "true", _NEW, 10, 40),
    ]),
    "public_release_detail": f"""WITH {_R},
        files AS (SELECT release_id, string_agg(concat_ws(':', file_index, file_name, size_bytes), ';' ORDER BY file_index, file_name, size_bytes) AS files, CAST(sum(size_bytes) AS BIGINT) AS file_bytes FROM listed WHERE release_id IN (16, 32) GROUP BY 1)
        SELECT v.release_id, shown AS title, coalesce(nullif(o_classification, ''), classification) AS classification, pw AS password, CASE WHEN o_tmdb_id > 0 THEN o_tmdb_id ELSE tmdb_id END AS tmdb_id,
               concat_ws(' / ', nullif(primary_resolution, ''), nullif(primary_video_codec, ''), nullif(primary_audio_codec, '')) AS media, files, file_bytes
        FROM v LEFT JOIN files f ON f.release_id = v.release_id WHERE v.release_id IN (16, 32) AND {_PLAIN}""",
    "browse_categories": f"""WITH base AS (SELECT {', '.join(_RELEASES)} FROM part)
        SELECT count(*) FILTER (category_id // 1000 = 5) AS n0, count(*) FILTER (category_id = 5040) AS n1, count(*) FILTER (category_id // 1000 = 5) AS n2, count(*) FILTER (category_id IS NULL OR category_id = 8010) AS n3,
               count(*) FILTER (category_id = 2040) AS n4, count(*) AS n5 FROM base""",
    "admin_release_filters": f"""WITH {_R},
        a AS (SELECT *, {_PLAIN} AND completion >= 100 AND seen AND clear AND whole AS public, coalesce(o_hidden, false) AS hidden,
                     matched_media_title <> '' AND tvdb_id = 0 AND (external_media_type = 'tv' OR external_media_type <> '' AND tmdb_id = 0) AS mismatch FROM v),
        hits AS (
          SELECT 'public' AS filter, release_id FROM a WHERE public UNION ALL SELECT 'internal', release_id FROM a WHERE NOT coalesce(public, false) OR hidden
          UNION ALL SELECT 'some', release_id FROM a WHERE classification IN ('tv', 'video') AND identity_status = 'identified' AND NOT hidden
          UNION ALL SELECT 'password', release_id FROM a WHERE pw IN ('password_known', 'password_unknown') UNION ALL SELECT 'inspected', release_id FROM a WHERE NOT seen AND known
          UNION ALL SELECT 'mismatch', release_id FROM a WHERE mismatch AND match_confidence >= 0.8 UNION ALL SELECT 'open', release_id FROM a WHERE category_id = 8010 AND completion < 100)
        SELECT filter, count(*) AS n, min(release_id) AS "first", max(release_id) AS "last" FROM hits GROUP BY 1""",
}
