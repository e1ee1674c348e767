"""Queries on matches by metadata and on pages of weak files."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.operators import evidence
from headerloom.plans.views import seen, seen_sql

_MINE = [
    "o_orderkey AS release_id", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 3 AS INT) END AS season", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 4 AS INT) END AS episode", "CASE WHEN o_orderkey % 4 > 0 THEN CAST(2018 + o_custkey % 4 AS INT) END AS year",
    "CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1080p' ELSE '720p' END AS resolution", "CASE WHEN o_custkey % 2 = 0 THEN 'x264' ELSE '' END AS video", "CASE WHEN o_custkey % 5 = 0 THEN 'aac' ELSE 'ac3' END AS audio", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS posted_at",
    "CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey % 2000 * 1000 END AS size", "o_custkey",
]
_ENTRY = [
    "o_custkey AS entry_key", "concat('t', CAST(o_orderkey AS STRING)) AS title", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 3 AS INT) END AS season", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 4 AS INT) END AS episode", "CAST(2017 + o_orderkey % 5 AS INT) AS year",
    "CASE o_orderkey % 3 WHEN 0 THEN '1080p' ELSE '720p' END AS resolution", "CASE WHEN o_orderkey % 3 = 0 THEN 'x264' ELSE 'xvid' END AS video", "'aac' AS audio", "o_orderdate AS posted_at", "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 2000 ELSE o_orderkey % 3 END AS size",
    "CASE WHEN o_orderkey % 5 < 2 THEN 'TV-HD' ELSE 'X264' END AS category",
]


def metadata_fallback(spark, sf_dir):
    """The three best entries of each release among those of its customer, by metadata."""
    a, b = seen(spark, sf_dir, "orders", _MINE).alias("a"), seen(spark, sf_dir, "orders", _ENTRY).alias("b")
    pairs = a.join(b, F.col("o_custkey") == F.col("entry_key"))
    return evidence.ranked_matches(evidence.fallback_scored(pairs, "a", "b"), 3).select("release_id", "rank", "title", "score", "applied")


def weak_files_page(spark, sf_dir):
    identities = seen(spark, sf_dir, "orders", ["o_orderkey AS binary_id", "CASE o_custkey % 3 WHEN 0 THEN 'weak' WHEN 1 THEN 'provisional' ELSE 'strong' END AS strength", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS updated_at"])
    stats = seen(spark, sf_dir, "lineitem", ["l_orderkey AS binary_id"]).groupBy("binary_id").agg(F.count("*").alias("parts"))
    return evidence.weak_page(identities, stats, seen(spark, sf_dir, "orders", ["o_orderkey AS binary_id"], "o_orderkey % 4 = 0"), 40, 20)


_TITLED = [
    "p_partkey AS release_id", "concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' S01E02 720p' WHEN 1 THEN '.1999.BluRay' WHEN 2 THEN ' xbox' WHEN 3 THEN ' flac' ELSE '' END) AS title", "CASE WHEN p_partkey % 11 = 3 THEN 'movie' END AS media_type", "CASE WHEN p_partkey % 2 = 0 THEN '1080p' ELSE '' END AS resolution",
    "CASE p_partkey % 3 WHEN 0 THEN 8010 WHEN 1 THEN 5040 END AS category_id",
]
_MATCHED = ["p_partkey AS release_id", "CASE p_partkey % 4 WHEN 0 THEN 'TV-X264' WHEN 1 THEN 'Movies-HD' ELSE 'GAMES' END AS category"]


def category_refresh(spark, sf_dir):
    return evidence.refreshed_categories(seen(spark, sf_dir, "part", _TITLED), seen(spark, sf_dir, "part", _MATCHED, "p_partkey % 5 > 0"))


QUERIES = {f.__name__: f for f in (metadata_fallback, weak_files_page, category_refresh)}

ORACLE_SQL = {
    "metadata_fallback": f"""WITH {seen_sql("a", "orders", _MINE)}, {seen_sql("b", "orders", _ENTRY)},
        j AS (
          SELECT release_id, b.title, abs(epoch(a.posted_at) - epoch(b.posted_at)) AS sec, a.season = b.season AND a.episode = b.episode AS hit, a.season IS NOT NULL AS tv, b.season IS NOT NULL AS named, category, abs(a.year - b.year) AS apart,
                 a.resolution <> '' AND a.resolution = b.resolution AS r, a.video <> '' AND a.video = b.video AS v, a.audio = b.audio AS au,
                 CASE WHEN a.size > 0 AND b.size > 0 THEN least(abs(a.size - b.size * 1024) / greatest(a.size, b.size * 1024)::DOUBLE, abs(a.size - b.size * 1048576) / greatest(a.size, b.size * 1048576)::DOUBLE) END AS off
          FROM a JOIN b ON o_custkey = entry_key),
        s AS (
          SELECT *, CASE WHEN tv AND named AND NOT hit THEN 0 ELSE round(greatest(0, least(1, CASE WHEN tv AND named THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN tv AND starts_with(category, 'TV') THEN 0.15 ELSE 0 END::DOUBLE
                   + CASE WHEN apart = 0 THEN 0.12 WHEN apart = 1 THEN 0.05 WHEN apart > 1 THEN -0.05 ELSE 0 END::DOUBLE + CASE WHEN r THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN v THEN 0.06 ELSE 0 END::DOUBLE + CASE WHEN au THEN 0.04 ELSE 0 END::DOUBLE
                   + CASE WHEN off <= 0.08 THEN 0.55 WHEN off <= 0.15 THEN 0.35 WHEN off <= 0.25 THEN 0.18 WHEN off > 0.5 THEN -0.1 ELSE 0 END::DOUBLE
                   + CASE WHEN sec IS NULL THEN 0 WHEN sec <= 86400 THEN 0.22 WHEN sec <= 259200 THEN 0.15 WHEN sec <= 864000 THEN 0.06 ELSE -0.08 END::DOUBLE)), 4) END::DOUBLE AS score FROM j),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY release_id ORDER BY score DESC, sec ASC NULLS LAST, title) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT release_id, rank, title, score, rank = 1 AND score >= 0.9 AND coalesce(sec <= 1800, false) AS applied FROM k WHERE rank <= 3""",
    "category_refresh": f"""WITH {seen_sql("r", "part", _TITLED)},
        k AS (
          SELECT *, release_id % 6 AS tail, CASE WHEN release_id % 5 > 0 THEN release_id % 4 END AS m FROM r),
        d AS (
          SELECT *, CASE WHEN tail = 2 THEN 'console' WHEN tail = 0 THEN 'tv' WHEN media_type = 'movie' THEN 'movie' WHEN m = 0 THEN 'tv' WHEN m = 1 THEN 'movie' WHEN tail = 1 THEN 'movie' WHEN tail = 3 THEN 'audio' ELSE 'misc' END AS kind FROM k),
        i AS (
          SELECT release_id, kind, category_id AS stored, CASE kind WHEN 'console' THEN 1040 WHEN 'audio' THEN 3040 WHEN 'misc' THEN 8010 WHEN 'tv' THEN CASE WHEN resolution = '1080p' THEN 5040 ELSE 5050 END
                   ELSE CASE WHEN resolution = '1080p' THEN 2040 WHEN tail = 1 THEN 2050 ELSE 2020 END END::INTEGER AS category_id FROM d)
        SELECT release_id, kind, category_id FROM i WHERE category_id IS DISTINCT FROM stored""",
    "weak_files_page": """
        WITH p AS (
          SELECT o_orderkey AS binary_id, CASE WHEN o_custkey % 3 = 0 THEN 'weak' ELSE 'provisional' END AS strength, CASE WHEN o_orderkey % 17 > 0 THEN o_orderdate END AS updated_at FROM orders
          WHERE o_custkey % 3 < 2 AND o_orderkey % 4 > 0 ORDER BY updated_at DESC NULLS LAST, binary_id LIMIT 40 OFFSET 20)
        SELECT p.*, (SELECT nullif(count(*), 0) FROM lineitem WHERE l_orderkey = binary_id) AS parts FROM p""",
}
