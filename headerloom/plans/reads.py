"""Queries on the catalog and on enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.operators import catalog, enrich
from headerloom.plans.views import RELEASES, releases
from headerloom.sources.tables import table


def catalog_search(spark, sf_dir):
    return catalog.search(releases(spark, sf_dir), "Ring", 100).select("release_id", "title", "posted_at")


def _listing(sort):
    def query(spark, sf_dir):
        return catalog.listing(releases(spark, sf_dir), sort, 50, 20).select("release_id", "title", "posted_at", F.coalesce("size_bytes", F.lit(-1).cast("long")).alias("size_bytes"), "completion", "quality")

    return query


def visibility_policy(spark, sf_dir):
    return catalog.visible(releases(spark, sf_dir), 0.3).select("release_id", "title", "completion")


def federated_merge(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    row = lambda df, source, k, n, b: df.select(F.lit(source).alias("source"), F.col(k).cast("string").alias("guid"), F.col(n).alias("title"), F.floor(F.abs(F.col(b))).cast("long").alias("size_bytes"))
    cached = row(s.where("s_suppkey % 2 = 0"), "a", "s_suppkey", "s_name", "s_acctbal")
    return catalog.federated_merge(cached, row(s, "a", "s_suppkey", "s_name", "s_acctbal").withColumn("title", F.upper("title")), row(c, "b", "c_custkey", "c_name", "c_acctbal"))


def release_newsgroups(spark, sf_dir):
    n, r, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), table(spark, sf_dir, "supplier")
    own = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("release_id"), F.col("n_name").alias("group_name"), "n_regionkey")
    cross = own.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("release_id", F.col("r_name").alias("group_name"))
    return catalog.newsgroups(own, cross)


def nzb_export(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    # A part that is stored twice is exported by its largest copy.
    rows = l.select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("part_number"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.col("l_partkey").alias("p"))
    best = rows.groupBy("release_id", "file", "part_number").agg(F.max(F.struct("bytes", "p")).alias("w"))
    return catalog.export_segments(best.select("release_id", F.concat(F.lit("f"), "file").alias("file_name"), "part_number", "w.bytes", F.concat(F.lit("m"), "w.p").alias("message_id")))


def payload_size_evidence(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    size = F.floor("l_extendedprice").cast("long")
    files = l.select(
        F.col("l_orderkey").alias("release_id"), F.when(F.col("l_linenumber") == 1, size).alias("par2_bytes"), F.when(F.col("l_linenumber") == 2, size + 1).alias("yenc_bytes"),
        F.when(F.col("l_linenumber") == 3, 0).otherwise(size + 2).alias("file_bytes"), (size + 3).alias("catalog_bytes"), (F.col("l_returnflag") == "N").alias("is_par"),
        (F.col("l_linenumber") == 7).alias("is_sidecar"), (F.col("l_linestatus") == "F").alias("is_archive"), (F.col("l_quantity") > 25).alias("is_split"),
    )
    return enrich.payload_size(files)


def predb_window_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    size = F.round("o_totalprice").alias("size_bytes")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("release_id"), F.col("o_orderdate").alias("posted_at"), size)
    b = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderdate").alias("posted_at"), size)
    return enrich.window_match(a, b)


def title_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("title")).distinct()
    p = p.select(F.col("title").alias("id"), "title")
    return enrich.similar_titles(p, p, 0.5)


def availability_tier(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    score = enrich.availability((F.col("o_orderkey") % 101).cast("double"), F.col("o_orderstatus") == "F", F.col("o_custkey") % 4, (F.col("o_orderkey") % 11) / 10.0)
    return o.select("o_orderkey", score.alias("score")).withColumn("tier", enrich.availability_tier(F.col("score")))


def media_quality_score(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    resolution = F.element_at(F.array(*map(F.lit, ["2160p", "1080p", "720p", "480p", "cam"])), (F.col("p_size") % 5 + 1).cast("int"))
    codec = F.element_at(F.array(*map(F.lit, ["x265", "x264", "xvid"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    title = F.concat_ws(".", "p_name", resolution, F.lit("BluRay"), codec)
    return p.select("p_partkey", title.alias("title"), enrich.media_quality(title).alias("quality"))


SORTS = list(catalog.SORTS)
QUERIES = {f.__name__: f for f in (catalog_search, visibility_policy, federated_merge, release_newsgroups, nzb_export, payload_size_evidence, predb_window_match, title_similarity, availability_tier, media_quality_score)}
QUERIES |= {f"public_listing_{s}": _listing(s) for s in SORTS}

_ORDERS = {"newest": "posted_at DESC", "oldest": "posted_at ASC", "largest": "r.size_bytes DESC", "smallest": "r.size_bytes ASC", "title": "title ASC", "completion": "completion DESC", "quality": "quality DESC"}
ORACLE_SQL = {
    f"public_listing_{s}": f"WITH {RELEASES} SELECT release_id, title, posted_at, coalesce(size_bytes, -1) AS size_bytes, completion, quality FROM releases r ORDER BY {o} NULLS LAST, release_id LIMIT 50 OFFSET 20" for s, o in _ORDERS.items()
} | {
    "catalog_search": f"WITH {RELEASES} SELECT release_id, title, posted_at FROM releases WHERE search_title ILIKE '%Ring%' ORDER BY posted_at DESC NULLS LAST, title, release_id LIMIT 100",
    "visibility_policy": f"""WITH {RELEASES}
        SELECT release_id, title, completion FROM releases
        WHERE length(trim(title)) >= 4 AND regexp_matches(lower(title), '[a-z]{{3,}}') AND NOT regexp_matches(lower(trim(title)), '^[a-z0-9]{{12,}}$')
          AND lower(trim(title)) NOT IN ('unknown', 'untitled', 'n/a') AND expected_archive_files > 0 AND greatest(file_count - par_file_count, 0) >= expected_archive_files
          AND size_bytes > 0 AND completion >= 0.3::DOUBLE AND NOT coalesce(passworded, false)""",
    "federated_merge": """
        WITH r AS (
          SELECT 'a' AS source, CAST(s_suppkey AS VARCHAR) AS guid, s_name AS title, CAST(floor(abs(s_acctbal)) AS BIGINT) AS size_bytes, 0 AS k FROM supplier WHERE s_suppkey % 2 = 0
          UNION ALL SELECT 'a', CAST(s_suppkey AS VARCHAR), upper(s_name), CAST(floor(abs(s_acctbal)) AS BIGINT), 1 FROM supplier
          UNION ALL SELECT 'b', CAST(c_custkey AS VARCHAR), c_name, CAST(floor(abs(c_acctbal)) AS BIGINT), 2 FROM customer)
        SELECT sha256(source || '-' || guid) AS release_id, arg_max(title, k) AS title, arg_max(size_bytes, k) AS size_bytes, bool_or(k = 0) AS cache_present, count(*) AS sources
        FROM r GROUP BY source, guid""",
    "release_newsgroups": """
        SELECT s_suppkey AS release_id, n_name AS group_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION SELECT s_suppkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "nzb_export": """
        WITH b AS (
          SELECT l_orderkey AS release_id, l_suppkey AS file, l_linenumber AS n, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_partkey AS p FROM lineitem
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber ORDER BY floor(l_extendedprice) DESC, l_partkey DESC) = 1)
        SELECT release_id, 'f' || file AS file_name, count(*) AS segment_count, CAST(sum(bytes) AS BIGINT) AS file_bytes,
               string_agg(concat(bytes, ':', n, ':m', p), chr(10) ORDER BY n) AS segments
        FROM b GROUP BY release_id, file""",
    "payload_size_evidence": """
        WITH f AS (
          SELECT l_orderkey AS release_id, CAST(floor(l_extendedprice) AS BIGINT) AS s, l_linenumber AS n, l_linestatus = 'F' AS a, l_quantity > 25 AS sp
          FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber <> 7),
        g AS (SELECT *, CASE n WHEN 1 THEN s WHEN 2 THEN s + 1 WHEN 3 THEN s + 3 ELSE s + 2 END AS size, CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS label FROM f)
        SELECT release_id, CAST(CASE WHEN count(*) FILTER (a) >= 2 AND count(*) FILTER (sp) >= 1 THEN sum(size) ELSE max(size) END AS BIGINT) AS payload_bytes, CAST(min(label) AS INTEGER) AS best_evidence
        FROM g GROUP BY release_id""",
    "predb_window_match": """
        WITH a AS (SELECT o_orderkey AS release_id, o_orderdate AS d, round(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F'),
        b AS (SELECT o_orderkey AS entry_id, o_orderdate AS d, round(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'O'),
        m AS (
          SELECT release_id, entry_id, abs(b.s - a.s) / greatest(a.s, b.s, 1.0) AS ratio, abs(epoch(b.d - a.d)) / 3600 AS hours
          FROM a JOIN b ON b.d >= a.d - INTERVAL 10 DAY AND b.d <= a.d + INTERVAL 3 DAY),
        s AS (
          SELECT release_id, entry_id, round(CASE WHEN ratio <= 0.08 THEN 0.55 WHEN ratio <= 0.15 THEN 0.35 WHEN ratio <= 0.25 THEN 0.18 WHEN ratio > 0.5 THEN -0.10 ELSE 0 END::DOUBLE
                 + CASE WHEN hours <= 24 THEN 0.22 WHEN hours <= 72 THEN 0.15 WHEN hours <= 240 THEN 0.06 ELSE -0.08 END::DOUBLE, 2) AS score FROM m)
        SELECT release_id, entry_id, score, count(*) OVER (PARTITION BY release_id) AS candidates FROM s
        QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY score DESC, entry_id) = 1""",
    "title_similarity": """
        WITH p AS (SELECT DISTINCT lower(p_name) AS t FROM part),
        w AS (SELECT t, string_split(t, ' ') AS s FROM p),
        j AS (
          SELECT a.t AS id, b.t AS other_id,
                 round(CASE WHEN a.t = b.t THEN 1.0 ELSE len(list_intersect(list_distinct(a.s), list_distinct(b.s)))::DOUBLE / greatest(len(a.s), len(b.s)) END::DOUBLE, 4) AS similarity
          FROM w a, w b)
        SELECT * FROM j WHERE similarity >= 0.5::DOUBLE""",
    "availability_tier": """
        WITH s AS (
          SELECT o_orderkey, round(0.72::DOUBLE * (o_orderkey % 101) + CASE WHEN o_orderstatus = 'F' THEN 12 ELSE 0 END + CASE WHEN o_custkey % 4 >= 2 THEN 8 ELSE 0 END
                                   + 8 * ((o_orderkey % 11)::DOUBLE / 10.0::DOUBLE), 4) AS score FROM orders)
        SELECT *, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'partial' ELSE 'low' END AS tier FROM s""",
    "media_quality_score": """
        WITH t AS (
          SELECT p_partkey, p_size % 5 AS r, p_partkey % 3 AS c,
                 concat_ws('.', p_name, ['2160p', '1080p', '720p', '480p', 'cam'][p_size % 5 + 1], 'BluRay', ['x265', 'x264', 'xvid'][CAST(p_partkey % 3 + 1 AS INTEGER)]) AS title FROM part)
        SELECT p_partkey, title, CAST(25 + 20 + CASE r WHEN 0 THEN 35 WHEN 1 THEN 28 WHEN 2 THEN 20 WHEN 3 THEN 10 ELSE 0 END + CASE c WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 2 END AS INTEGER) AS quality FROM t""",
}
