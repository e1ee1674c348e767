"""Queries on release scores, title scores, tags and yEnc headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.functions import titles
from headerloom.operators import scoring
from headerloom.sources.tables import table

TAILS = ["", "S01E02 720p x264", "S01E03 1080p", "2019 1080p x265 dts", "2020 ac3", "2x05 xvid", "2018 mkv", "x265 part02 rar"]


def _titled(spark, sf_dir):
    tails = F.array(*[F.lit(t) for t in TAILS])
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    title = lambda n: F.concat_ws(".", F.translate("p_name", " ", "."), F.translate(F.element_at(tails, (n % len(TAILS) + 1).cast("int")), " ", "."))
    mine = p.select(k.alias("id"), title(k).alias("title"))
    return mine.join(p.select(F.when(k % 3 == 0, k).otherwise(k - 1).alias("id"), title(k * 5 + 1).alias("other")), "id")


def release_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    files = o.select(
        F.col("o_custkey").alias("release_id"), F.col("o_orderpriority").alias("poster"), F.col("o_orderdate").alias("posted_at"), ((k % 11) / 10.0).alias("confidence"), (k % 9).alias("observed_parts"),
        F.lit(8).cast("long").alias("total_parts"), (F.col("o_custkey") % 12).alias("expected_files"), F.when(k % 5 == 0, "archive").when(k % 7 == 0, "video").when(k % 11 == 0, "audio").when(k % 3 == 0, "par").otherwise("other").alias("kind"),
    )
    return scoring.release_scores(files)


def identity_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    source = F.when(k % 4 == 0, "source").when(k % 4 == 1, "predb")
    return o.select(k.alias("release_id"), scoring.identity_status(k % 101, source, (k % 11) / 10.0, k % 3 == 0).alias("status"), scoring.media_quality_tier(k % 101).alias("tier"))


def media_tags(spark, sf_dir):
    return _titled(spark, sf_dir).groupBy(*[c.alias(n) for n, c in titles.tags(F.col("title")).items()]).agg(F.count("*").alias("n"))


def scene_title_score(spark, sf_dir):
    return _titled(spark, sf_dir).select("id", "title", "other", titles.scene_title_score(F.col("title"), F.col("other"), F.when(F.col("id") % 5 > 0, F.col("id") * 40)).alias("score"))


def external_title_match(spark, sf_dir):
    k = F.col("id")
    year = titles.tags(F.col("title"))["year"]
    score = titles.external_title_score(F.col("title"), [F.col("other"), F.concat_ws(" ", F.reverse("other"), F.lit("the film"))], year, F.when(k % 4 > 0, 2018 + k % 3), k % 2 == 0, F.when(k % 7 > 0, k % 5 == 0))
    return _titled(spark, sf_dir).select("id", "other", score.alias("score"))


def yenc_headers(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_partkey")
    head = F.format_string("=ybegin part=%d total=7 line=128 size=%d name=file %d size=9.rar\r\n", n.cast("long"), q * 1000, q)
    part = F.when(n < 7, F.format_string("=ypart begin=%d end=%d\r\n", n * q + 1, n * q + 500)).otherwise("")
    body = F.when(n == 3, "no header").otherwise(F.concat(F.lit("x: y\r\n\r\n"), head, part, F.lit("data")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(name) for name, c in titles.yenc_header(body).items()])


QUERIES = {f.__name__: f for f in (release_scores, identity_status, media_tags, scene_title_score, external_title_match, yenc_headers)}

_PAIRS = f"""tails AS (SELECT {[t for t in TAILS]} AS t),
titled AS (SELECT p_partkey AS k, p_name, t FROM part, tails),
pairs AS (
  SELECT a.k AS id, replace(concat_ws('.', a.p_name, a.t[a.k % 8 + 1]), ' ', '.') AS title, replace(concat_ws('.', b.p_name, b.t[(b.k * 5 + 1) % 8 + 1]), ' ', '.') AS other
  FROM titled a JOIN titled b ON a.k = CASE WHEN b.k % 3 = 0 THEN b.k ELSE b.k - 1 END),
keyed AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(other), '[^a-z0-9]+', ' ', 'g')) AS b FROM pairs)"""
_TAG = lambda c, p: f"nullif(regexp_extract(' ' || {c} || ' ', '{p}', 1), '')"
_YEAR, _RES, _VIDEO, _AUDIO = " (19[5-9]\\d|20\\d\\d) ", " (2160p|1080p|720p|576p|480p) ", " (x265|hevc|av1|x264|h264|xvid) ", " (truehd|dts|eac3|ac3|aac|flac|mp3) "
_SEASON = lambda c: f"CAST(coalesce({_TAG(c, ' s(\\d+)e\\d+ ')}, {_TAG(c, ' (\\d+)x\\d+ ')}) AS INTEGER)"
_EPISODE = lambda c: f"CAST(coalesce({_TAG(c, ' s\\d+e(\\d+) ')}, {_TAG(c, ' \\d+x(\\d+) ')}) AS INTEGER)"
_SIM = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 ELSE len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' '))))::DOUBLE / greatest(len(string_split({a}, ' ')), len(string_split({b}, ' '))) END::DOUBLE"
_PRE = lambda a, b: f"(starts_with({a}, {b}) OR starts_with({b}, {a}))"
_BARE = lambda c: f"trim(regexp_replace({c}, '(?: (?:part\\d+|rar|mkv))+$', ''))"

ORACLE_SQL = {
    "release_scores": """
        WITH f AS (
          SELECT o_custkey AS r, o_orderpriority AS poster, o_orderdate AS d, o_orderkey % 11 AS c, o_orderkey % 9 AS obs, o_custkey % 12 AS expected,
                 CASE WHEN o_orderkey % 5 = 0 THEN 'archive' WHEN o_orderkey % 7 = 0 THEN 'video' WHEN o_orderkey % 11 = 0 THEN 'audio' WHEN o_orderkey % 3 = 0 THEN 'par' ELSE 'other' END AS kind FROM orders),
        p AS (SELECT r, poster, count(*) AS n, row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, poster) AS place FROM f GROUP BY r, poster),
        g AS (
          SELECT f.r, count(*) AS n, any_value(p.poster) AS poster, any_value(p.n) AS pn, epoch(max(d) - min(d)) / 3600 AS hours, sum(c)::DOUBLE / 10 / count(*) AS avg,
                 least(100.0::DOUBLE, 100.0::DOUBLE * sum(obs) / (8 * count(*)), CASE WHEN max(expected) > 0 THEN 100.0::DOUBLE * count(*) / max(expected) ELSE 100 END) AS completion,
                 bool_or(kind = 'archive') AS ar, bool_or(kind = 'video') AS vi, bool_or(kind = 'audio') AS au, bool_or(kind = 'par') AS pa
          FROM f JOIN p ON f.r = p.r AND p.place = 1 GROUP BY f.r),
        s AS (
          SELECT *, 0.2::DOUBLE + 0.3::DOUBLE * avg + CASE WHEN n > 1 AND pn >= 0.75 * n THEN 0.14 ELSE 0 END::DOUBLE + CASE WHEN n = 1 OR hours > 24 THEN 0 WHEN hours <= 2 THEN 0.14 WHEN hours <= 12 THEN 0.09 ELSE 0.04 END::DOUBLE
                 + CASE WHEN pa THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN ar AND (vi OR au) THEN 0.06 ELSE 0 END::DOUBLE + CASE WHEN completion >= 95 THEN 0.06 WHEN completion >= 75 THEN 0.04 WHEN completion >= 50 THEN 0.02 ELSE 0 END::DOUBLE AS cluster FROM g)
        SELECT r AS release_id, n AS file_count, poster AS dominant_poster, round(pn::DOUBLE / n, 4) AS poster_ratio, round(hours::DOUBLE, 4) AS span_hours, round(completion, 4) AS completion,
               round(least(100, 0.72::DOUBLE * completion + CASE WHEN pa THEN 12 ELSE 0 END + CASE WHEN n >= 2 THEN 8 ELSE 0 END + 8 * avg), 4) AS availability, round(60 * least(1, cluster) + 40 * avg, 4) AS identity,
               CASE WHEN vi AND ar THEN 'video_archive' WHEN vi THEN 'video' WHEN au THEN 'audio' WHEN ar THEN 'archive' WHEN pa THEN 'repair_set' ELSE 'misc' END AS classification
        FROM s""",
    "identity_status": """
        SELECT k AS release_id, CASE WHEN k % 4 = 1 AND k % 11 >= 9 THEN 'identified' WHEN k % 4 = 1 AND k % 11 >= 7 THEN 'probable' WHEN k % 3 = 0 AND k % 101 >= 75 THEN 'identified' WHEN k % 101 >= 55 THEN 'probable' ELSE 'unknown' END AS status,
               CASE WHEN k % 101 >= 85 THEN 'premium' WHEN k % 101 >= 65 THEN 'good' WHEN k % 101 >= 45 THEN 'standard' ELSE 'unknown' END AS tier
        FROM (SELECT o_orderkey AS k FROM orders)""",
    "media_tags": f"""WITH {_PAIRS}
        SELECT {_TAG("a", _RES)} AS resolution, {_TAG("a", _VIDEO)} AS video_codec, {_TAG("a", _AUDIO)} AS audio_codec, CAST({_TAG("a", _YEAR)} AS INTEGER) AS year, {_SEASON("a")} AS season, {_EPISODE("a")} AS episode, count(*) AS n
        FROM keyed GROUP BY ALL""",
    "scene_title_score": f"""WITH {_PAIRS},
        t AS (SELECT *, {_BARE("a")} AS ca, {_BARE("b")} AS cb, CASE WHEN id % 5 > 0 THEN id * 40 END AS hours, CAST({_TAG("a", _YEAR)} AS INTEGER) AS ya, CAST({_TAG("b", _YEAR)} AS INTEGER) AS yb, {_SEASON("a")} AS sa, {_SEASON("b")} AS sb, {_EPISODE("a")} AS ea, {_EPISODE("b")} AS eb FROM keyed)
        SELECT id, title, other, round(greatest(0, least(1, 0.25::DOUBLE + 0.45::DOUBLE * ({_SIM("a", "b")}) + CASE WHEN {_PRE("a", "b")} THEN 0.22 ELSE 0 END::DOUBLE + 0.20::DOUBLE * ({_SIM("ca", "cb")}) + CASE WHEN {_PRE("ca", "cb")} THEN 0.12 ELSE 0 END::DOUBLE
                 + CASE WHEN sa = sb AND ea = eb THEN 0.18 WHEN sa IS NOT NULL AND sb IS NOT NULL THEN -0.10 ELSE 0 END::DOUBLE
                 + CASE WHEN ya = yb THEN 0.10 WHEN abs(ya - yb) = 1 THEN 0.04 WHEN ya <> yb THEN -0.04 ELSE 0 END::DOUBLE
                 + CASE WHEN {_TAG("a", _RES)} = {_TAG("b", _RES)} THEN 0.04 ELSE 0 END::DOUBLE + CASE WHEN {_TAG("a", _VIDEO)} = {_TAG("b", _VIDEO)} THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN {_TAG("a", _AUDIO)} = {_TAG("b", _AUDIO)} THEN 0.02 ELSE 0 END::DOUBLE
                 + CASE WHEN hours <= 72 THEN 0.08 WHEN hours <= 720 THEN 0.04 WHEN hours > 8760 THEN -0.08 ELSE 0 END::DOUBLE)), 4) AS score
        FROM t""",
    "external_title_match": f"""WITH {_PAIRS},
        t AS (SELECT *, trim(regexp_replace(lower(concat(reverse(other), ' the film')), '[^a-z0-9]+', ' ', 'g')) AS c, CAST({_TAG("a", _YEAR)} AS INTEGER) AS y, CASE WHEN id % 4 > 0 THEN 2018 + id % 3 END AS ey, CASE WHEN id % 7 > 0 THEN id % 5 = 0 END AS tv FROM keyed)
        SELECT id, other, round(greatest(0, least(1, 0.35::DOUBLE + 0.55::DOUBLE * greatest({_SIM("a", "b")}, {_SIM("a", "c")}) + CASE WHEN a = b OR a = c THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN y = ey THEN 0.10 WHEN abs(y - ey) = 1 THEN 0.04 WHEN y <> ey THEN -0.06 ELSE 0 END::DOUBLE
                 + CASE WHEN id % 2 = 0 AND tv THEN 0.08 WHEN (id % 2 = 0) <> tv THEN -0.10 ELSE 0 END::DOUBLE)), 4) AS score
        FROM t""",
    "yenc_headers": """
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS INTEGER) END AS part_number, CASE WHEN l_linenumber <> 3 THEN 7::INTEGER END AS total_parts,
               CASE WHEN l_linenumber <> 3 THEN l_partkey * 1000 END AS file_size, CASE WHEN l_linenumber <> 3 THEN concat('file ', l_partkey, ' size=9.rar') END AS file_name,
               CASE WHEN l_linenumber NOT IN (3, 7) THEN l_linenumber * l_partkey END AS part_offset, CASE WHEN l_linenumber NOT IN (3, 7) THEN l_linenumber * l_partkey + 500 END AS part_end
        FROM lineitem""",
}
