"""Queries on documents, on what files are, and on inspection and recovery."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from headerloom.functions import probes
from headerloom.operators import inspection
from headerloom.plans.views import seen, seen_sql
from headerloom.sources import documents

NOW = dt.datetime(2024, 1, 25)

_SEGMENTS = [
    "l_orderkey % 900 AS release_id", "CASE WHEN l_orderkey % 2 = 0 THEN 'alt.b' ELSE concat('alt.', l_returnflag) END AS group_name", "concat('\"f', CAST(l_suppkey % 3 AS STRING), '\" <&> yEnc') AS file_subject", "concat('p', CAST(l_partkey % 4 AS STRING), '@x') AS poster",
    "l_partkey * 100 AS posted_epoch", "l_linenumber AS part_number", "CAST(floor(l_extendedprice) AS BIGINT) AS bytes", "CASE WHEN l_partkey % 31 = 0 THEN ' ' ELSE concat('<', CAST(l_partkey AS STRING), '.', CAST(l_orderkey AS STRING), '@h>') END AS message_id",
]
_FILES = [
    "l_orderkey AS release_id", "l_partkey * 10 + l_linenumber AS file_id", "l_returnflag <> 'R' AS is_complete", "l_shipdate AS posted_at",
    "concat('set', CAST(l_suppkey % 2 AS STRING), CASE l_partkey % 13 WHEN 0 THEN '.par2' WHEN 1 THEN '.vol00+01.PAR2' WHEN 2 THEN '.part01.rar' WHEN 3 THEN '.part02.rar' WHEN 4 THEN '.rar' WHEN 5 THEN '.r00' WHEN 6 THEN '.7z.001' WHEN 7 THEN '.7z.002' WHEN 8 THEN '.MKV' WHEN 9 THEN '.sample.mkv' WHEN 10 THEN '.nfo' WHEN 11 THEN '.tar.gz' ELSE '.bin' END) AS file_name",
]
_RESULTS = [
    "p_partkey * 10 + 1 + p_partkey % 5 AS file_id", "CASE p_partkey % 4 WHEN 0 THEN 'par2' WHEN 1 THEN 'archive' WHEN 2 THEN 'media' ELSE 'nfo' END AS stage", "CASE WHEN p_partkey % 3 = 0 THEN 'done' ELSE 'failed' END AS status",
    "CASE p_partkey % 5 WHEN 0 THEN '{\"error\": {\"retryable\": true}}' WHEN 1 THEN '{\"error\": {\"retryable\": false}}' WHEN 2 THEN NULL WHEN 3 THEN '{}' ELSE '{\"error\": {\"retryable\": true, \"n\": 1}}' END AS details", "p_partkey % 60 AS age",
]
_CAPS = ["o_orderkey AS release_id", "CAST(o_custkey % 120 AS DOUBLE) AS completion", "CAST(o_orderkey % 110 AS DOUBLE) AS availability", "o_orderkey % 5 = 0 AS password_unknown", "o_orderkey % 3 = 0 AS password_known"]
_WORK = [
    "o_orderkey AS binary_id", "o_custkey % 3 AS group_id", "o_orderkey % 3 AS priority", "o_custkey AS article_number", "CASE o_custkey % 4 WHEN 0 THEN 'Me@Host.NET' WHEN 1 THEN 'plain' WHEN 2 THEN NULL ELSE 'x@b c.org' END AS poster",
    "CASE o_orderkey % 5 WHEN 0 THEN '<a@news.x>' WHEN 1 THEN 'nothing' ELSE '<b@other>' END AS message_id", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS posted_at", "o_orderdate AS updated_at",
]
_RECOVERED = [
    "o_orderkey AS binary_id", "o_custkey % 4 AS group_id", "CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN concat('Film', CAST(o_custkey % 90 AS STRING), '.RAR') ELSE concat('film', CAST(o_custkey % 90 AS STRING), '.rar ') END AS file_name", "CAST(o_custkey % 3 * 3 AS INT) AS total_parts", "o_custkey % 5 AS file_size",
]
_ADMIT = [
    "o_orderkey AS binary_id", "o_orderkey % 4 = 0 AS name_known", "o_custkey % 2 = 0 AS is_opaque", "o_orderkey % 3 AS total_parts", "o_custkey % 7 AS observed_parts", "o_custkey % 40 AS cohort_size", "o_orderkey % 100 AS age_hours",
]


def nzb_documents(spark, sf_dir):
    """One NZB document a release: its length and its text without the prologue's first part."""
    titles = seen(spark, sf_dir, "orders", ["o_orderkey AS release_id", "concat(o_orderpriority, ' & more') AS title"], "o_orderkey < 900 and o_orderkey % 2 = 1")
    return documents.nzb_documents(seen(spark, sf_dir, "lineitem", _SEGMENTS), titles).select("release_id", F.substring_index("nzb", "/nzb\">", -1).alias("body"))


def nzb_segments(spark, sf_dir):
    """The segments of NZB documents that were made of lines, read back, by file."""
    found = documents.nzb_segments(documents.nzb_documents(seen(spark, sf_dir, "lineitem", _SEGMENTS)))
    return found.groupBy("release_id", "subject", "poster", "posted_epoch").agg(F.count("*").alias("segments"), F.sum("bytes").alias("bytes"), F.min("message_id").alias("first"), F.max(F.array_join("groups", ",")).alias("groups"))


def feed_releases(spark, sf_dir):
    """Items of result feeds, one feed a brand."""
    item = F.concat(
        F.lit("<item><title> "), F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("</title>"), F.when(F.col("p_partkey") % 3 == 0, "<guid></guid>").otherwise(F.concat(F.lit("<guid>g"), F.col("p_partkey").cast("string"), F.lit("</guid>"))), F.lit("<link>http://x/"), F.col("p_partkey").cast("string"),
        F.lit("</link>"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("<size>"), F.col("p_size").cast("string"), F.lit("</size>"))).otherwise(""), F.lit("<category>a</category><category>b</category>"),
        F.when(F.col("p_partkey") % 5 > 1, F.concat(F.lit('<newznab:attr name="category" value="5040"/><newznab:attr name="size" value="'), (F.col("p_size") * 7).cast("string"), F.lit('"/>'))).otherwise(""), F.lit('<enclosure url="http://n/'), F.col("p_partkey").cast("string"), F.lit('" length="'), (F.col("p_size") * 11).cast("string"), F.lit('"/></item>'),
    )
    rows = seen(spark, sf_dir, "part", ["*"]).withColumn("item", item)
    feeds = rows.groupBy("p_brand", (F.col("p_partkey") % 50).alias("page")).agg(F.concat(F.lit('<rss version="2.0" xmlns:newznab="http://www.newznab.com/DTD/2010/feeds/attributes/"><channel><title>t</title>'), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("feed"))
    return documents.feed_releases(feeds.drop("page")).select(F.col("p_brand").alias("brand"), "guid", "title", "link", "size", "category")


def scene_pages(spark, sf_dir):
    """Rows of JSON pages of scene names, some of which failed."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("name"), F.lit("T").alias("team"), F.col("o_orderstatus").alias("cat"), (F.col("o_orderkey") * 1000).alias("preAt"), (F.col("o_custkey") / 2).alias("size"))
    pages = seen(spark, sf_dir, "orders", ["*"]).groupBy((F.col("o_orderkey") % 40).alias("page_no")).agg(F.to_json(F.struct(F.when(F.col("page_no") % 9 == 0, "error").otherwise("success").alias("status"), F.struct(F.count("*").alias("rowCount"), F.collect_list(row).alias("rows")).alias("data"))).alias("page"))
    return documents.scene_pages(pages).select("page_no", "id", "name", "team", "category", "posted_at", "kilobytes")


_HEADS = ["89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "524946460000000057454250", "5041523200504B54", "377ABCAF271C0004", "526172211A07", "504B0304", "1A45DFA3", "000000186674797069736F6D", "524946460000000041564920", "664C6143", "494433", "FFFB90", "48656C6C6F0A", "00010203", ""]
_EXT = ["bin", "MKV", "nfo", "mp4", "xyz"]


def file_signatures(spark, sf_dir):
    """Files by what their first bytes and names say."""
    heads, ext = F.array(*[F.lit(h) for h in _HEADS]), F.array(*[F.lit(e) for e in _EXT])
    k = F.col("p_partkey")
    rows = seen(spark, sf_dir, "part", ["*"]).select(F.unhex(F.element_at(heads, (k % len(_HEADS) + 1).cast("int"))).alias("data"), F.concat(F.lit("f."), F.element_at(ext, (F.floor(k / len(_HEADS)) % len(_EXT) + 1).cast("int"))).alias("name"))
    rows = rows.withColumn("kind", probes.signature(F.col("data"), F.col("name")))
    return rows.groupBy("kind", probes.media_type(F.col("kind")).alias("media_type")).agg(F.count("*").alias("n"))


def archive_families(spark, sf_dir):
    rows = seen(spark, sf_dir, "lineitem", _FILES).where(probes.is_archive(F.col("file_name")))
    return rows.groupBy("release_id", probes.family_key(F.col("file_name")).alias("family")).agg(F.count("*").alias("files"), F.count_if(probes.is_representative(F.col("file_name"))).alias("representatives"))


def password_hints(spark, sf_dir):
    text = F.concat(F.lit("Release notes. PASSWORD: "), F.lower("p_brand"), F.lit(" pw-"), F.col("p_partkey").cast("string"), F.lit("xyz pass "), F.lower("p_brand"), F.lit(" pw ab"))
    return seen(spark, sf_dir, "part", ["*"]).select("p_partkey", F.array_join(probes.password_hints(text), "|").alias("hints"))


def media_entries(spark, sf_dir):
    """The best entry of archives' listings."""
    k = F.col("p_partkey")
    entries = F.array_compact(F.array(F.lit(" "), F.when(k % 2 == 0, "readme.txt"), F.when(k % 3 == 0, "sample/a.mkv"), F.when(k % 5 == 0, "film.MKV"), F.when(k % 7 == 0, "song.mp3"), F.when(k % 4 == 1, "sample.txt")))
    return seen(spark, sf_dir, "part", ["*"]).select("p_partkey", probes.best_entry(entries).alias("entry"))


def probe_streams(spark, sf_dir):
    """Streams in the output of probes, with text around the JSON, and languages from their tags."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("warning: x\n{\"format\": {\"duration\": \""), k, F.lit(".5\", \"size\": \"9\"}, \"streams\": [{\"codec_type\": \"video\", \"codec_name\": \"h264\", \"width\": "), F.col("p_size").cast("string"),
        F.lit(", \"height\": 2}, {\"codec_type\": \"audio\", \"codec_name\": \"aac\", \"tags\": {\"language\": \"l"), (F.col("p_partkey") % 3).cast("string"), F.lit("\"}}]} tail"))
    text = F.when(F.col("p_partkey") % 11 == 0, "no json").otherwise(text)
    rows = seen(spark, sf_dir, "part", ["*"]).select("p_partkey", probes.probe(text).alias("p"))
    streams = lambda kind: F.filter("p.streams", lambda s: s["codec_type"] == kind)
    language = F.element_at(F.get(streams("audio"), F.lit(0))["tags"], "language")
    return rows.select("p_partkey", F.col("p.format.duration").cast("double").alias("seconds"), F.get(streams("video"), F.lit(0))["width"].alias("width"), language.alias("language"), F.size("p.streams").alias("streams"))


def _le(value, n: int):
    """A whole number as n bytes in hexadecimal, least first."""
    whole = F.lpad(F.hex(value), 2 * n, "0")
    return F.concat(*[F.substring(whole, 2 * i + 1, 2) for i in reversed(range(n))])


def repair_targets(spark, sf_dir):
    """Files that the packets of repair files describe; each repair file holds two of one name, noise and a packet cut short."""
    k, name = F.col("p_partkey"), F.hex(F.concat(F.col("p_name"), F.lit(".rar")))
    padded = lambda h: F.rpad(h, 160, "0")
    packet = lambda h, size: F.concat(F.lit("5041523200504B54"), _le(F.lit(64 + 56 + 80).cast("long"), 8), F.lit("00" * 32), F.lit("50415220322E300046696C6544657363"), F.lit("00" * 48), _le(size, 8), padded(h))
    data = F.concat(F.lit("AABB"), packet(name, k * 1000), F.lit("CC"), packet(name, k), packet(F.hex(F.lit("bad*name")), k), packet(F.hex(F.lit("zero.bin")), F.lit(0).cast("long")), packet(F.hex(F.lit("other.7z")), k + 7), F.lit("5041523200504B54"), _le(F.lit(9999).cast("long"), 8), F.lit("00" * 60))
    return probes.repair_targets(seen(spark, sf_dir, "part", ["*"]).select(k.alias("file_id"), F.unhex(data).alias("data")))


def seven_zip_headers(spark, sf_dir):
    k = F.col("p_partkey")
    head = F.concat(F.when(k % 5 == 0, "000000000000").otherwise("377ABCAF271C"), F.lit("000400000000"), _le(k * 4096, 8), _le(k % 7 * 10, 8), _le(k + 1, 4))
    found = probes.seven_zip_header(F.unhex(head))
    return seen(spark, sf_dir, "part", ["*"]).select("p_partkey", *[c.alias(n) for n, c in found.items()])


def _results(spark, sf_dir):
    rows = seen(spark, sf_dir, "part", _RESULTS)
    return rows.withColumn("at", F.timestamp_add("HOUR", -F.col("age").cast("int"), F.lit(NOW).cast("timestamp_ntz")))


def inspection_candidates(spark, sf_dir):
    """The newest archives that wait for inspection."""
    return inspection.candidates(seen(spark, sf_dir, "lineitem", _FILES), _results(spark, sf_dir), "archive", NOW, 6, 300)


def inspection_backlog(spark, sf_dir):
    return inspection.backlog(seen(spark, sf_dir, "lineitem", _FILES), _results(spark, sf_dir), ["par2", "archive", "media", "nfo"], NOW)


def inspection_rollup(spark, sf_dir):
    return inspection.rolled_up(seen(spark, sf_dir, "orders", _CAPS)).select("release_id", F.round("availability", 4).alias("availability"), "tier")


def repair_coverage(spark, sf_dir):
    targets = seen(spark, sf_dir, "lineitem", ["l_orderkey AS release_id", "concat('Dir\\\\F', CAST(l_linenumber AS STRING), '.rar') AS name", "l_partkey AS size"])
    files = seen(spark, sf_dir, "lineitem", ["l_orderkey AS release_id", "concat('f', CAST(l_linenumber AS STRING), '.RAR') AS file_name"], "l_partkey % 3 = 0")
    return inspection.repair_coverage(targets, files)


def recovery_claims(spark, sf_dir):
    return inspection.claimed(seen(spark, sf_dir, "orders", _WORK), 500).select("binary_id", "poster_host", "message_host", "group_rank")


def recovery_admission(spark, sf_dir):
    return inspection.admitted(seen(spark, sf_dir, "orders", _ADMIT), 300, 900)


def recovery_rate(spark, sf_dir):
    """Capacity from the attempts of a window, beside the open work."""
    attempts = seen(spark, sf_dir, "events", ["event_id % 9 AS attempted", "user_id % 4 AS seconds"], "ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' and ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return inspection.capacity(attempts, seen(spark, sf_dir, "orders", ["CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'ready' ELSE 'running' END AS status"]), 4, 2, 250_000, 25_000)


def recovered_parts(spark, sf_dir):
    """Parts under the files that their recovered headers name, and how many files each took in."""
    parts = seen(spark, sf_dir, "lineitem", ["l_orderkey AS binary_id", "l_linenumber AS part_number", "CAST(floor(l_extendedprice) AS BIGINT) AS bytes", "l_partkey AS article_id"])
    merged, edges = inspection.applied(parts, seen(spark, sf_dir, "orders", _RECOVERED))
    return merged.join(edges.groupBy("target_id").agg(F.count("*").alias("taken_in")), "target_id", "left")


def cohort_feedback(spark, sf_dir):
    cohorts = seen(spark, sf_dir, "customer", ["c_custkey AS cohort_key", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 ELSE 0 END AS recovered", "c_custkey % 10 * 11 AS no_identity", "CASE WHEN c_custkey % 4 = 0 THEN 'cooldown' ELSE 'active' END AS status", "CAST(NULL AS TIMESTAMP_NTZ) AS cooldown_until"])
    return inspection.fed_back(cohorts, seen(spark, sf_dir, "orders", ["o_custkey AS cohort_key", "o_orderstatus = 'P' AS recovered"]), NOW)


QUERIES = {
    f.__name__: f
    for f in (
        nzb_documents, nzb_segments, feed_releases, scene_pages, file_signatures, archive_families, password_hints, media_entries, probe_streams, repair_targets, seven_zip_headers, inspection_candidates, inspection_backlog, inspection_rollup, repair_coverage,
        recovery_claims, recovery_admission, recovery_rate, recovered_parts, cohort_feedback,
    )
}

_BEST = f"""{seen_sql("s", "lineitem", _SEGMENTS)},
b AS (SELECT release_id, file_subject, part_number, max(bytes) AS bytes, min(poster) AS poster, min(posted_epoch) AS epoch_s FROM s WHERE message_id <> ' ' GROUP BY ALL),
m AS (SELECT b.*, min(substr(message_id, 2, length(message_id) - 2)) AS id, count(DISTINCT message_id) AS ties FROM b JOIN s USING (release_id, file_subject, part_number, bytes) WHERE message_id <> ' ' GROUP BY ALL),
g AS (SELECT release_id, file_subject, array_agg(DISTINCT group_name ORDER BY group_name) AS groups FROM s WHERE message_id <> ' ' GROUP BY ALL)"""
_DUE = lambda stage: f"(SELECT file_id, arg_max(status, -age) AS status, arg_max(coalesce(details, ''), -age) AS details, min(age) AS age FROM r WHERE stage = '{stage}' GROUP BY 1)"
_WAIT = "(w.file_id IS NULL OR w.status = 'failed' AND contains(w.details, 'true') AND w.age >= 6)"
_PICK = lambda stage, fits, key: f"""SELECT '{stage}' AS stage, o.release_id, o.set_key, o.file_id, o.file_name, o.posted_at, w.file_id IS NOT NULL AS again
  FROM (SELECT *, {key} AS set_key, row_number() OVER (PARTITION BY release_id, {key} ORDER BY regexp_matches(lower(file_name), '\\.(part01\\.rar|7z\\.001|tar\\.gz)$') OR regexp_matches(lower(file_name), '\\.rar$') AND NOT regexp_matches(lower(file_name), '\\.part\\d+\\.rar$') DESC, length(file_name), file_name, file_id, posted_at) AS place FROM f WHERE is_complete AND {fits}) o
  LEFT JOIN {_DUE(stage)} w ON w.file_id = o.file_id WHERE place = 1 AND {_WAIT}"""  # noqa: E731
_FAMILY = "regexp_replace(regexp_replace(lower(file_name), '\\.7z\\.\\d\\d\\d$', '.7z'), '\\.(part\\d+\\.rar|r\\d\\d)$', '.rar')"
_ARCH = "l_partkey % 13 BETWEEN 2 AND 7 OR l_partkey % 13 = 11"
_PICKS = f"""f AS (SELECT {', '.join(_FILES)}, l_partkey FROM lineitem), {seen_sql("r", "part", _RESULTS)}"""
_ALL = "\nUNION ALL ".join([_PICK("par2", "l_partkey % 13 < 2", "regexp_replace(lower(file_name), '(\\.vol00\\+01)?\\.par2$', '')"), _PICK("archive", f"({_ARCH})", _FAMILY), _PICK("media", "l_partkey % 13 = 8", "lower(file_name)"), _PICK("nfo", "l_partkey % 13 = 10", "lower(file_name)")])
_KIND = ["png", "jpeg", "gif", "webp", "par2", "7z", "rar", "zip", "matroska", "mp4", "avi", "flac", "mp3", "mp3", "text"]

ORACLE_SQL = {
    "nzb_documents": f"""WITH {_BEST},
        files AS (
          SELECT m.release_id, m.file_subject, concat('<file poster="', min(poster), '" date="', min(epoch_s), '" subject="', replace(replace(replace(replace(m.file_subject, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '"><groups>',
                 list_aggregate(list_transform(any_value(groups), lambda x: '<group>' || x || '</group>'), 'string_agg', ''), '</groups><segments>', string_agg(concat('<segment bytes="', bytes, '" number="', part_number, '">', id, '</segment>'), '' ORDER BY part_number), '</segments></file>') AS x
          FROM m JOIN g USING (release_id, file_subject) GROUP BY 1, 2)
        SELECT release_id, concat(CASE WHEN o_orderkey IS NOT NULL THEN concat('<head><meta type="title">', o_orderpriority, ' &amp; more</meta></head>') ELSE '' END, string_agg(x, '' ORDER BY file_subject), '</nzb>') AS body
        FROM files LEFT JOIN orders ON o_orderkey = release_id AND o_orderkey < 900 AND o_orderkey % 2 = 1 GROUP BY release_id, o_orderkey, o_orderpriority""",
    "nzb_segments": f"""WITH {_BEST}
        SELECT m.release_id, m.file_subject AS subject, min(poster) AS poster, min(epoch_s) AS posted_epoch, count(*) AS segments, CAST(sum(bytes) AS BIGINT) AS bytes, min(id) AS "first", list_aggregate(any_value(groups), 'string_agg', ',') AS groups
        FROM m JOIN g USING (release_id, file_subject) GROUP BY 1, 2""",
    "feed_releases": """
        SELECT p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN concat('http://x/', p_partkey) ELSE concat('g', p_partkey) END AS guid, trim(p_name) AS title, concat('http://n/', p_partkey) AS link,
               CAST(CASE WHEN p_partkey % 4 = 0 AND p_size > 0 THEN p_size WHEN p_partkey % 5 > 1 AND p_size > 0 THEN p_size * 7 ELSE p_size * 11 END AS BIGINT) AS size, CASE WHEN p_partkey % 5 > 1 THEN '5040' ELSE 'a' END AS category FROM part""",
    "scene_pages": """
        SELECT o_orderkey % 40 AS page_no, o_orderkey AS id, o_orderpriority AS name, 'T' AS team, o_orderstatus AS category, make_timestamp(o_orderkey * 1000000000) AS posted_at, o_custkey / 2.0::DOUBLE AS kilobytes FROM orders WHERE o_orderkey % 40 % 9 <> 0""",
    "file_signatures": f"""
        WITH f AS (SELECT p_partkey % 17 AS h, ['', 'matroska', 'text', 'mp4', ''][p_partkey // 17 % 5 + 1] AS ext FROM part),
        k AS (SELECT CASE WHEN h < 15 THEN {_KIND}[h + 1] ELSE ext END AS kind FROM f)
        SELECT kind, CASE kind WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' WHEN 'par2' THEN 'application/x-par2' WHEN '7z' THEN 'application/x-7z-compressed' WHEN 'rar' THEN 'application/vnd.rar'
                     WHEN 'zip' THEN 'application/zip' WHEN 'text' THEN 'text/plain' WHEN 'matroska' THEN 'video/x-matroska' WHEN 'mp4' THEN 'video/mp4' WHEN 'flac' THEN 'audio/flac' WHEN 'mp3' THEN 'audio/mpeg' ELSE '' END AS media_type, count(*) AS n
        FROM k GROUP BY 1""",
    "archive_families": f"""
        WITH f AS (SELECT {', '.join(_FILES)}, l_partkey FROM lineitem WHERE {_ARCH})
        SELECT release_id, {_FAMILY} AS family, count(*) AS files, count(*) FILTER (l_partkey % 13 IN (2, 4, 6, 11)) AS representatives FROM f GROUP BY 1, 2""",
    "password_hints": """
        SELECT p_partkey, concat(regexp_extract(lower(p_brand), '^[a-z0-9._-]+'), '|', p_partkey, 'xyz') AS hints FROM part""",
    "media_entries": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'film.MKV' WHEN p_partkey % 7 = 0 THEN 'song.mp3' WHEN p_partkey % 2 = 0 THEN 'readme.txt' WHEN p_partkey % 3 = 0 THEN 'sample/a.mkv' WHEN p_partkey % 4 = 1 THEN 'sample.txt' END AS entry FROM part""",
    "probe_streams": """
        SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN p_partkey + 0.5::DOUBLE END AS seconds, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size AS INTEGER) END AS width, CASE WHEN p_partkey % 11 > 0 THEN concat('l', p_partkey % 3) END AS language, CASE WHEN p_partkey % 11 > 0 THEN 2::INTEGER END AS streams FROM part""",
    "repair_targets": """
        SELECT p_partkey AS file_id, concat(p_name, '.rar') AS name, p_partkey * 1000 AS size FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, 'other.7z', p_partkey + 7 FROM part""",
    "seven_zip_headers": """
        SELECT p_partkey, CASE WHEN ok THEN p_partkey * 4096 + 32 END AS start, CASE WHEN ok THEN p_partkey % 7 * 10 END AS size, CASE WHEN ok THEN p_partkey + 1 END AS crc FROM (SELECT p_partkey, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS ok FROM part)""",
    "inspection_candidates": f"""WITH {_PICKS} SELECT release_id, set_key, file_id, file_name, again, posted_at FROM ({_PICK("archive", f"({_ARCH})", _FAMILY)}) ORDER BY posted_at DESC NULLS LAST, file_id, release_id, set_key LIMIT 300""",
    "inspection_backlog": f"WITH {_PICKS} SELECT stage, count(DISTINCT release_id) AS releases, count(*) AS files FROM ({_ALL}) GROUP BY 1",
    "inspection_rollup": """
        WITH c AS (SELECT o_orderkey AS id, least(100, o_custkey % 120)::DOUBLE AS done, (o_orderkey % 110)::DOUBLE AS a, o_orderkey % 5 = 0 AS u, o_orderkey % 3 = 0 AS k FROM orders),
        s AS (SELECT id, CASE WHEN u THEN least(least(a, 100), greatest(done * 0.6::DOUBLE, 25)) WHEN k AND least(a, 100) < done THEN done ELSE a END AS v FROM c)
        SELECT id AS release_id, round(v, 4) AS availability, CASE WHEN v >= 85 THEN 'excellent' WHEN v >= 70 THEN 'good' WHEN v >= 50 THEN 'partial' ELSE 'low' END AS tier FROM s""",
    "repair_coverage": """
        WITH t AS (SELECT l_orderkey AS r, l_linenumber AS n, max(l_partkey) AS size, bool_or(l_partkey % 3 = 0) AS there FROM lineitem GROUP BY 1, 2)
        SELECT r AS release_id, count(*) AS expected, count(*) FILTER (there) AS present, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY 1""",
    "recovery_claims": f"""WITH {seen_sql("w", "orders", _WORK)},
        h AS (
          SELECT *, date_trunc('minute', coalesce(posted_at, updated_at)) AS minute, CASE WHEN poster LIKE '%@%' THEN lower(regexp_replace(split_part(poster, '@', 2), '[^a-z0-9._-]', '', 'g')) ELSE '' END AS poster_host,
                 CASE WHEN message_id LIKE '%@%' THEN split_part(trim(message_id, '<>'), '@', 2) ELSE '' END AS message_host FROM w),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY group_id, priority, minute, poster_host, message_host ORDER BY posted_at DESC NULLS LAST, article_number, binary_id) AS INTEGER) AS group_rank FROM h)
        SELECT binary_id, poster_host, message_host, group_rank FROM n ORDER BY priority, minute DESC, poster_host, message_host, group_rank, posted_at DESC NULLS LAST, article_number, binary_id LIMIT 500""",
    "recovery_admission": f"""WITH {seen_sql("w", "orders", _ADMIT)},
        s AS (SELECT *, CASE WHEN is_opaque AND cohort_size >= 20 THEN 0 WHEN total_parts > 1 THEN 1 ELSE 2 END AS rk, cohort_size * 1000 + observed_parts AS score FROM w WHERE NOT name_known AND observed_parts > 0),
        p AS (SELECT *, row_number() OVER (ORDER BY rk, score DESC, age_hours, binary_id) AS place FROM s)
        SELECT binary_id, CAST(rk AS INTEGER) AS rank, ['opaque_near_time', 'multipart_without_name', 'backfill'][rk + 1] AS reason, score FROM p WHERE place <= 300 OR place <= 900 AND rk = 0""",
    "recovery_rate": """
        WITH a AS (SELECT sum(event_id % 9) * 3600.0::DOUBLE / sum(user_id % 4) AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20')
        SELECT round(rate, 4) AS rate, CAST(ceil(rate * 4) AS BIGINT) AS soft, least(250000, CAST(ceil(rate * 4) * 2 AS BIGINT))::BIGINT AS hard, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS ready, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')) AS running,
               (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS open FROM a""",
    "recovered_parts": f"""WITH {seen_sql("r", "orders", _RECOVERED)},
        k AS (SELECT binary_id, total_parts, min(binary_id) OVER (PARTITION BY group_id, lower(trim(file_name)), total_parts, file_size) AS target_id FROM r WHERE trim(file_name) <> '' AND total_parts > 0),
        p AS (SELECT target_id, l_linenumber AS part_number, CAST(floor(l_extendedprice) AS BIGINT) AS bytes, l_partkey AS article_id FROM lineitem JOIN k ON l_orderkey = binary_id AND l_linenumber <= total_parts),
        w AS (SELECT *, count(*) OVER (PARTITION BY target_id, part_number) AS copies FROM p QUALIFY row_number() OVER (PARTITION BY target_id, part_number ORDER BY bytes DESC, article_id) = 1)
        SELECT w.*, t.n AS taken_in FROM w LEFT JOIN (SELECT target_id, count(*) AS n FROM k WHERE binary_id <> target_id GROUP BY 1) t ON t.target_id = w.target_id""",
    "cohort_feedback": """
        WITH d AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS yes, count(*) FILTER (o_orderstatus <> 'P') AS no FROM orders GROUP BY 1),
        s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 ELSE 0 END + coalesce(yes, 0) AS good, c_custkey % 10 * 11 + coalesce(no, 0) AS bad, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no FROM customer LEFT JOIN d ON o_custkey = c_custkey)
        SELECT k AS cohort_key, good AS recovered, bad AS no_identity, CASE WHEN yes > 0 THEN 'active' WHEN no > 0 AND good = 0 AND bad >= 100 OR k % 4 = 0 THEN 'cooldown' ELSE 'active' END AS status,
               CASE WHEN no > 0 AND good = 0 AND bad >= 100 THEN TIMESTAMP '2024-01-25 00:30:00' END AS cooldown_until FROM s""",
}
