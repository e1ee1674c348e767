"""Queries on selection, regrouping, matching, categories, clusters and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.functions import category, matching
from headerloom.functions.text import counters
from headerloom.operators import regroup
from headerloom.plans.views import FILES, SUBJECTS, files, subjects
from headerloom.sources.folders import shared_path
from headerloom.sources.tables import table
from headerloom.streaming import upserts

#: Words that are put behind part names to make titles of every kind, by p_partkey.
TITLE_TAILS = [
    "", "S01E02 720p", "2019 1080p BluRay", "BluRay.x264", "PS4", "Nintendo.Switch", "FLAC album", "mp3", "epub magazine", "comic", "adobe windows", "android game", "anime 2x03", "2021-05-06 nba",
    "french dvdrip", "xxx pack", "podcast", "ebook pdf", "steam iso", "remux 2160p", "3D bluray", "switches", "mac software", "documentary S1E1",
]
MEDIA = {2: "tv", 5: "movie", 9: "audio"}  # by p_partkey % 31
RESOLUTIONS = ["", "2160p", "1080p", "480p"]  # by p_partkey // 24 % 4


def header_dedupe_resolve(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_orderkey") % 3).alias("group_id"), (F.col("o_custkey") % 400).alias("article_number"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload"))
    stored = rows.where("seq % 7 = 0").select("group_id", "article_number", F.col("seq").alias("header_id"))
    return regroup.resolve_headers(stored, rows)


def priority_binaries(spark, sf_dir):
    return regroup.best_files(files(spark, sf_dir).select("family_key", "group_id", "binary_id", "is_main", "is_complete"), ["family_key", "group_id"])


def _fragments(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("/", F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMM"))
    return l.select(key.alias("group_key"), F.col("l_orderkey").alias("binary_id"), F.col("l_linenumber").alias("part_number"), F.floor("l_extendedprice").cast("long").alias("segment_bytes"), F.col("l_partkey").alias("article_id"))


def regroup_groups(spark, sf_dir):
    return regroup.regroup_targets(_fragments(spark, sf_dir))


def regrouped_parts(spark, sf_dir):
    return regroup.regrouped_parts(_fragments(spark, sf_dir))


def superseded_edges(spark, sf_dir):
    return regroup.superseded(_fragments(spark, sf_dir))


def archive_recovery(spark, sf_dir):
    return regroup.recovered_kinds(files(spark, sf_dir))


def reform_candidates(spark, sf_dir):
    released = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("family_key"), (F.col("c_custkey") % 15).alias("release_files"))
    return regroup.reform_candidates(files(spark, sf_dir), released)


def candidate_binaries_union(spark, sf_dir):
    f = files(spark, sf_dir)
    by_family, by_set = f.where("is_main"), f.where("file_index = 3 and is_complete")
    return by_family.select("binary_id", "family_key").union(by_set.select("binary_id", "family_key")).distinct()


def superseded_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


def lateral_top1(spark, sf_dir):
    """The correlated LIMIT 1 as one aggregate and a left join."""
    newest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(newest, "c_custkey", "left")


def lateral_agg(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max("o_orderdate").alias("last_at"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(found, "c_custkey", "left").select("c_custkey", F.coalesce("done", F.lit(0).cast("long")).alias("done"), "last_at")


def canonical_key(spark, sf_dir):
    tails = F.array(*[F.lit(t) for t in (".part01.rar", ".r07", ".vol03+04.par2", ".7z.002", "", ".nfo", ".mkv")])
    name = F.concat("p_name", F.element_at(tails, (F.col("p_partkey") % 7 + 1).cast("int")))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", matching.canonical_key(F.col("name")).alias("key"), matching.archive_volume(F.col("name")).alias("volume"), matching.is_auxiliary(F.col("name")).alias("auxiliary"))


def match_result(spark, sf_dir):
    rows = subjects(spark, sf_dir)
    line = F.col("l_linenumber")
    subject = F.when(line == 6, F.concat(F.lit("[6/7] "), F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 16))).when(line == 7, "no name").otherwise(F.col("subject"))
    poster = F.when(F.col("l_partkey") % 4 > 0, F.lit("p"))
    # Three projections: what is used several times is a column of the one before.
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", subject.alias("subject"), poster.alias("poster"), F.when(line != 5, "a@b").alias("message_id"))
    c = counters(F.col("subject"))
    rows = rows.select("*", *[c[n].alias(n) for n in ("file_name", "file_total", "part_total")])
    value = matching.confidence(F.col("subject"), F.col("poster"), F.lit("2024-01-01").cast("timestamp"), F.col("l_partkey"), F.lit(None), F.col("message_id"))
    rows = rows.select("*", matching.canonical_key(F.col("file_name")).alias("family_key"), value.alias("value"))
    rows = rows.withColumn("kind", matching.family_kind(F.col("file_name"), F.col("family_key"), F.col("file_total"), F.col("part_total")))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "family_key", F.round("value", 4).alias("confidence"), matching.match_status(F.col("value")).alias("status"), "kind",
        matching.identity_strength(F.col("kind"), F.col("family_key")).alias("strength"),
    )


def category_resolver(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", category.words_of(F.col("p_name"), pick(TITLE_TAILS, k)).alias("text"), pick(RESOLUTIONS, F.floor(k / 24)).alias("resolution"), *[
        F.when(k % 31 == 2, "tv").when(k % 31 == 5, "movie").when(k % 31 == 9, "audio").alias("media")
    ])
    none, zero = F.lit(None).cast("string"), F.lit(0)
    rows = rows.withColumn("kind", category.category_kind(F.col("text"), none, F.col("media"), none, none, zero, zero))
    return rows.select("p_partkey", "kind", category.category_id(F.col("kind"), F.col("text"), F.col("resolution")).alias("category_id"))


def stream_observation_stats(spark, sf_dir):
    """Daily counts and whole values by event type, kept by a stream over the table and read back."""
    # A pattern, since a stream takes a plain path for a folder and the table may be one file.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))
    changes = upserts.bucket_counts(events, "at", "1 day", "1 day", "event_type", measure=F.floor("value").cast("long"))
    target, keys = shared_path(spark, "stream-out"), ["event_type", "window_start"]
    upserts.write_changes(changes, target, shared_path(spark, "stream-state")).awaitTermination()
    found = upserts.current(spark, target, keys, "event_type string, window_start timestamp, n long, total long")
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {
    f.__name__: f
    for f in (
        header_dedupe_resolve, priority_binaries, regroup_groups, regrouped_parts, superseded_edges, archive_recovery, reform_candidates, candidate_binaries_union, superseded_anti,
        lateral_top1, lateral_agg, canonical_key, match_result, category_resolver, stream_observation_stats,
    )
}

_FRAGMENTS = """parts AS (
  SELECT concat_ws('/', l_suppkey, strftime(l_shipdate, '%Y%m')) AS group_key, l_orderkey AS binary_id, l_linenumber AS part_number,
         CAST(floor(l_extendedprice) AS BIGINT) AS segment_bytes, l_partkey AS article_id
  FROM lineitem),
targets AS (
  SELECT group_key, min(binary_id) AS target_binary_id FROM parts GROUP BY group_key
  HAVING count(DISTINCT binary_id) > 1 AND count(DISTINCT part_number) > 1)"""
_TOKEN = r"vol\d+ \d+|part\d+|rar|zip|7z|par2|nfo|sfv|srr|mkv|mp4|avi|mov|mp3|flac|m4a|wav|nzb|iso|r\d{2}|(?:rar|zip|7z|par2|nfo|sfv|srr|mkv|mp4|avi|mov|mp3|flac|m4a|wav|nzb|iso) \d+"
_KEY = lambda name: rf"trim(regexp_replace(trim(regexp_replace(lower({name}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '(?: (?:{_TOKEN}))+$', ''))"
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
# The words and ids of the categories as the SQL knows them, stated apart from the operator's tables.
_WORDS = (
    "('xxx', 0, 'xxx'), ('xxx', 0, 'porn'), ('xxx', 0, 'nsfw'), ('xxx', 0, 'onlyfans'), ('xxx', 0, 'brazzers'), ('xxx', 0, 'playboy'), ('xxx', 0, 'erotica'), ('console', 1, 'ps3'), ('console', 1, 'ps4'), "
    "('console', 1, 'ps5'), ('console', 1, 'playstation'), ('console', 1, 'xbox'), ('console', 1, 'x360'), ('console', 1, 'xboxone'), ('console', 1, 'switch'), ('console', 1, 'nintendo'), ('console', 1, 'wii'), "
    "('console', 1, 'psp'), ('console', 1, 'nds'), ('console', 1, '3ds'), ('movie', 2, 'bluray'), ('movie', 2, 'bdrip'), ('movie', 2, 'dvdrip'), ('movie', 2, 'remux'), ('audio', 3, 'flac'), ('audio', 3, 'mp3'), "
    "('audio', 3, 'album'), ('audio', 3, 'discography'), ('audio', 3, 'podcast'), ('audio', 3, 'audiobook'), ('books', 4, 'ebook'), ('books', 4, 'epub'), ('books', 4, 'mobi'), ('books', 4, 'pdf'), "
    "('books', 4, 'comic'), ('books', 4, 'magazine'), ('books', 4, 'manga'), ('pc', 5, 'windows'), ('pc', 5, 'mac'), ('pc', 5, 'android'), ('pc', 5, 'ios'), ('pc', 5, 'ipa'), ('pc', 5, 'apk'), ('pc', 5, 'game'), "
    "('pc', 5, 'steam'), ('pc', 5, 'software'), ('pc', 5, '0day'), ('pc', 5, 'trainer'), ('pc', 5, 'stl'), ('pc', 5, 'steinberg'), ('pc', 5, 'cubase'), ('pc', 5, 'nuendo'), ('pc', 5, 'ableton'), "
    "('pc', 5, 'autodesk'), ('pc', 5, 'adobe'), ('pc', 5, 'microsoft office')"
)
_IDS = (
    "('xxx', 0, 6060, 'imgset'), ('xxx', 0, 6060, 'photoset'), ('xxx', 1, 6050, 'pack'), ('xxx', 2, 6020, 'wmv'), ('xxx', 3, 6010, 'dvd'), ('console', 0, 1035, 'switch'), ('console', 0, 1035, 'nintendo switch'), "
    "('console', 1, 1100, 'ps4'), ('console', 1, 1100, 'playstation 4'), ('console', 2, 1080, 'ps3'), ('console', 2, 1080, 'playstation 3'), ('console', 3, 1090, 'xbox one'), ('console', 3, 1090, 'xbone'), "
    "('console', 4, 1050, 'xbox 360'), ('console', 4, 1050, 'x360'), ('console', 5, 1040, 'xbox'), ('console', 6, 1030, 'wii'), ('console', 7, 1020, 'psp'), ('console', 8, 1010, 'nds'), ('console', 8, 1010, '3ds'), "
    "('tv', 0, 5070, 'anime'), ('tv', 1, 5080, 'documentary'), ('tv', 1, 5080, 'docu'), ('tv', 2, 5060, 'sport'), ('tv', 2, 5060, 'sports'), ('tv', 2, 5060, 'ufc'), ('tv', 2, 5060, 'wwe'), ('tv', 2, 5060, 'formula'), "
    "('tv', 2, 5060, 'motogp'), ('tv', 2, 5060, 'nba'), ('tv', 2, 5060, 'nfl'), ('tv', 2, 5060, 'mlb'), ('tv', 2, 5060, 'nhl'), ('tv', 3, 5020, 'foreign'), ('tv', 3, 5020, 'german'), ('tv', 3, 5020, 'french'), "
    "('tv', 3, 5020, 'spanish'), ('tv', 3, 5020, 'nlsubs'), ('movie', 0, 2060, '3d'), ('movie', 1, 2010, 'foreign'), ('movie', 1, 2010, 'french'), ('movie', 1, 2010, 'german'), ('movie', 1, 2010, 'spanish'), "
    "('movie', 1, 2010, 'ita'), ('movie', 1, 2010, 'nlsubs'), ('audio', 0, 3030, 'audiobook'), ('audio', 1, 3050, 'podcast'), ('audio', 2, 3040, 'flac'), ('audio', 2, 3040, 'lossless'), ('audio', 3, 3010, 'mp3'), "
    "('audio', 4, 3020, 'music video'), ('audio', 4, 3020, 'concert'), ('books', 0, 7030, 'comic'), ('books', 0, 7030, 'comics'), ('books', 0, 7030, 'manga'), ('books', 1, 7010, 'magazine'), "
    "('books', 1, 7010, 'mags'), ('pc', 0, 4070, 'android'), ('pc', 0, 4070, 'apk'), ('pc', 1, 4060, 'ios'), ('pc', 1, 4060, 'iphone'), ('pc', 1, 4060, 'ipad'), ('pc', 1, 4060, 'ipa'), ('pc', 2, 4040, 'mobile'), "
    "('pc', 3, 4030, 'mac'), ('pc', 3, 4030, 'osx'), ('pc', 3, 4030, 'macos'), ('pc', 4, 4050, 'game'), ('pc', 4, 4050, 'steam'), ('pc', 4, 4050, 'gog'), ('pc', 4, 4050, 'repack'), ('pc', 5, 4020, 'iso'), "
    "('pc', 6, 4080, 'stl'), ('pc', 6, 4080, '3d print'), ('pc', 6, 4080, '3dprint'), ('pc', 7, 4010, '0day'), ('pc', 7, 4010, 'steinberg'), ('pc', 7, 4010, 'cubase'), ('pc', 7, 4010, 'nuendo'), "
    "('pc', 7, 4010, 'ableton'), ('pc', 7, 4010, 'autodesk'), ('pc', 7, 4010, 'adobe'), ('pc', 7, 4010, 'microsoft office'), ('pc', 7, 4010, 'software')"
)

ORACLE_SQL = {
    "header_dedupe_resolve": """
        WITH incoming AS (SELECT o_orderkey % 3 AS group_id, o_custkey % 400 AS article_number, o_orderkey AS seq, o_orderpriority AS payload FROM orders),
        placed AS (SELECT *, row_number() OVER (PARTITION BY group_id, article_number ORDER BY seq DESC) AS place, count(*) OVER (PARTITION BY group_id, article_number) AS copies FROM incoming)
        SELECT group_id, article_number, payload, copies, header_id, CASE WHEN header_id IS NULL THEN 'insert' ELSE 'resolve' END AS action
        FROM (SELECT p.*, (SELECT min(seq) FROM incoming i WHERE i.group_id = p.group_id AND i.article_number = p.article_number AND seq % 7 = 0) AS header_id FROM placed p WHERE place = 1)""",
    "priority_binaries": f"""WITH {FILES},
        placed AS (SELECT *, row_number() OVER (PARTITION BY family_key, group_id ORDER BY is_main DESC, is_complete DESC, binary_id) AS place FROM files)
        SELECT family_key, group_id, binary_id, is_main, is_complete FROM placed WHERE place = 1""",
    "regroup_groups": f"WITH {_FRAGMENTS} SELECT * FROM targets",
    "regrouped_parts": f"""WITH {_FRAGMENTS},
        placed AS (
          SELECT target_binary_id, p.*, count(*) OVER (PARTITION BY p.group_key, part_number) AS copies,
                 row_number() OVER (PARTITION BY p.group_key, part_number ORDER BY segment_bytes DESC, article_id, binary_id) AS place
          FROM parts p JOIN targets t ON p.group_key = t.group_key)
        SELECT target_binary_id, group_key, part_number, segment_bytes, article_id, binary_id AS source_binary_id, copies FROM placed WHERE place = 1""",
    "superseded_edges": f"WITH {_FRAGMENTS} SELECT DISTINCT binary_id, target_binary_id FROM parts p JOIN targets t ON p.group_key = t.group_key WHERE binary_id <> target_binary_id",
    "archive_recovery": f"""WITH {FILES},
        clear AS (SELECT family_key, min(kind) AS recovered_kind FROM files WHERE kind NOT IN ('opaque_set', 'numeric_obfuscated_set') GROUP BY family_key HAVING count(DISTINCT kind) = 1)
        SELECT f.family_key, binary_id, kind, recovered_kind FROM files f JOIN clear c ON f.family_key = c.family_key WHERE kind IN ('opaque_set', 'numeric_obfuscated_set')""",
    "reform_candidates": f"""WITH {FILES},
        payload AS (SELECT family_key, count(*) FILTER (is_main) AS payload_files, CAST(coalesce(max(expected_files), 0) AS BIGINT) AS expected FROM files GROUP BY family_key)
        SELECT c_custkey AS family_key, c_custkey % 15 AS release_files, payload_files, expected FROM customer JOIN payload ON c_custkey = family_key
        WHERE c_custkey % 3 <> 0 AND (payload_files > c_custkey % 15 OR expected > c_custkey % 15 AND payload_files >= expected)""",
    "candidate_binaries_union": f"""WITH {FILES}
        SELECT binary_id, family_key FROM files WHERE is_main UNION SELECT binary_id, family_key FROM files WHERE file_index = 3 AND is_complete""",
    "superseded_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "lateral_top1": """
        SELECT c_custkey, last_order FROM customer
        LEFT JOIN LATERAL (SELECT o_orderkey AS last_order FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON TRUE""",
    "lateral_agg": """
        SELECT c_custkey, done, last_at FROM customer
        LEFT JOIN LATERAL (SELECT count(*) FILTER (o_orderstatus = 'F') AS done, max(o_orderdate) AS last_at FROM orders WHERE o_custkey = c_custkey) ON TRUE""",
    "canonical_key": f"""
        WITH named AS (SELECT p_partkey, concat(p_name, (['.part01.rar', '.r07', '.vol03+04.par2', '.7z.002', '', '.nfo', '.mkv'])[p_partkey % 7 + 1]) AS name FROM part)
        SELECT p_partkey, {_KEY("name")} AS key, CAST(CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 3 THEN 2 ELSE 0 END AS INTEGER) AS volume, p_partkey % 7 IN (2, 5) OR contains(lower(name), 'sample') AS auxiliary
        FROM named""",
    "match_result": f"""WITH {SUBJECTS},
        named AS (SELECT *, CASE WHEN l_linenumber >= 6 THEN '' ELSE concat(p_name, '.part0', l_linenumber, '.rar') END AS name FROM subjects),
        keyed AS (SELECT *, {_KEY("name")} AS family_key FROM named),
        weighed AS (
          SELECT *, CASE l_linenumber WHEN 7 THEN 0.16 ELSE 0.24 END + CASE WHEN l_linenumber < 6 THEN 0.62 ELSE 0 END AS base,
                 CASE WHEN l_partkey % 4 > 0 THEN 0.05 ELSE 0 END + 0.03 + CASE WHEN l_partkey > 0 THEN 0.02 ELSE 0 END + CASE WHEN l_linenumber <> 5 THEN 0.05 ELSE 0 END + CASE WHEN l_linenumber < 6 THEN 0.05 ELSE 0 END AS later
          FROM keyed),
        scored AS (SELECT *, CAST(CASE WHEN base >= 0.85 AND family_key <> '' THEN base ELSE least(1, base + later) END AS DOUBLE) AS c FROM weighed),
        kinds AS (SELECT *, CASE WHEN regexp_matches(family_key, '(^| )\\p{{L}}{{3,}}( | .* )\\p{{L}}{{3,}}( |$)') THEN 'readable_title' WHEN name = '' OR family_key = '' THEN 'contextual' ELSE 'archive_stem' END AS kind FROM scored)
        SELECT l_orderkey, l_linenumber, l_partkey, family_key, round(c, 4) AS confidence, CASE WHEN c >= 0.85 THEN 'matched' WHEN c >= 0.55 THEN 'probable' ELSE 'low_confidence' END AS status,
               kind, CASE kind WHEN 'contextual' THEN 'weak' ELSE 'strong' END AS strength
        FROM kinds""",
    "category_resolver": f"""
        WITH titles AS (
          SELECT p_partkey, concat(' ', translate(concat_ws(' ', lower(trim(p_name)), lower(({_LIST(TITLE_TAILS)})[p_partkey % {len(TITLE_TAILS)} + 1])), '._-/', '    '), ' ') AS text,
                 ({_LIST(RESOLUTIONS)})[p_partkey // 24 % {len(RESOLUTIONS)} + 1] AS resolution, CASE p_partkey % 31 WHEN 2 THEN 'tv' WHEN 5 THEN 'movie' WHEN 9 THEN 'audio' END AS media
          FROM part),
        words(kind, place, word) AS (VALUES {_WORDS}),
        ids(kind, place, id, word) AS (VALUES {_IDS}),
        hits AS (SELECT p_partkey, list(DISTINCT w.kind) AS said FROM titles JOIN words w ON contains(text, ' ' || word || ' ') GROUP BY p_partkey),
        kinds AS (
          SELECT t.*, CASE WHEN list_contains(said, 'xxx') THEN 'xxx' WHEN list_contains(said, 'console') THEN 'console'
                           WHEN media = 'tv' OR regexp_matches(text, ' s\\d+e\\d+ | \\d+x\\d+ | 20\\d\\d \\d\\d \\d\\d ') THEN 'tv'
                           WHEN media = 'movie' OR list_contains(said, 'movie') OR regexp_matches(text, ' (19[5-9]|20\\d)\\d ') THEN 'movie'
                           WHEN media = 'audio' OR list_contains(said, 'audio') THEN 'audio' WHEN list_contains(said, 'books') THEN 'books' WHEN list_contains(said, 'pc') THEN 'pc' ELSE 'misc' END AS kind
          FROM titles t LEFT JOIN hits h ON t.p_partkey = h.p_partkey)
        SELECT p_partkey, kind, CAST(coalesce(
                 (SELECT arg_min(id, place) FROM ids WHERE ids.kind = kinds.kind AND contains(text, ' ' || word || ' ')),
                 CASE WHEN kind = 'movie' AND resolution IN ('', '480p') AND regexp_matches(text, ' (bluray|blu ray|bdrip|bdremux) ') THEN 2050 END,
                 CASE kind WHEN 'console' THEN 1000 WHEN 'audio' THEN 3000 WHEN 'books' THEN 7020 WHEN 'pc' THEN 4000 WHEN 'misc' THEN 8010 END,
                 CASE kind WHEN 'xxx' THEN 6000 WHEN 'tv' THEN 5000 ELSE 2000 END
                   + CASE resolution WHEN '2160p' THEN 45 WHEN '1080p' THEN 40
                     ELSE CASE WHEN regexp_matches(text, ' (480p|576p) ') OR kind = 'movie' AND regexp_matches(text, ' (dvdrip|xvid) ') THEN 30 ELSE CASE kind WHEN 'xxx' THEN 70 WHEN 'tv' THEN 50 ELSE 20 END END END) AS INTEGER) AS category_id
        FROM kinds""",
    "stream_observation_stats": """
        SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS total
        FROM events GROUP BY ALL""",
}
