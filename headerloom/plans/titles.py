"""The query of release titles and its SQL, which states the readings of names and the choice again."""

from __future__ import annotations

from headerloom.operators import titling
from headerloom.plans.views import seen, seen_sql

_NOISE = "concat(md5(CAST(o_custkey AS {text})), 'z')"
_RELEASES = [
    "o_orderkey AS release_id",
    f"CASE o_orderkey % 7 WHEN 0 THEN {_NOISE} WHEN 1 THEN '' WHEN 2 THEN concat('Great.Film_', CAST(2000 + o_custkey % 20 AS {{text}})) WHEN 3 THEN 'Private Release' WHEN 4 THEN 'deadbeef99' WHEN 5 THEN concat('Show ', o_orderpriority) END AS source_title",
    f"CASE o_custkey % 4 WHEN 0 THEN 'clear-stem of.it' WHEN 1 THEN '' WHEN 2 THEN {_NOISE} END AS stem",
]
_FILES = [
    "l_orderkey AS release_id", "l_linenumber * 100000 + l_partkey AS ord",
    "concat(CASE l_partkey % 6 WHEN 0 THEN 'dir\\\\' WHEN 1 THEN 'sample/' ELSE '' END, CASE l_suppkey % 5 WHEN 0 THEN 'Great.Film.1080p' WHEN 1 THEN 'Show_high' WHEN 2 THEN 'abcdefghijklmnop' WHEN 3 THEN 'Two Words Here' ELSE 'word' END, CASE l_partkey % 7 WHEN 0 THEN '.mkv' WHEN 1 THEN '.part1.rar' WHEN 2 THEN '.rar' WHEN 3 THEN '.mp3' WHEN 4 THEN '.nzb' WHEN 5 THEN '.7z.001' ELSE '.par2' END) AS file_name",
]
_INSPECTED = [
    "l_orderkey AS release_id", "l_linenumber * 100000 + l_partkey AS ord", "CASE l_linenumber WHEN 1 THEN 'media_title' WHEN 2 THEN ' archive_entry' WHEN 3 THEN 'nfo' ELSE 'none' END AS source",
    "CASE l_linenumber WHEN 1 THEN concat('Film_', l_returnflag, ' of x') WHEN 2 THEN concat('a/', concat('Folder ', l_returnflag), '/', CASE WHEN l_partkey % 3 = 0 THEN '.mkv' ELSE 'Entry.Name.mp4' END) ELSE concat('***', chr(10), '[ Film ', l_returnflag, CASE WHEN l_partkey % 2 = 0 THEN ' 1999' ELSE ' long ago' END, ' ]', chr(10), 'Other 720p') END AS value",
    "l_suppkey % 6 / CAST(5 AS DOUBLE) AS confidence",
]


def _texts(exprs: list[str], text: str) -> list[str]:
    return [e.replace("{text}", text) for e in exprs]


def release_titles(spark, sf_dir):
    """Orders as releases whose lines are their files and what was found in them."""
    return titling.release_titles(seen(spark, sf_dir, "orders", _texts(_RELEASES, "STRING")), seen(spark, sf_dir, "lineitem", _FILES), seen(spark, sf_dir, "lineitem", _INSPECTED))


_WORDS = r"\b(2160p|1080p|720p|576p|480p|x265|h265|hevc|av1|x264|h264|xvid|truehd|atmos|dts[- ]?hd|dts|ddp|eac3|ac3|aac|flac|mp3|remux|bluray|bdrip|webrip|web[- ]?dl|hdtv|dvdrip|cam)\b"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(trim({x})), '[_.\-\s]+', ' ', 'g'))"


def _shown(x: str) -> str:
    return rf"trim(regexp_replace(translate(trim({x}), '_.', '  '), '\s+', ' ', 'g'))"


def _style(x: str) -> str:
    return rf"trim(regexp_replace(translate(trim({x}), '\/_ ', '....'), '\.+', '.', 'g'), '.')"


def _obscure(x: str, whole: bool) -> str:
    key = _norm(x)
    stem = rf"regexp_replace(regexp_replace(lower(trim({x})), '(\.vol\d+\+\d+(\.par2)?|\.part\d+\.rar|\.r\d{{2,3}}|\.[^./]*)$', ''), '[._\-\s]+', ' ', 'g')"
    core = f"CASE WHEN trim({stem}) <> '' THEN trim({stem}) ELSE {key} END" if whole else key
    return rf"(({core}) <> '' AND (regexp_matches(replace({core}, ' ', ''), '^[a-f0-9]{{8,}}$') OR regexp_matches({core}, '^[a-z0-9]{{12,}}$') OR NOT regexp_matches({key}, '{_WORDS}') AND regexp_matches({core}, '^[a-z0-9]{{12,}}( \S+)?$')))"


def _readable(x: str, whole: bool = True) -> str:
    key = _norm(x)
    noise = rf" AND NOT regexp_matches({key}, '^\d{{5,}}\s+[a-z](\s+[a-z]{{2,4}})?$')" if whole else ""
    return f"({key} <> '' AND (contains({key}, ' ') OR regexp_matches({key}, '{_WORDS}')) AND NOT {_obscure(x, whole)}{noise})"


def _alike(x: str, y: str) -> str:
    a, b = f"string_split({_norm(x)}, ' ')", f"string_split({_norm(y)}, ' ')"
    return f"({_norm(x)} <> '' AND {_norm(y)} <> '' AND ({_norm(x)} = {_norm(y)} OR len(list_filter({a}, lambda w: list_contains({b}, w))) / least(len({a}), len({b})) >= 0.6))"


def _fold(of: str) -> str:
    """The best of each release of a table of candidates, in their order."""
    return f"""{of}_top AS (SELECT DISTINCT ON (release_id, title, style, source) * FROM {of} c WHERE confidence = (SELECT max(confidence) FROM {of} d WHERE d.release_id = c.release_id) ORDER BY ord),
        {of}_best AS (SELECT release_id, list_reduce(list({{'ord': ord, 'alike': {_alike('title', 'source_title')}, 'long': strlen({_norm('title')}), 'style': style, 'title': title, 'source': source, 'confidence': confidence}} ORDER BY ord),
          lambda x, y: CASE WHEN y.alike AND NOT x.alike OR y.long > x.long THEN y ELSE x END) AS best FROM {of}_top GROUP BY 1)"""


QUERIES = {"release_titles": release_titles}
ORACLE_SQL = {
    "release_titles": rf"""WITH {seen_sql("r0", "orders", _texts(_RELEASES, "VARCHAR"))}, {seen_sql("f0", "lineitem", [e.replace("'dir" + chr(92) * 2 + "'", "'dir" + chr(92) + "'") for e in _FILES])}, {seen_sql("i0", "lineitem", _INSPECTED)},
        r AS MATERIALIZED (SELECT release_id, trim(coalesce(source_title, '')) AS source_title, trim(coalesce(stem, '')) AS stem FROM r0),
        i1 AS MATERIALIZED (
          SELECT i.release_id, i.ord, trim(i.source) AS source, i.confidence, r.source_title,
                 CASE trim(i.source) WHEN 'media_title' THEN value WHEN 'archive_entry' THEN CASE WHEN ends_with(value, '/.mkv') THEN string_split(value, '/')[2] ELSE regexp_replace(string_split(value, '/')[3], '\.[^.]*$', '') END
                   WHEN 'nfo' THEN list_filter(list_transform(string_split(value, chr(10)), lambda y: trim(y, '-_=*#[]() ')), lambda y: y <> '' AND regexp_matches(lower(y), 's0|\b(19|20)\d\d\b|{_WORDS}') AND {_readable('y', False)})[1] END AS raw
          FROM i0 i JOIN r ON r.release_id = i.release_id),
        given AS MATERIALIZED (SELECT * EXCLUDE (raw), {_style(f"CASE WHEN source = 'media_title' THEN {_shown('raw')} ELSE raw END")} AS style, {_shown('raw')} AS title FROM i1 WHERE raw IS NOT NULL AND {_readable(_shown('raw'), False)}),
        {_fold("given")},
        f1 AS MATERIALIZED (
          SELECT f.release_id, f.ord, r.source_title, regexp_matches(file_name, '\.(mkv|mp3)$') AS media, regexp_replace(regexp_replace(replace(file_name, chr(92), '/'), '^.*/', ''), '\.[^.]*$', '') AS raw
          FROM f0 f JOIN r ON r.release_id = f.release_id WHERE NOT contains(file_name, 'sample') AND regexp_matches(file_name, '\.(mkv|mp3|rar|nzb)$') AND NOT contains(file_name, '.part1.')),
        every AS MATERIALIZED (
          SELECT release_id, ord, CASE WHEN media THEN 'media_filename' ELSE 'package_filename' END AS source, CASE WHEN media THEN 0.88::DOUBLE ELSE 0.9::DOUBLE END AS confidence, source_title, {_style('raw')} AS style, {_shown('raw')} AS title FROM f1 WHERE {_readable(_shown('raw'))}
          UNION ALL SELECT b.release_id, -1, best.source, best.confidence, r.source_title, best.style, best.title FROM given_best b JOIN r ON r.release_id = b.release_id),
        {_fold("every")},
        t AS MATERIALIZED (
          SELECT r.*, b.best, {_obscure('source_title', True)} AS dim, {_readable('source_title')} AS clear, {_norm('source_title')} AS plain, trim(regexp_replace(r.stem, '[._\-\s]+', ' ', 'g')) AS human FROM r LEFT JOIN every_best b ON b.release_id = r.release_id),
        u AS (
          SELECT *, best IS NOT NULL AND NOT (source_title <> '' AND clear AND NOT dim AND plain NOT IN ('vip', 'vip only', 'private', 'private release', 'exclusive', 'unknown') AND NOT {_alike('best.title', 'source_title')})
                 AND (best.confidence >= 0.82::DOUBLE OR best.confidence >= 0.7::DOUBLE AND (source_title = '' OR dim OR NOT clear)) AND {_norm('best.title')} <> {_norm(_shown('source_title'))} AS adopted,
                 stem <> '' AND CASE WHEN source_title = '' THEN {_readable('stem')} ELSE (plain = '' OR regexp_matches(replace(plain, ' ', ''), '^[a-f0-9]{{8,}}$') OR dim) AND {_readable('human')} AND {_norm('human')} <> plain END AS by_stem
          FROM t)
        SELECT release_id, CASE WHEN adopted THEN best.title WHEN by_stem THEN {_shown(_style('stem'))} WHEN source_title <> '' AND {_readable(_shown('source_title'))} THEN {_shown('source_title')} ELSE '' END AS title,
               CASE WHEN adopted THEN best.style WHEN by_stem THEN {_style('stem')} WHEN source_title <> '' AND {_readable(_shown('source_title'))} THEN {_style('source_title')} ELSE '' END AS release_style,
               CASE WHEN adopted THEN best.source WHEN by_stem THEN 'deobfuscated' WHEN source_title <> '' AND {_readable(_shown('source_title'))} THEN 'source' WHEN source_title <> '' THEN 'source_obfuscated' ELSE 'fallback' END AS title_source,
               CASE WHEN adopted THEN best.confidence WHEN by_stem THEN 0.68::DOUBLE WHEN source_title <> '' AND {_readable(_shown('source_title'))} THEN 0.55::DOUBLE WHEN source_title <> '' THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS title_confidence
        FROM u""",
}
