"""What titles and article bodies say: tags, scores against external titles, yEnc header lines. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headerloom.functions.matching import canonical_key
from headerloom.functions.text import normalize_key
from headerloom.operators.enrich import token_similarity

# The words of the tags, the first that matches first.
RESOLUTIONS = ["2160p", "1080p", "720p", "576p", "480p"]
VIDEO_CODECS = ["x265", "hevc", "av1", "x264", "h264", "xvid"]
AUDIO_CODECS = ["truehd", "dts", "eac3", "ac3", "aac", "flac", "mp3"]


def tags(title: Column) -> dict[str, Column]:
    """resolution, video_codec, audio_codec, year, season, episode of a title; null where it says nothing."""
    key = F.concat(F.lit(" "), normalize_key(F.coalesce(title, F.lit(""))), F.lit(" "))
    word = lambda words: F.nullif(F.regexp_extract(key, f" ({'|'.join(words)}) ", 1), F.lit(""))
    number = lambda pattern: F.nullif(F.regexp_extract(key, pattern, 1), F.lit("")).cast("int")
    return {
        "resolution": word(RESOLUTIONS), "video_codec": word(VIDEO_CODECS), "audio_codec": word(AUDIO_CODECS), "year": number(r" (19[5-9]\d|20\d\d) "),
        "season": F.coalesce(number(r" s(\d{1,2})e\d{1,3} "), number(r" (\d{1,2})x\d{1,3} ")), "episode": F.coalesce(number(r" s\d{1,2}e(\d{1,3}) "), number(r" \d{1,2}x(\d{1,3}) ")),
    }


def clamped(score: Column, most: float = 1.0) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(most), score)), 4)


def _year_points(a: Column, b: Column, same: float, near: float, other: float) -> Column:
    return F.coalesce(F.when(a == b, same).when(F.abs(a - b) == 1, near).when(a != b, other), F.lit(0.0))


def _both(a: Column, b: Column, points: float) -> Column:
    return F.coalesce(F.when(a == b, points), F.lit(0.0))


def scene_title_score(title: Column, entry_title: Column, hours: Column) -> Column:
    """0 to 1: a release's title against an external scene title, with the hours between their postings (null: unknown)."""
    a, b, x, y = normalize_key(F.coalesce(title, F.lit(""))), normalize_key(F.coalesce(entry_title, F.lit(""))), tags(title), tags(entry_title)
    ca, cb = canonical_key(a), canonical_key(b)
    prefix = lambda p, q, points: F.when((p != "") & (q != "") & (p.startswith(q) | q.startswith(p)), points).otherwise(0.0)
    tv = F.coalesce(F.when((x["season"] == y["season"]) & (x["episode"] == y["episode"]), 0.18).when(x["season"].isNotNull() & y["season"].isNotNull(), -0.10), F.lit(0.0))
    late = F.coalesce(F.when(hours <= 72, 0.08).when(hours <= 720, 0.04).when(hours > 8760, -0.08), F.lit(0.0))
    score = F.lit(0.25) + 0.45 * token_similarity(a, b) + prefix(a, b, 0.22) + 0.20 * token_similarity(ca, cb) + prefix(ca, cb, 0.12) + tv + _year_points(x["year"], y["year"], 0.10, 0.04, -0.04)
    return clamped(score + _both(x["resolution"], y["resolution"], 0.04) + _both(x["video_codec"], y["video_codec"], 0.03) + _both(x["audio_codec"], y["audio_codec"], 0.02) + late)


def external_title_score(title: Column, names: list[Column], year: Column, external_year: Column, is_tv: Column, external_is_tv: Column) -> Column:
    """0 to 1: a title against the names of one external work, their years and media types; null evidence weighs nothing."""
    a = normalize_key(F.coalesce(title, F.lit("")))
    keys = [normalize_key(F.coalesce(n, F.lit(""))) for n in names]
    best = F.greatest(*[token_similarity(a, k) for k in keys]) if len(keys) > 1 else token_similarity(a, keys[0])
    exact = F.when((a != "") & a.isin(*keys), 0.12).otherwise(0.0)
    media = F.coalesce(F.when(is_tv & external_is_tv, 0.08).when(is_tv != external_is_tv, -0.10), F.lit(0.0))
    return clamped(F.lit(0.35) + 0.55 * best + exact + _year_points(year, external_year, 0.10, 0.04, -0.06) + media)


def yenc_header(body: Column) -> dict[str, Column]:
    """part_number, total_parts, file_size, file_name, part_offset, part_end of a body's ``=ybegin`` and ``=ypart`` lines; null without them.

    The name is the rest of its line, spaces included; the offset counts from 0.
    """
    begin, part = F.regexp_extract(body, r"(?m)^(=ybegin [^\r\n]*)", 1), F.regexp_extract(body, r"(?m)^=ybegin [^\r\n]*\r?\n(=ypart [^\r\n]*)", 1)
    number = lambda line, name: F.nullif(F.regexp_extract(line, rf" {name}=(\d{{1,18}})", 1), F.lit("")).cast("long")
    bare = F.regexp_replace(begin, r" name=.*$", "")
    return {
        "part_number": number(bare, "part").cast("int"), "total_parts": number(bare, "total").cast("int"), "file_size": number(bare, "size"),
        "file_name": F.nullif(F.trim(F.regexp_extract(begin, r" name=(.*)$", 1)), F.lit("")), "part_offset": number(part, "begin") - 1, "part_end": number(part, "end"),
    }
