"""Release titles from what their files, archives and texts are called: candidates, the best of them, when it is adopted, and what else stands in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerloom.functions import names
from headerloom.functions.text import apart, bound, search_title

# Words of media names, titles that say nothing, suffixes, and how sure each source is.
RESOLUTION, VIDEO = r"\b(2160p|1080p|720p|576p|480p)\b", r"\b(x265|h265|hevc|av1|x264|h264|xvid)\b"
AUDIO, ORIGIN = r"\b(truehd|atmos|dts[- ]?hd|dts|ddp|eac3|ac3|aac|flac|mp3)\b", r"\b(remux|bluray|bdrip|webrip|web[- ]?dl|hdtv|dvdrip|cam)\b"
HEX, OPAQUE, NUMBERED = r"^[a-f0-9]{8,}$", r"^[a-z0-9]{12,}$", r"^\d{5,}\s+[a-z](\s+[a-z]{2,4})?$"
WEAK_TITLES = ["vip", "vip only", "private", "private release", "exclusive", "unknown"]
MEDIA, PACKAGE = r"\.(mkv|mp4|avi|ts|flac|mp3|m4a)$", r"\.(rar|zip|7z|nzb)$"
PART = r"\.part\d+\.rar$|\.r\d{2,3}$|\.(7z|zip)\.\d{3}$"
FROM_MEDIA, FROM_PACKAGE, FROM_STEM, FROM_SOURCE, OBSCURE = 0.88, 0.90, 0.68, 0.55, 0.30
ADOPT, ADOPT_OBSCURE = 0.82, 0.70
_SEMANTIC = "|".join([RESOLUTION, VIDEO, AUDIO, ORIGIN])


def displayed(text: Column) -> Column:
    return names.spaced(F.translate(F.trim(text), "_.", "  "))


def styled(text: Column) -> Column:
    """A title as releases write it: dots for spaces and slashes."""
    dotted = F.translate(F.trim(text), "\\/_ ", "....")
    return F.regexp_replace(F.when(dotted.contains(".."), F.regexp_replace(dotted, r"\.+", ".")).otherwise(dotted), r"^\.|\.$", "")


def stem_of(name: Column) -> Column:
    """A name in lower case without volume and suffix, separators as spaces."""
    low = F.lower(F.trim(name))
    cut = (
        F.when(low.rlike(r"\.vol\d+\+\d+(\.par2)?$"), F.regexp_replace(low, r"\.vol\d+\+\d+(\.par2)?$", "")).when(low.endswith(".par2"), F.regexp_replace(low, r"\.par2$", ""))
        .when(low.rlike(r"\.part\d+\.rar$|\.r\d{2,3}$"), F.regexp_replace(low, r"\.part\d+\.rar$|\.r\d{2,3}$", "")).otherwise(F.regexp_replace(low, r"\.[^./]*$", ""))
    )
    return names.spaced(F.regexp_replace(cut, r"[._\-]+", " "))


def _obscure(key: Column, core: Column) -> Column:
    words = F.split(core, " ")
    # The words are looked at only if the first may be long, and media names are looked for last.
    long = core.rlike("^[a-z0-9]{12}") & words[0].rlike(OPAQUE)
    digit = core.between("0", "g")  # begins like hexadecimal digits, or a bit beside them
    return (core != "") & ((digit & F.replace(core, F.lit(" "), F.lit("")).rlike(HEX)) | (long & ((F.size(words) == 1) | ((F.size(words) <= 2) & ~key.rlike(_SEMANTIC)))))


def _told(key: Column) -> Column:
    return (key != "") & (key.contains(" ") | key.rlike(_SEMANTIC))


def read(rows: DataFrame, title: str, whole: bool = True) -> DataFrame:
    """rows with how a title reads, step by step: title_key (for searches), title_obscure, title_readable.

    Obscure: hexadecimal digits, one long token, or two words at most of which the first is one, and none of media names; ``whole``: by the title's stem, where it has
    one. Readable: not obscure and of two words, or one of media names.
    """
    key, cut, obscure = f"{title}_key", f"{title}_cut", f"{title}_obscure"
    rows = rows.withColumn(key, apart(search_title(F.col(title))))
    core = F.col(key)
    if whole:
        # Without a dot nothing is cut, and the stem's key is the title's.
        rows = rows.withColumn(cut, F.when(F.col(title).contains("."), names.filled(search_title(stem_of(F.col(title))))))
        core = F.coalesce(cut, key)
    rows = rows.withColumn(obscure, apart(_obscure(F.col(key), core)))
    told = _told(F.col(key)) & ~F.col(obscure)
    return rows.withColumn(f"{title}_readable", told & ~(F.col(key).between("0", ":") & F.col(key).rlike(NUMBERED)) if whole else told).drop(cut)


def alike(one: Column, other: Column) -> Column:
    """Whether 0.6 of the words of the shorter of two titles, as their keys, are the other's."""
    x, y = F.split(one, " "), F.split(other, " ")
    return (one != "") & (other != "") & ((one == other) | (F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.least(F.size(x), F.size(y)) >= 0.6))


def located(rows: DataFrame, path: Column) -> DataFrame:
    """rows with a path's ``clean`` form and its ``base`` name, each worked out once."""
    slashed = F.translate(F.trim(path), "\\", "/")
    return rows.withColumn("clean", F.when(slashed.contains("/"), F.regexp_replace(slashed, "/+$", "")).otherwise(slashed)).withColumn("base", F.substring_index("clean", "/", -1))


def path_stem(clean: Column, base: Column) -> Column:
    """A file's name without suffix, or its folder's if the name is all suffix; blank for samples."""
    folder = F.regexp_extract(clean, r"([^/]+)/+[^/]*$", 1)
    bare = lambda x: F.trim(F.regexp_replace(x, r"\.[^./]*$", ""))
    return F.when(F.lower(clean).contains("/sample/") | F.lower(base).contains("sample"), "").otherwise(F.coalesce(names.filled(bare(base)), F.when(folder != ".", bare(folder)), F.lit("")))


def package_stem(base: Column) -> Column:
    """An archive's or document's name without suffix; blank if it is one of several parts, or none of these."""
    return F.when(F.lower(base).rlike(PACKAGE) & ~F.lower(base).rlike(PART), F.regexp_replace(F.regexp_replace(base, r"\.[^./]*$", ""), r"^[ ._-]+|[ ._-]+$", "")).otherwise("")


def telling_line(text: Column) -> Column:
    """The first readable line of a text, of 140 bytes at most, that names a resolution, origin, codec, season or year; null without one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[-_=*#\[\]()\s]+|[-_=*#\[\]()\s]+$", ""))
    tells = lambda x: F.lower(x).rlike("|".join([RESOLUTION, ORIGIN, VIDEO, r"s0", r"\b(19|20)\d{2}\b"]))
    some = F.filter(lines, lambda x: (x != "") & (F.octet_length(x) <= 140) & tells(x))
    keyed = F.transform(some, lambda x: F.struct(x.alias("line"), search_title(x).alias("key")))
    return F.try_element_at(F.filter(keyed, lambda x: _told(x["key"]) & ~_obscure(x["key"], x["key"])), F.lit(1))["line"]


def _candidates(rows: DataFrame, whole: bool) -> DataFrame:
    """rows (release_id, ord, source, confidence, raw) as release_id, whole, confidence, x (ord, style, title, title_key, source, confidence), as far as the raw name can be read."""
    rows = read(rows.withColumn("title", displayed(F.col("raw"))), "title", whole)
    style = styled(F.when(F.col("source") == "media_title", F.col("title")).otherwise(F.col("raw")))
    one = F.struct(F.col("ord").cast("long").alias("ord"), style.alias("style"), "title", "title_key", "source", "confidence")
    # Unfolded from a list, not filtered: a filter would be pushed below the readings and work each of them out again.
    some = rows.select("release_id", F.explode_outer(F.when(F.col("title_readable"), F.array(one))).alias("x")).where("x.style <> ''")
    return some.select("release_id", F.lit(whole).alias("whole"), "x.confidence", "x")


def _surest(candidates: DataFrame) -> DataFrame:
    """release_id, given, called: the different candidates of the greatest confidence of each release, by what was found in files, and by files' names. One shuffle, by release."""
    order = Window.partitionBy("release_id", "whole").orderBy(F.desc("confidence"))
    rows = candidates.repartition("release_id").withColumn("place", F.rank().over(order)).where("place = 1")
    keys = ["style", "title", "title_key", "source", "confidence"]
    rows = rows.groupBy("release_id", "whole", *[F.col(f"x.{k}").alias(k) for k in keys]).agg(F.min("x.ord").alias("ord"))
    some = lambda whole: F.collect_list(F.when(F.col("whole") == whole, F.struct("ord", *keys)))
    return rows.groupBy("release_id").agg(some(False).alias("given"), some(True).alias("called"))


def _folded(some: Column, source_key: Column) -> Column:
    """The best of a list of equally sure candidates, null of none. In their order (``ord``) a later one wins that is like the source title where the best so far is not, or that is longer."""
    keys = ["ord", "style", "title", "title_key", "source", "confidence"]
    like = lambda x: alike(x["title_key"], source_key).alias("like")
    listed = F.array_sort(F.transform(some, lambda x: F.struct(x["ord"].alias("ord"), like(x), F.octet_length(x["title_key"]).alias("long"), *[x[k].alias(k) for k in keys[1:]])))
    later = lambda best, x: F.when((x["like"] & ~best["like"]) | (x["long"] > best["long"]), x).otherwise(best)
    best = bound(listed, lambda all_: F.reduce(F.slice(all_, 2, F.size(all_)), F.get(all_, F.lit(0)), later))
    return F.when(F.size(some) > 1, bound(best, lambda x: F.struct(*[x[k].alias(k) for k in keys]))).otherwise(F.get(some, F.lit(0)))


def release_titles(releases: DataFrame, files: DataFrame, inspected: DataFrame) -> DataFrame:
    """release_id, title, release_style, title_source, title_confidence of every release.

    releases: release_id, source_title, stem (of its files); files: release_id, ord, file_name; inspected: release_id, ord, source
    (media_title, archive_entry or nfo; others say nothing), value, confidence. Media files and whole packages name a release, parts and samples do not. The best of
    these is adopted unless a source title that is readable and says something is of other words, and if it is sure enough, for obscure source titles less so. Else the stem stands in for
    an obscure source title, else the source title if it can be read. Nulls are blank.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    about = releases.select("release_id", F.trim(blank("source_title")).alias("source_title"), F.trim(blank("stem")).alias("stem"))
    about = about.withColumns({"shown": displayed(F.col("source_title")), "human": names.spaced(F.regexp_replace("stem", r"[._\-]+", " ")), "stem_style": styled(F.col("stem"))})
    for title in ("source_title", "shown", "stem", "human"):
        about = read(about, title)

    kind, value = F.col("source"), F.col("value")
    found = inspected.select("release_id", "ord", F.trim("source").alias("source"), F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), blank("value").alias("value"))
    found = located(found, F.when(kind == "archive_entry", value))
    raw = F.when(kind == "media_title", F.when(F.octet_length(F.trim(value)) <= 180, F.trim(value))).when(kind == "archive_entry", path_stem(F.col("clean"), F.col("base"))).when(kind == "nfo", telling_line(value))
    given = _candidates(found.select("release_id", "ord", "source", "confidence", apart(raw).alias("raw")), False)
    named = files.select("release_id", "ord", F.trim(blank("file_name")).alias("name")).withColumn("low", F.lower("name")).withColumn("media", F.col("low").rlike(MEDIA))
    named, media = located(named, F.col("name")), F.col("media")
    raw = F.when(F.col("low").contains("sample"), "").when(media, path_stem(F.col("clean"), F.col("base"))).otherwise(package_stem(F.col("base")))
    called = _candidates(named.select("release_id", "ord", F.when(media, "media_filename").otherwise("package_filename").alias("source"), F.when(media, FROM_MEDIA).otherwise(FROM_PACKAGE).alias("confidence"), apart(raw).alias("raw")), True)
    rows = about.join(_surest(given.unionByName(called)), "release_id", "left")
    # The best of what was found stands before the names of files, where it is at least as sure.
    rows = rows.withColumn("best", _folded(F.col("given"), F.col("source_title_key")))
    sure, least = F.col("best.confidence"), F.get("called", F.lit(0))["confidence"]
    first = F.struct(F.lit(-1).cast("long").alias("ord"), *[F.col(f"best.{k}").alias(k) for k in ("style", "title", "title_key", "source", "confidence")])
    some = F.when(sure.isNull() | (sure < least), F.col("called")).when(sure == least, F.concat(F.array(first), F.col("called"))).otherwise(F.array(first))
    rows = rows.withColumn("some", some).withColumn("best", _folded(F.col("some"), F.col("source_title_key")))

    source, key, obscure, clear = F.col("source_title"), F.col("source_title_key"), F.col("source_title_obscure"), F.col("source_title_readable")
    told = (source != "") & clear & ~obscure & ~key.isin(WEAK_TITLES)
    sure = (F.col("best.confidence") >= ADOPT) | ((F.col("best.confidence") >= ADOPT_OBSCURE) & ((source == "") | obscure | ~clear))
    adopted = F.col("best").isNotNull() & ~(told & ~alike(F.col("best.title_key"), key)) & sure & (F.col("best.title_key") != F.col("shown_key"))
    nothing = (key == "") | F.replace(key, F.lit(" "), F.lit("")).rlike(HEX) | obscure
    by_stem = F.when(source == "", F.col("stem_readable")).otherwise(nothing & F.col("human_readable") & (F.col("human_key") != key)) & (F.col("stem_style") != "")
    result = lambda title, style, kind, value: F.struct(title.alias("title"), style.alias("release_style"), kind.alias("title_source"), value.alias("title_confidence"))
    empty, lit = F.lit(""), F.lit
    out = (
        F.when(F.coalesce(adopted, lit(False)), result(F.col("best.title"), F.col("best.style"), F.col("best.source"), F.col("best.confidence")))
        .when(by_stem, result(displayed(F.col("stem_style")), F.col("stem_style"), lit("deobfuscated"), lit(FROM_STEM)))
        .when((source != "") & F.col("shown_readable"), result(F.col("shown"), styled(source), lit("source"), lit(FROM_SOURCE)))
        .when(source != "", result(empty, empty, lit("source_obfuscated"), lit(OBSCURE))).otherwise(result(empty, empty, lit("fallback"), lit(0.0)))
    )
    return rows.select("release_id", out.alias("o")).select("release_id", "o.*")
