"""NZB documents, result feeds and pages of scene names as rows, and rows as NZB documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEGMENT = "struct<_bytes: bigint, _number: int, _VALUE: string>"
NZB = f"head struct<meta: array<struct<_type: string, _VALUE: string>>>, file array<struct<_poster: string, _date: bigint, _subject: string, groups: struct<group: array<string>>, segments: struct<segment: array<{_SEGMENT}>>>>"
_ATTR = "array<struct<_name: string, _value: string>>"
FEED = f"channel struct<title: string, item: array<struct<title: string, guid: string, link: string, pubDate: string, size: bigint, category: array<string>, enclosure: struct<_url: string, _length: bigint>, attr: {_ATTR}>>>"
PAGE = "status string, data struct<rowCount: bigint, rows: array<struct<id: bigint, name: string, team: string, cat: string, preAt: bigint, size: double>>>"


def escaped(text: Column) -> Column:
    """Text as it may stand in an XML document: marks as references, control characters left out."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def nzb_documents(segments: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """release_id, nzb: one document a release, its files by subject, groups sorted, one segment a part, the largest, then the lesser message id.

    segments: release_id, group_name, file_subject, poster, posted_epoch, part_number, bytes, message_id; titles: release_id, title.
    Segments are put together by file before files are by release.
    """
    keys = ["release_id", "file_subject"]
    identity = F.regexp_replace("message_id", "^<|>$", "")
    best = segments.where("trim(message_id) <> '' and part_number > 0").groupBy(*keys, "part_number").agg(
        F.min(F.struct(F.col("bytes").isNull(), -F.col("bytes"), identity.alias("id"), "bytes")).alias("s"),
        F.min("poster").alias("poster"), F.min("posted_epoch").alias("at"), F.collect_set("group_name").alias("groups"),
    )
    line = F.concat(F.lit('<segment bytes="'), F.col("s.bytes").cast("string"), F.lit('" number="'), F.col("part_number").cast("string"), F.lit('">'), escaped(F.col("s.id")), F.lit("</segment>"))
    one = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part_number", line.alias("line")))).alias("lines"), F.min("poster").alias("poster"), F.min("at").alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups"))
    groups = F.array_join(F.transform("groups", lambda g: F.concat(F.lit("<group>"), escaped(g), F.lit("</group>"))), "")
    file = F.concat(
        F.lit('<file poster="'), escaped(F.col("poster")), F.lit('" date="'), F.coalesce(F.col("at"), F.lit(0)).cast("string"), F.lit('" subject="'), escaped(F.col("file_subject")), F.lit('"><groups>'), groups, F.lit("</groups><segments>"),
        F.array_join("lines.line", ""), F.lit("</segments></file>"),
    )
    whole = one.groupBy("release_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("file_subject", file.alias("file")))).getField("file"), "").alias("files"))
    if titles is not None:
        whole = whole.join(titles, "release_id", "left")
    meta = F.when(F.col("title").isNotNull(), F.concat(F.lit('<head><meta type="title">'), escaped(F.col("title")), F.lit("</meta></head>"))).otherwise("") if titles is not None else F.lit("")
    return whole.select("release_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><nzb xmlns="http://www.newzbin.com/DTD/2003/nzb">'), meta, F.col("files"), F.lit("</nzb>")).alias("nzb"))


def release_documents(releases: DataFrame, files: DataFrame, articles: DataFrame, groups: DataFrame) -> DataFrame:
    """release_id, nzb: the document of each release that has a newsgroup and a file with segments, files by file_id.

    releases: release_id, title, poster, published_epoch; files: release_id, file_id, subject, file_name, poster, posted_epoch, group_name;
    articles: file_id, part_number, bytes, message_id, posted_at, article_number, article_id; groups: release_id, group_name.
    A part's segment is its earliest article, then that of the smallest number, then id; one without a message id is left out. A file without a subject
    has its name, then the release's title; without a poster the release's, then ``unknown``; without a time the release's; without a group of its own all
    of the release's, sorted. Articles are put together by file before files are by release, so only a file's own segments meet in one row first.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = F.struct("posted_at", "article_number", "article_id", "message_id", "bytes")
    parts = articles.groupBy("file_id", "part_number").agg(F.min(first).alias("s")).withColumn("id", F.trim("s.message_id")).where("id <> ''")
    line = F.concat(F.lit('<segment bytes="'), F.coalesce(F.col("s.bytes"), F.lit(0)).cast("string"), F.lit('" number="'), F.col("part_number").cast("string"), F.lit('">'), escaped(F.col("id")), F.lit("</segment>"))
    segments = parts.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("part_number", line.alias("line")))).getField("line"), "").alias("segments"))
    named = groups.select("release_id", F.trim("group_name").alias("name")).where("name <> ''").groupBy("release_id").agg(F.array_sort(F.collect_set("name")).alias("all_groups"))
    about = releases.select("release_id", F.col("title").alias("r_title"), F.col("poster").alias("r_poster"), "published_epoch").join(named, "release_id")
    rows = files.join(segments, "file_id").join(about, "release_id")
    own = blank("group_name")
    of_file = F.transform(F.when(own.isNotNull(), F.array(own)).otherwise(F.col("all_groups")), lambda g: F.concat(F.lit("<group>"), escaped(g), F.lit("</group>")))
    file = F.concat(
        F.lit('<file poster="'), escaped(F.coalesce(blank("poster"), F.nullif("r_poster", F.lit("")), F.lit("unknown"))), F.lit('" date="'), F.coalesce("posted_epoch", "published_epoch", F.lit(0)).cast("string"),
        F.lit('" subject="'), escaped(F.coalesce(blank("subject"), blank("file_name"), F.col("r_title"))), F.lit('"><groups>'), F.array_join(of_file, ""), F.lit("</groups><segments>"), F.col("segments"), F.lit("</segments></file>"),
    )
    whole = rows.groupBy("release_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("file_id", file.alias("file")))).getField("file"), "").alias("files"))
    return whole.select("release_id", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><nzb xmlns="http://www.newzbin.com/DTD/2003/nzb">'), "files", F.lit("</nzb>")).alias("nzb"))


def nzb_segments(documents: DataFrame, text: str = "nzb") -> DataFrame:
    """The other columns of documents with title, subject, poster, posted_epoch, groups, number, bytes, message_id of every segment; files without segments have none."""
    rest = [c for c in documents.columns if c != text]
    rows = documents.select(*rest, F.from_xml(F.col(text), NZB).alias("x"))
    title = F.get(F.filter("x.head.meta", lambda m: m["_type"] == "title"), F.lit(0))["_VALUE"]
    files = rows.select(*rest, title.alias("title"), F.explode("x.file").alias("f"))
    parts = files.select(*rest, "title", F.col("f._subject").alias("subject"), F.col("f._poster").alias("poster"), F.col("f._date").alias("posted_epoch"), F.col("f.groups.group").alias("groups"), F.explode("f.segments.segment").alias("s"))
    return parts.select(*rest, "title", "subject", "poster", "posted_epoch", "groups", F.col("s._number").alias("number"), F.col("s._bytes").alias("bytes"), F.trim("s._VALUE").alias("message_id"))


def feed_releases(feeds: DataFrame, text: str = "feed") -> DataFrame:
    """The other columns of feeds with guid, title, link, published, size, category of every item; the size is the item's, else the attribute's, else the enclosure's.

    Attributes may stand in a namespace (``newznab:attr``) or in none.
    """
    rest = [c for c in feeds.columns if c != text]
    items = feeds.select(*rest, F.explode(F.from_xml(F.col(text), FEED, {"ignoreNamespace": "true"})["channel"]["item"]).alias("i"))
    attr = lambda name: F.get(F.filter("i.attr", lambda a: a["_name"] == name), F.lit(0))["_value"]
    size = F.coalesce(F.nullif("i.size", F.lit(0).cast("long")), F.nullif(attr("size").cast("long"), F.lit(0).cast("long")), F.col("i.enclosure._length"), F.lit(0))
    return items.select(*rest, F.coalesce(F.nullif("i.guid", F.lit("")), F.col("i.link")).alias("guid"), F.trim("i.title").alias("title"), F.coalesce("i.enclosure._url", "i.link").alias("link"), F.col("i.pubDate").alias("published"), size.alias("size"), F.coalesce(attr("category"), F.get("i.category", F.lit(0))).alias("category"))


def scene_pages(pages: DataFrame, text: str = "page") -> DataFrame:
    """The other columns of pages with id, name, team, category, posted_at, kilobytes of every row; pages that failed have none."""
    rest = [c for c in pages.columns if c != text]
    rows = pages.select(*rest, F.from_json(F.col(text), PAGE).alias("p")).where("p.status = 'success'").select(*rest, F.explode("p.data.rows").alias("r"))
    return rows.where("trim(r.name) <> ''").select(*rest, "r.id", F.trim("r.name").alias("name"), "r.team", F.col("r.cat").alias("category"), F.timestamp_seconds("r.preAt").cast("timestamp_ntz").alias("posted_at"), F.col("r.size").alias("kilobytes"))
