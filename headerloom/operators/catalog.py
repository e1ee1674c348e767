"""Catalog reads: search, listing orders, visibility, federated merge, newsgroups, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.functions.text import composite_id

#: Listing orders by name; nulls are placed explicitly.
SORTS = {
    "newest": [F.desc_nulls_last, "posted_at"], "oldest": [F.asc_nulls_last, "posted_at"], "largest": [F.desc_nulls_last, "size_bytes"],
    "smallest": [F.asc_nulls_last, "size_bytes"], "title": [F.asc_nulls_last, "title"], "completion": [F.desc_nulls_last, "completion"], "quality": [F.desc_nulls_last, "quality"],
}


def search(releases: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Releases whose search title contains the query (case ignored), newest first, nulls last; a blank query finds none."""
    if not query.strip():
        return releases.limit(0)
    plain = query.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return releases.where(F.col("search_title").ilike(f"%{plain}%")).orderBy(F.desc_nulls_last("posted_at"), "title", "release_id").limit(limit)


def listing(releases: DataFrame, sort: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the releases in the named order, ties by release_id."""
    order, column = SORTS[sort]
    return releases.orderBy(order(column), "release_id").offset(offset).limit(limit)


def visible(releases: DataFrame, least_completion: float = 0.9, hide_passworded: bool = True) -> DataFrame:
    """Releases that may be shown: clear title, files, complete enough payload, and policy switches."""
    title = F.lower(F.trim("title"))
    clear = (F.length(title) >= 4) & title.rlike("[a-z]{3,}") & ~title.rlike("^[a-z0-9]{12,}$") & ~title.rlike(r"^(unknown|untitled|n/a)$")
    payload = (F.col("expected_archive_files") > 0) & (F.greatest(F.col("file_count") - F.col("par_file_count"), F.lit(0)) >= F.col("expected_archive_files"))
    shown = clear & payload & (F.col("size_bytes") > 0) & (F.col("completion") >= least_completion)
    if hide_passworded:
        shown = shown & ~F.coalesce("passworded", F.lit(False))
    return releases.where(shown)


def federated_merge(cached: DataFrame, *remote: DataFrame) -> DataFrame:
    """Results of all sources, one row per composite id: a remote row overwrites the cached one, presence in the cache is kept.

    Rows: source, guid, title, size_bytes. Among remote rows the one of the later source in the call wins.
    """
    rows = cached.select("source", "guid", "title", "size_bytes", F.lit(0).alias("__at"))
    for n, one in enumerate(remote, 1):
        rows = rows.unionByName(one.select("source", "guid", "title", "size_bytes", F.lit(n).alias("__at")))
    rows = rows.withColumn("release_id", composite_id(F.col("source"), F.col("guid")))
    best = F.max_by(F.struct("title", "size_bytes"), F.struct("__at", "title", "size_bytes")).alias("w")
    return rows.groupBy("release_id").agg(best, F.bool_or(F.col("__at") == 0).alias("cache_present"), F.count("*").alias("sources")).select("release_id", "w.*", "cache_present", "sources")


def newsgroups(own: DataFrame, crossposts: DataFrame) -> DataFrame:
    """release_id, group_name: a release's groups with those that its articles were also posted to, each once."""
    return own.select("release_id", "group_name").unionByName(crossposts.select("release_id", "group_name")).where("group_name is not null and trim(group_name) <> ''").distinct()


def export_segments(parts: DataFrame) -> DataFrame:
    """Per file: its segments in part order as one text of ``bytes:number:message`` lines, with count and bytes."""
    line = F.concat_ws(":", F.col("bytes").cast("string"), F.col("part_number").cast("string"), "message_id")
    found = parts.groupBy("release_id", "file_name").agg(F.array_sort(F.collect_list(F.struct("part_number", line.alias("line")))).alias("s"), F.sum("bytes").alias("file_bytes"))
    return found.select("release_id", "file_name", F.size("s").cast("long").alias("segment_count"), "file_bytes", F.array_join("s.line", "\n").alias("segments"))
