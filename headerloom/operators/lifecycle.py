"""From files to releases: keys, refined families, candidates and their order, the gate before a release is stored, titles, cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions of files that make a release by themselves, and buckets of families.
STANDALONE = ["mkv", "mp4", "avi", "mov", "mp3", "flac", "m4a", "wav"]
WEAK_KINDS = ["contextual_obfuscated", "numeric_obfuscated_set", "opaque_set"]
_PROMOTABLE = r"\.(part\d+\.rar|rar|r\d{2}|7z|7z\.\d+|zip|zip\.\d+|par2|nfo|sfv|mkv|mp4|avi|mov|mp3|flac|m4a|wav)$"


def has_promotable_name(file_name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(file_name, F.lit("")))).rlike(_PROMOTABLE)


def blanked_keys(identities: DataFrame) -> DataFrame:
    """identities with blank family_key, file_set_key and base_stem where a weak or provisional family has no file name that could make it a release."""
    weak = F.col("kind").isin(WEAK_KINDS) & F.lower(F.trim("strength")).isin("weak", "provisional") & ~has_promotable_name(F.col("file_name"))
    return identities.withColumns({c: F.when(weak, "").otherwise(F.col(c)) for c in ("family_key", "file_set_key", "base_stem")})


def assembled(headers: DataFrame, identity: tuple[str, ...] = ("file_name", "kind")) -> tuple[DataFrame, DataFrame]:
    """(files, parts) of matched headers: one file per (group_id, binary_key) with the identity of its surest header, and its parts.

    headers: header_id, group_id, binary_key, confidence, file_name, part_number, total_parts, bytes and the columns of ``identity``. A file's id is a hash of its key.
    """
    keyed = headers.where("trim(binary_key) <> ''").withColumn("binary_id", F.xxhash64("group_id", "binary_key"))
    order = F.struct("confidence", (-F.col("header_id")).alias("h"), "file_name")
    files = keyed.groupBy("binary_id", "group_id", "binary_key").agg(F.max_by(F.struct("confidence", *identity), order).alias("w"), F.max("total_parts").alias("total_parts"), F.count("*").alias("headers"))
    return files.select("binary_id", "group_id", "binary_key", "w.*", "total_parts", "headers"), keyed.select("binary_id", "header_id", "part_number", "bytes")


def completion_keys(files: DataFrame) -> DataFrame:
    """group_id, name_key, binary_id, ratio of the files that still lack parts and have a name."""
    name = F.lower(F.trim(F.coalesce(F.nullif(F.trim("file_name"), F.lit("")), F.col("binary_name"), F.lit(""))))
    return files.where("total_parts > 0 and observed_parts < total_parts").select("group_id", name.alias("name_key"), "binary_id", (F.col("observed_parts") / F.col("total_parts")).alias("ratio")).where("name_key <> ''")


def hydrated(requests: DataFrame, headers: DataFrame, payloads: DataFrame, posters: DataFrame) -> DataFrame:
    """The requested headers with payload and poster, by their exact keys, in the order asked for; requests without a header are left out."""
    rows = requests.join(headers, ["day", "header_id"]).join(payloads, ["day", "header_id"], "left").join(posters, "poster_id", "left")
    return rows.orderBy("ord")


def standalone(kind: Column, confidence: Column, file_name: Column, stem: Column) -> Column:
    """Whether a single file may be a release: not contextual, sure, a media file, with a stem that says something."""
    extension = F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return (kind != "contextual_obfuscated") & (confidence >= 0.85) & extension.isin(STANDALONE) & ~F.coalesce(stem, F.lit("")).rlike("^[a-z0-9]{12,}$")


def bucket(summary: DataFrame) -> DataFrame:
    """summary with ``bucket``, by its counts, its dominant file and the standalone exception."""
    lone = (F.col("binaries") == 1) & (F.col("complete_main") == 1) & (F.col("expected_files") <= 0) & ~standalone(F.col("kind"), F.col("confidence"), F.col("file_name"), F.col("stem"))
    start = F.when(F.col("binaries") == 0, "stale_cleanup_only").when(lone, "weak_single_binary").when(F.col("complete_main") > 0, "actionable").otherwise("fragment_only")
    weak = (start == "actionable") & F.col("kind").isin("numeric_obfuscated_set", "opaque_set")
    return summary.withColumn("bucket", F.when(weak, "weak_obfuscated_set").otherwise(start))


def shapes(files: DataFrame) -> DataFrame:
    """Per family: whether all files are contextual, the most expected files, indexed files, files with a stem and distinct stems, usable names."""
    stem = F.nullif(F.trim("stem"), F.lit(""))
    return files.groupBy("family_key").agg(
        F.bool_and(F.col("kind") == "contextual_obfuscated").alias("all_contextual"), F.max("expected_files").alias("most_expected"), F.count_if(F.col("file_index") > 0).alias("indexed"),
        F.count(stem).alias("stem_files"), F.count_distinct(stem).alias("stems"), F.bool_or(has_promotable_name(F.col("file_name"))).alias("usable"),
        F.bool_or(~F.col("is_complete") & F.col("recoverable")).alias("may_recover"),
    )


def refined(summary: DataFrame, shape: DataFrame) -> DataFrame:
    """summary (family_key, name, binaries, bucket) with the final bucket and recover_pending, by the family's shape."""
    numeric = F.lower(F.trim("name")).rlike(r"^[0-9]{5,}(\s+[a-z](\s+[a-z]{2,4})?)?$")
    base = F.col("all_contextual") & (F.col("most_expected") > 1) & (F.col("indexed") >= 2)
    over = base & (F.col("stem_files") == F.col("stems")) & (F.col("stems") >= F.greatest(F.col("most_expected"), F.lit(8))) & (F.col("binaries") >= F.greatest(F.col("most_expected") * 3, F.lit(24)))
    prefer = base & (F.col("stem_files") >= 2) & (F.col("stems") < F.col("stem_files"))
    final = (
        F.when((F.col("bucket") == "fragment_only") & numeric & ~F.col("usable"), "weak_obfuscated_set").when((F.col("bucket") == "actionable") & over, "overgrouped_contextual")
        .when((F.col("bucket") == "actionable") & prefer, "prefer_base_stem").otherwise(F.col("bucket"))
    )
    pending = F.col("final").isin("fragment_only", "weak_single_binary", "weak_obfuscated_set", "overgrouped_contextual") & F.col("may_recover")
    return summary.join(shape, "family_key").withColumn("final", final).select("family_key", F.col("final").alias("bucket"), pending.alias("recover_pending"))


def candidates(summary: DataFrame, acks: DataFrame, limit: int) -> DataFrame:
    """The actionable families that changed since they were last worked on, in their declared order.

    Coverage (of archives if their number is known, else of files), complete main files, complete files, a known number,
    the kind of key, the oldest change, the key.
    """
    due = F.col("processed_at").isNull() | (F.col("updated_at") > F.col("processed_at"))
    coverage = F.when(F.col("expected_archives") > 0, F.col("archive_coverage")).otherwise(F.col("file_coverage"))
    kind = F.when(F.col("key_kind") == "recovered_file_set", 0).when(F.col("key_kind") == "base_stem", 1).otherwise(2)
    rows = summary.where("bucket = 'actionable'").join(acks, ["key_kind", "family_key"], "left").where(due)
    known = (F.col("expected_files") > 0) | (F.col("expected_archives") > 0)
    return rows.orderBy(F.desc(coverage), F.desc("complete_main"), F.desc("complete"), known.desc(), kind, F.asc_nulls_last("updated_at"), "family_key", "key_kind").limit(limit).select("key_kind", "family_key", coverage.alias("coverage"), "complete_main")


def dirty_windows(keys: DataFrame, hot: int, cold: int) -> DataFrame:
    """The next dirty families: up to ``hot`` of those actionable or without a summary, oldest first, then up to ``cold`` of the others."""
    lane = F.when(F.col("bucket").isNull() | (F.col("bucket") == "actionable"), "hot").otherwise("cold")
    rows = keys.groupBy("family_key").agg(F.min("dirty_at").alias("dirty_at"), F.max("bucket").alias("bucket")).withColumn("lane", lane)
    take = lambda name, n: rows.where(F.col("lane") == name).orderBy("dirty_at", "family_key").limit(n)
    return take("hot", hot).unionByName(take("cold", cold)).select("lane", "family_key", "dirty_at")


def persist_reason(c: dict[str, Column]) -> Column:
    """Why a cluster is not stored as a release, or null if it is.

    Columns by name: main, complete_main, expected_files, expected_archives, is_file_set, strong_title, usable_name, split_archives, weak_title, contextual, standalone, auxiliary_evidence.
    """
    unknown = (c["expected_files"] <= 0) & (c["expected_archives"] <= 0) & ~c["is_file_set"]
    weak = (unknown & (c["main"] > 1) & c["split_archives"] & ~c["strong_title"] & c["weak_title"]) | (unknown & c["contextual"] & ~c["standalone"]) | (~c["is_file_set"] & ~c["usable_name"] & c["weak_title"])
    return (
        F.when((c["main"] == 0) | (c["complete_main"] == 0), "no_main_payload")
        .when(((c["expected_files"] > 1) | (c["expected_archives"] > 1)) & (c["main"] < 2) & ~c["strong_title"] & ~c["usable_name"], "multi_file_single_main_payload")
        .when(weak, "contextual_weak").when((c["main"] == 1) & ~c["standalone"] & ~c["strong_title"] & ~c["auxiliary_evidence"], "single_main_payload")
    )


def looks_obfuscated(title: Column) -> Column:
    """A title of one opaque token, of hexadecimal digits, of digits only, or blank."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    return (t == "") | t.rlike("^[a-z0-9]{12,}$") | t.rlike("^[0-9a-f]{8,}$") | t.rlike(r"^[0-9\s._-]+$")


def looks_readable(title: Column) -> Column:
    """A title with two words of three letters or more, or one and a year, that is not obfuscated."""
    t = F.lower(F.coalesce(title, F.lit("")))
    words = F.regexp_count(t, F.lit(r"\p{L}{3,}"))
    return ~looks_obfuscated(title) & ((words >= 2) | ((words >= 1) & t.rlike(r"(^|[^0-9])(19[5-9]\d|20\d\d)([^0-9]|$)")))


def resolved_titles(titles: DataFrame) -> DataFrame:
    """Per release the best of its candidate titles: readable before not, then confidence, then the source in its order, then the longer, then the text.

    titles: release_id, source (inspection, predb, nfo, file or source), title, confidence. A source's own title is kept only if nothing better is readable.
    """
    rank = F.when(F.col("source") == "predb", 0).when(F.col("source") == "inspection", 1).when(F.col("source") == "nfo", 2).when(F.col("source") == "file", 3).otherwise(4)
    text = F.trim(F.regexp_replace(F.regexp_replace("title", r"[._]+", " "), r"\s+", " "))
    rows = titles.withColumn("title", text).where("title <> ''").withColumn("readable", looks_readable(F.col("title")))
    order = F.struct((~F.col("readable")).alias("a"), (-F.col("confidence")).alias("b"), rank.alias("c"), (-F.length("title")).alias("d"), F.col("title").alias("e"))
    best = rows.groupBy("release_id").agg(F.min_by(F.struct("title", "source", "confidence", "readable"), order).alias("w"), F.count("*").alias("candidates"))
    return best.select("release_id", "w.*", "candidates")


def catalog_files(files: DataFrame, binaries: DataFrame) -> DataFrame:
    """Per release and file: the most parts seen and expected and the surest match of its binaries."""
    rows = files.join(binaries, "binary_id", "left").groupBy("release_id", "file_name")
    return rows.agg(F.coalesce(F.max("observed_parts"), F.lit(0)).alias("article_count"), F.coalesce(F.max("total_parts"), F.lit(0)).alias("total_parts"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"))


def stale_releases(releases: DataFrame, kept: DataFrame) -> DataFrame:
    """Releases of a source key that was formed anew, under a group that the new forming does not hold; other keys are not touched."""
    again = kept.select("key_kind", "family_key").distinct()
    return releases.join(again, ["key_kind", "family_key"], "left_semi").join(kept, ["key_kind", "family_key", "group_name"], "left_anti")


def auxiliary_only_siblings(releases: DataFrame) -> DataFrame:
    """Releases without payload files that have a sibling of the same family with some."""
    some = releases.where("payload_files > 0").select("family_key").distinct()
    return releases.where("payload_files = 0").join(some, "family_key", "left_semi")


def export_candidates(ready: DataFrame, cached: DataFrame, archived: DataFrame, limit: int) -> DataFrame:
    """The newest ready releases that are neither cached nor archived."""
    return ready.join(cached, "release_id", "left_anti").join(archived.where("archive_status in ('archived', 'purge_pending', 'purged')"), "release_id", "left_anti").orderBy(F.desc_nulls_last("posted_at"), "release_id").limit(limit)


def raw_expired(headers: DataFrame, hours: dict[str, int], now, *keep: DataFrame) -> DataFrame:
    """Headers older than their tier's hours that none of the keep sets (header_id) holds."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("posted_at").cast("timestamp"))) / 3_600_000_000
    most = F.coalesce(*[F.when(F.col("tier") == t, F.lit(h)) for t, h in hours.items()])
    rows = headers.where(age > most)
    for one in keep:
        rows = rows.join(one.select("header_id").distinct(), "header_id", "left_anti")
    return rows


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is gone."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def assigned_keys(known: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """The dimension with new names, each with a key: a hash of it, the same wherever and whenever it is made."""
    new = names.select(name).where(F.trim(F.col(name)) != "").distinct().join(known, name, "left_anti")
    return known.select(name, key, F.lit(False).alias("is_new")).unionByName(new.select(name, F.xxhash64(name).alias(key), F.lit(True).alias("is_new")))


def bounded_scan(rows: DataFrame, first_order: list[Column], take: int, multiplier: int, keep: Column, order: list[Column]) -> DataFrame:
    """The first ``take`` rows that hold ``keep`` among the first ``take * multiplier`` of all: two cuts, the inner before the filter."""
    return rows.orderBy(*first_order).limit(take * multiplier).where(keep).orderBy(*order).limit(take)


def progress(ranges: DataFrame) -> DataFrame:
    """Per group: providers, the oldest and newest date seen, whether all and any reached their cutoff, articles."""
    return ranges.groupBy("group_name").agg(
        F.count_distinct("provider_id").alias("providers"), F.min("oldest_at").alias("oldest_at"), F.max("newest_at").alias("newest_at"), F.bool_or("cutoff_reached").alias("any_reached"),
        F.bool_and("cutoff_reached").alias("all_reached"), F.sum("articles").alias("articles"),
    )


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows without an order of their own need a complete one."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
