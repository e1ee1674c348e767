"""Matches of releases with external entries by what is known beside their names, and pages of weak files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerloom.functions import category
from headerloom.operators.enrich import hour_points, size_points

#: The least score and the most seconds between posts at which a match is applied without a look.
APPLY_AT, APPLY_WITHIN = 0.90, 1800
#: What is compared of a release and an entry.
SIDES = ("season", "episode", "year", "resolution", "video", "audio", "posted_at", "size")


def size_ratio(size_bytes: Column, entry_size: Column) -> Column:
    """How far two sizes differ, as a share of the larger: the entry's number is read as kilobytes and as megabytes, and the better counts; null if either is unknown."""
    off = lambda unit: F.abs(size_bytes - entry_size * unit) / F.greatest(size_bytes, entry_size * unit)
    return F.when((size_bytes > 0) & (entry_size > 0), F.least(off(F.lit(1024.0)), off(F.lit(1048576.0))))


def fallback_score(a: dict[str, Column], b: dict[str, Column], ratio: Column, hours: Column) -> Column:
    """0 to 1: a release and an entry by episode, year, tags, size and time; another episode is 0 for certain.

    Names on either side: season, episode, year, resolution, video, audio; the entry has category as well. ratio and hours: how far sizes and times
    differ, as columns of an earlier projection, so that they are worked out once. Null evidence weighs nothing.
    """
    tv = a["season"].isNotNull() & a["episode"].isNotNull()
    named = b["season"].isNotNull() & b["episode"].isNotNull()
    hit = tv & named & (a["season"] == b["season"]) & (a["episode"] == b["episode"])
    same = lambda c, points: F.when((a[c] != "") & (a[c] == b[c]), points).otherwise(0.0)
    apart = F.abs(a["year"] - b["year"])
    total = (
        F.when(hit, 0.50).otherwise(0.0) + F.when(tv & F.lower(b["category"]).startswith("tv"), 0.15).otherwise(0.0) + F.coalesce(F.when(apart == 0, 0.12).when(apart == 1, 0.05).when(apart > 1, -0.05), F.lit(0.0))
        + same("resolution", 0.10) + same("video", 0.06) + same("audio", 0.04) + F.coalesce(size_points(ratio), F.lit(0.0)) + F.when(hours.isNull(), 0.0).otherwise(hour_points(hours))
    )
    return F.when(F.coalesce(tv & named & ~hit, F.lit(False)), 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4))


def fallback_scored(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """release_id, title, score, seconds between the posts of each pair of a release (side ``a``: release_id and the release's names) and an entry (side ``b``: title and the entry's names).

    A pair's score is worked out once: it comes as a row of its own, below which a later filter is not pushed into the join.
    """
    sides = {side: {c: F.col(f"{side}.{c}") for c in (*SIDES, *more)} for side, more in ((a, ()), (b, ("category",)))}
    micros = lambda side: F.unix_micros(sides[side]["posted_at"].cast("timestamp"))
    of = lambda side: {c: F.col(f"{side}_{c}") for c in sides[side]}
    plain = [column.alias(f"{side}_{c}") for side in sides for c, column in sides[side].items() if c not in ("posted_at", "size")]
    rows = pairs.select(f"{a}.release_id", f"{b}.title", *plain, F.abs(micros(a) - micros(b)).alias("micros"), size_ratio(sides[a]["size"], sides[b]["size"]).alias("ratio"))
    score = fallback_score(of(a), of(b), F.col("ratio"), F.col("micros") / 3_600_000_000)
    return rows.select("release_id", "title", F.inline(F.array(F.struct(score.alias("score"), (F.col("micros") / 1_000_000).alias("seconds")))))


def ranked_matches(pairs: DataFrame, keep: int) -> DataFrame:
    """The best entries of each release with their rank: by score, then nearness in time, then title; and whether the first is applied at once.

    pairs: release_id, title, score (those above 0 take part), seconds between the posts.
    """
    order = Window.partitionBy("release_id").orderBy(F.desc("score"), F.asc_nulls_last("seconds"), "title")
    rows = pairs.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return rows.withColumn("applied", (F.col("rank") == 1) & (F.col("score") >= APPLY_AT) & F.coalesce(F.col("seconds") <= APPLY_WITHIN, F.lit(False)))


def weak_page(identities: DataFrame, stats: DataFrame, releases: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of weak files that no release holds, newest change first: the page is cut on the identities alone, and its rows then get what else is known."""
    free = identities.where(F.col("strength").isin("weak", "provisional")).join(releases.select("binary_id").distinct(), "binary_id", "left_anti")
    page = free.orderBy(F.desc_nulls_last("updated_at"), "binary_id").offset(offset).limit(limit)
    return page.join(stats, "binary_id", "left")


def refreshed_categories(releases: DataFrame, matches: DataFrame) -> DataFrame:
    """release_id, kind and category_id of the releases whose stored category differs once the chosen match's category counts.

    releases: release_id, title, media_type, resolution, category_id (stored); matches: release_id, category. Releases without a match are resolved as they are.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0)
    rows = releases.join(matches.select("release_id", F.col("category").alias("matched")), "release_id", "left").withColumn("text", category.words_of(F.col("title")))
    rows = rows.withColumn("kind", category.category_kind(F.col("text"), none, F.col("media_type"), F.col("matched"), none, zero, zero))
    found = rows.withColumn("now", category.category_id(F.col("kind"), F.col("text"), F.col("resolution")))
    return found.where(~F.col("now").eqNullSafe(F.col("category_id"))).select("release_id", "kind", F.col("now").alias("category_id"))
