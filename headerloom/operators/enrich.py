"""Enrichment: payload sizes, window matches with an external list, title similarity, scores and categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerloom.sources.folders import written

#: The steps of size_points() whose points outweigh any nearness in time within ten days.
SIZE_STEPS = (0.08, 0.15, 0.25)


def payload_size(files: DataFrame) -> DataFrame:
    """Per release: payload bytes from the best evidence of each file; the sum for split archives, else the largest file.

    files: release_id, par2_bytes, yenc_bytes, file_bytes, catalog_bytes, is_par, is_sidecar, is_archive, is_split.
    """
    size = F.coalesce(F.col("par2_bytes"), F.col("yenc_bytes"), F.nullif(F.col("file_bytes"), F.lit(0)), F.col("catalog_bytes"), F.lit(0)).cast("long")
    label = F.when(F.col("par2_bytes").isNotNull(), 1).when(F.col("yenc_bytes").isNotNull(), 2).when(F.nullif(F.col("file_bytes"), F.lit(0)).isNotNull(), 3).otherwise(4)
    rows = files.where(~F.col("is_par") & ~F.col("is_sidecar")).select("release_id", size.alias("size"), label.alias("label"), "is_archive", "is_split")
    found = rows.groupBy("release_id").agg(F.sum("size").alias("sum"), F.max("size").alias("max"), F.count_if("is_archive").alias("archives"), F.count_if("is_split").alias("splits"), F.min("label").alias("best_evidence"))
    return found.select("release_id", F.when((F.col("archives") >= 2) & (F.col("splits") >= 1), F.col("sum")).otherwise(F.col("max")).alias("payload_bytes"), "best_evidence")


def size_points(ratio: Column) -> Column:
    return F.when(ratio <= 0.08, 0.55).when(ratio <= 0.15, 0.35).when(ratio <= 0.25, 0.18).when(ratio > 0.5, -0.10).otherwise(0.0)


def hour_points(hours: Column) -> Column:
    return F.when(hours <= 24, 0.22).when(hours <= 72, 0.15).when(hours <= 240, 0.06).otherwise(-0.08)


def counts_at(times: DataFrame, bounds: DataFrame) -> DataFrame:
    """at, before, upto: for each time ``at`` of bounds, once, how many rows of times are earlier, and how many are not later.

    Prefix sums over different times: within each hour, and over the hours, of which the calendar bounds the number.
    """
    points = times.groupBy("at").agg(F.count("*").alias("n")).unionByName(bounds.select("at", F.lit(0).cast("long").alias("n"))).groupBy("at").agg(F.sum("n").alias("n"), F.min("n").alias("asked"))
    points = written(points.withColumn("hour", F.date_trunc("HOUR", "at")))
    hours = points.groupBy("hour").agg(F.sum("n").alias("m"))
    hours = hours.select("hour", (F.sum("m").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("hours_before"))
    upto = F.sum("n").over(Window.partitionBy("hour").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = points.withColumn("upto", upto).join(hours, "hour").where("asked = 0")
    return rows.select("at", (F.col("hours_before") + F.col("upto") - F.col("n")).alias("before"), (F.col("hours_before") + F.col("upto")).alias("upto"))


def size_edge(size: Column, share: float, sign: int) -> Column:
    """The least (``sign`` -1) or greatest (1) size whose ratio to ``size`` is at most ``share``, to the last bit of a double."""

    @F.pandas_udf("double")
    def edge(sizes: pd.Series) -> pd.Series:
        s = sizes.to_numpy(float)
        near = lambda e: np.abs(e - s) / np.maximum(np.maximum(e, s), 1.0) <= share
        e = s - share * np.maximum(s, 1.0) if sign < 0 else np.where(s + share <= 1, s + share, s / (1 - share))
        for _ in range(8):
            wider = np.nextafter(e, sign * np.inf)
            e = np.where(near(wider), wider, e)
        for _ in range(8):
            e = np.where(near(e), e, np.nextafter(e, -sign * np.inf))
        return pd.Series(e)

    return edge(size)


def size_cell(size: Column, width: float) -> Column:
    """Steps of the logarithm, evenly on below 1; sizes within a ratio of ``width`` to either side of any size span more than one."""
    return F.floor(F.when(size > 1, F.log(size)).otherwise(size - 1) / width)


def runs_within(low: str, high: str, levels: int) -> Column:
    """(level, node) of the aligned runs of 2^level numbers that together are the numbers from ``low`` to before ``high``."""
    first, last = f"shiftright({low} + shiftleft(1L, l) - 1, l)", f"shiftright({high}, l)"
    run = lambda edge, node: f"CASE WHEN {first} < {last} AND {edge} % 2 = 1 THEN struct(l AS level, {node} AS node) END"
    return F.expr(f"filter(flatten(transform(sequence(0, {levels}), l -> array({run(first, first)}, {run(last, f'{last} - 1')}))), x -> x IS NOT NULL)")


def least_ids(asked: DataFrame, known: DataFrame, share: float | None) -> DataFrame:
    """key, ring, entry_id: the least id of the entries of a run whose size is at most ``share`` away (None: of any size), for rows that have one.

    asked: key, ring, level, node, size; known: level, node, size, entry_id. The sizes that are near enough span cells: what lies in the first is the end
    of a cell, in the last its beginning, and those between are whole. Ends and beginnings are running minima over entries and edges in order, so no pairs are made.
    """
    place = ["level", "node"]
    if share is None:
        found = asked.join(known.groupBy(*place).agg(F.min("entry_id").alias("entry_id")), place)
        return found.select("key", "ring", "entry_id")
    finite = lambda df: df.where("size is not null and not isnan(size) and abs(size) < double('inf')")
    held = finite(known).withColumn("cell", size_cell(F.col("size"), share))
    ask = finite(asked).withColumn("low", size_edge(F.col("size"), share, -1)).withColumn("high", size_edge(F.col("size"), share, 1))
    ask = ask.withColumns({"first": size_cell(F.col("low"), share), "last": size_cell(F.col("high"), share)})
    none = lambda kind: F.lit(None).cast(kind)
    key_type = ask.schema["key"].dataType
    # Entries are 0, so that they come before the edges of their size on either way.
    ends = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("first").alias("cell"), F.col("low").alias("size")), F.struct(F.lit(2).alias("side"), F.col("last").alias("cell"), F.col("high").alias("size"))))
    edges = ask.select("key", "ring", *place, ends.alias("e")).select("key", "ring", *place, "e.*", none("long").alias("entry_id"))
    rows = edges.unionByName(held.select(none(key_type).alias("key"), none("int").alias("ring"), *place, F.lit(0).alias("side"), "cell", "size", "entry_id"))
    running = lambda order: F.min("entry_id").over(Window.partitionBy(*place, "cell").orderBy(order, "side").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ends", running(F.desc("size"))).withColumn("begins", running(F.asc("size"))).where("side > 0")
    found = rows.select("key", "ring", F.when(F.col("side") == 1, F.col("ends")).otherwise(F.col("begins")).alias("entry_id"))
    whole = held.groupBy(*place, "cell").agg(F.min("entry_id").alias("entry_id"))
    between = ask.where("last - first > 1").select("key", "ring", *place, F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)).alias("cell"))
    return found.unionByName(between.join(whole, [*place, "cell"]).select("key", "ring", "entry_id")).where("entry_id is not null")


def window_match(releases: DataFrame, entries: DataFrame, before_days: int = 10, after_days: int = 3) -> DataFrame:
    """The best entry of each release posted from ``before_days`` before to ``after_days`` after it, by size and time, and how many there are.

    releases: release_id, posted_at, size_bytes; entries: entry_id, posted_at, size_bytes. Ties go to the smaller entry_id; releases without an entry in their window are left out.
    Scores are of few steps in size and in time, so the best entry is the least id within a box of both. The entries' different times are
    numbered, a span of time is cut into aligned runs of numbers, and each run holds its entries by size: no release meets its entries one by one.
    Boxes are tried from the highest score on, and releases that found an entry drop out. Equal times and sizes meet once. Counts are differences of prefix sums.
    """
    low, high = F.expr(f"posted_at - interval {before_days} days"), F.expr(f"posted_at + interval {after_days} days")
    asked = written(releases.where("posted_at is not null").select("release_id", "posted_at", "size_bytes", low.alias("low"), high.alias("high")))
    at = entries.where("posted_at is not null").select(F.col("posted_at").alias("at"))
    counts = written(counts_at(at, asked.select(F.col("low").alias("at")).unionByName(asked.select(F.col("high").alias("at"))).distinct()))
    asked = asked.join(counts.select(F.col("at").alias("low"), "before"), "low").join(counts.select(F.col("at").alias("high"), "upto"), "high").withColumn("candidates", F.col("upto") - F.col("before")).where("candidates > 0")
    asked = written(asked.select("release_id", "posted_at", "size_bytes", "candidates"))
    known = entries.where("posted_at is not null").groupBy(F.col("posted_at").alias("at"), F.col("size_bytes").cast("double").alias("size")).agg(F.min("entry_id").cast("long").alias("entry_id"))

    # Spans of time by their points: the hours to either side that they reach, within the window.
    hours = [h for h in (24, 72, 240) if h < 24 * max(before_days, after_days)]
    reach = [(min(h, 24 * before_days), min(h, 24 * after_days)) for h in hours] + [(24 * before_days, 24 * after_days)]
    time_points = [(0.22, 0.15, 0.06, -0.08)[min(i, 3)] for i in range(len(hours))] + [next((p for h, p in ((24, 0.22), (72, 0.15), (240, 0.06)) if max(before_days, after_days) * 24 <= h), -0.08)]
    times = asked.select("posted_at").distinct()
    for i, (back, on) in enumerate(reach):
        times = times.withColumns({f"from{i}": F.expr(f"posted_at - interval {back} hours"), f"to{i}": F.expr(f"posted_at + interval {on} hours")})
    times = written(times)
    moments = known.select("at").distinct()
    bounds = moments
    for c in times.columns[1:]:
        bounds = bounds.unionByName(times.select(F.col(c).alias("at")))
    number = written(counts_at(moments, bounds.distinct()))
    known = written(known.join(number.select("at", F.col("before").alias("n")), "at").select("n", "size", "entry_id"))
    for i in range(len(reach)):
        times = times.join(number.select(F.col("at").alias(f"from{i}"), F.col("before").alias(f"a{i}")), f"from{i}").join(number.select(F.col("at").alias(f"to{i}"), F.col("upto").alias(f"b{i}")), f"to{i}")
    spans = [f"{x}{i}" for i in range(len(reach)) for x in "ab"]
    times = written(times.select("posted_at", *spans))
    longest = times.agg(*[F.max(F.col(f"b{i}") - F.col(f"a{i}")).alias(f"m{i}") for i in range(len(reach))]).first()
    levels = [max(1, m or 1).bit_length() - 1 for m in longest]
    left = written(asked.select("posted_at", F.col("size_bytes").cast("double").alias("size")).distinct().withColumn("key", F.struct("posted_at", "size")).join(times, "posted_at").drop("posted_at"))

    points = lambda of_size, ring: round(of_size + time_points[ring], 2)
    in_ring = lambda i: lambda r: F.struct(F.lit(i).alias("ring"), r["level"].alias("level"), r["node"].alias("node"))
    rings, found = range(len(reach)), None
    first, later = SIZE_STEPS[0], rings[1:]
    boxes = [(first, 0.55, rings[:1])], [(first, 0.55, later)], [(SIZE_STEPS[1], 0.35, rings)], [(SIZE_STEPS[2], 0.18, rings)], [(0.5, 0.0, rings), (None, -0.1, rings)]
    # Beyond ten days a nearer size may weigh less than a nearer time, so all boxes count at once.
    for part in boxes if time_points[-1] > 0 else [sum(boxes, [])]:
        got = None
        for share, of_size, which in part:
            if not len(which):
                continue
            top = max(levels[i] for i in which)
            runs = F.explode(F.flatten(F.array(*[F.transform(runs_within(f"a{i}", f"b{i}", levels[i]), in_ring(i)) for i in which])))
            ask = left.select("key", "size", runs.alias("r")).select("key", "size", "r.*")
            held = known.select("size", "entry_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda l: F.struct(l.alias("level"), F.call_function("shiftright", F.col("n"), l).alias("node")))).alias("r")).select("size", "entry_id", "r.*")
            some = least_ids(ask, held, share)
            if share == 0.5:
                # An unknown size, on either side, weighs nothing.
                some = some.unionByName(least_ids(ask.where("size is null"), held, None)).unionByName(least_ids(ask, held.where("size is null"), None))
            by_ring = F.element_at(F.array(*[F.lit(points(of_size, i)) for i in rings]), F.col("ring") + 1)
            some = some.select("key", "entry_id", by_ring.alias("score"))
            got = some if got is None else got.unionByName(some)
        if got is None:
            continue
        best = written(got.groupBy("key").agg(F.max_by(F.struct("entry_id", "score"), F.struct("score", -F.col("entry_id"))).alias("w")))
        found = best if found is None else found.unionByName(best)
        left = written(left.join(best.select("key"), left["key"].eqNullSafe(best["key"]), "left_anti"))
    size = F.col("size_bytes").cast("double")
    found = found.select(F.col("key.posted_at").alias("found_at"), F.col("key.size").alias("found_size"), "w")
    return asked.join(found, (F.col("posted_at") == F.col("found_at")) & size.eqNullSafe(F.col("found_size"))).select("release_id", "w.*", "candidates")


def token_similarity(a: Column, b: Column) -> Column:
    """Distinct common tokens by the larger number of tokens; 1 for equal texts."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.split(a, " ")), F.size(F.split(b, " "))))


def similar_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """id, other_id, similarity of title pairs (id, title) of at least ``least`` that share a token, each pair compared once.

    Titles as similar as that share at least one of each other's rarest tokens: of d different tokens, the d - c + 1 that the
    fewest titles have, where c is the number that must be common. Only these are joined, so a common word meets no pairs.
    """
    token = lambda df: df.select("id", "title", F.explode(F.array_distinct(F.split("title", " "))).alias("token"))
    count = token(left).unionByName(token(right)).groupBy("token").agg(F.count("*").alias("n"))
    needed = F.ceil(F.size(F.split("title", " ")) * (least - 5e-5) - 1e-9)  # similarities are rounded to four digits
    rare = F.slice("s", F.lit(1), F.greatest(F.lit(1), F.least(F.size("s"), (F.size("s") - needed + 1).cast("int"))))

    def prefix(df: DataFrame, i: str, t: str) -> DataFrame:
        ordered = token(df).join(count, "token").groupBy("id", "title").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("s"))
        return ordered.select(F.col("id").alias(i), F.col("title").alias(t), F.explode(rare.getField("token")).alias("token"))

    pairs = prefix(left, "id", "title").join(prefix(right, "other_id", "other_title"), "token").drop("token").distinct()
    return pairs.withColumn("similarity", F.round(token_similarity(F.col("title"), F.col("other_title")), 4)).where(F.col("similarity") >= least).select("id", "other_id", "similarity")


def availability(completion: Column, has_par: Column, files: Column, match: Column) -> Column:
    """0.72 of the completion in percent, 12 for repair files, 8 for two files or more, 8 times the match confidence."""
    return F.round(0.72 * completion + F.when(has_par, 12).otherwise(0) + F.when(files >= 2, 8).otherwise(0) + 8 * match, 4)


def availability_tier(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "partial").otherwise("low")


def media_quality(title: Column) -> Column:
    """25 and points for resolution, source and codec words of the lower-cased title."""
    t = F.lower(title)
    has = lambda *words: t.rlike(rf"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)")
    resolution = F.when(has("2160p"), 35).when(has("1080p"), 28).when(has("720p"), 20).when(has("576p", "480p"), 10).otherwise(0)
    source = F.when(has("remux"), 25).when(has("bluray", "bdrip"), 20).when(has("webrip", "web-dl"), 16).when(has("hdtv"), 10).when(has("dvdrip"), 8).when(has("cam"), -10).otherwise(0)
    codec = F.when(has("x265", "hevc", "av1"), 12).when(has("x264", "h264"), 8).when(has("xvid"), 2).otherwise(0)
    return (F.lit(25) + resolution + source + codec).cast("int")


def best_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
