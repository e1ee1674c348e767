"""What operators of the archive look at: counters, details as one row, spans of parts, audits, popularity, fuller cohorts and claims, identities set by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(rows: DataFrame, scalars: DataFrame) -> DataFrame:
    """rows with the columns of one row of scalars, null where that has none; the scalars are an aggregate without keys, so one row for certain."""
    return rows.join(F.broadcast(scalars), F.lit(True), "left")


def counters(named: dict[str, DataFrame]) -> DataFrame:
    """counter, n: how many rows each of the conditions leaves."""
    one = [df.agg(F.lit(name).alias("counter"), F.count("*").alias("n")) for name, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b), one)


def article_refs(spans: DataFrame, parts: DataFrame, headers: DataFrame) -> DataFrame:
    """The article of each part of a file: headers within the file's span of numbers, the earliest posted, then the least number, then id.

    spans: binary_id, group_id, low, high; parts: binary_id, part_number, header_id; headers: header_id, group_id, article_number,
    posted_at, bytes, message_id. The span is a residual of the joins on ids, so it needs no range join.
    """
    rows = parts.join(spans, "binary_id").join(headers.withColumnRenamed("group_id", "own_group"), "header_id").where("own_group = group_id and article_number between low and high")
    order = F.struct(F.col("posted_at").isNull().alias("none"), "posted_at", "article_number", "header_id")
    return rows.groupBy("binary_id", "part_number").agg(F.min_by(F.struct("header_id", "article_number", "bytes", "message_id"), order).alias("w"), F.count("*").alias("copies")).select("binary_id", "part_number", "w.*", "copies")


def details(entity: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """One JSON object for each row of entity: its columns, and for each kind of children the sorted list of their rows."""
    out, names = entity, [c for c in entity.columns]
    for name, rows in children.items():
        rest = [c for c in rows.columns if c != key]
        out = out.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
        names.append(name)
    return out.select(key, F.to_json(F.struct(*names)).alias("detail"))


def popular_groups(popularity: DataFrame, limit: int) -> DataFrame:
    """The groups with most articles, then posters, then by name, with their place."""
    top = popularity.orderBy(F.desc("articles"), F.desc("posters"), "group_name").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("articles"), F.desc("posters"), "group_name"))  # of the rows that the limit leaves
    return top.withColumn("place", place)


def storage_audit(rows: DataFrame, now) -> DataFrame:
    """Per status, rank and age: rows, those that block dropping their day (open or running), first and last date, the average and longest wait of those done in hours.

    rows: status, rank, at, done_at.
    """
    hours = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3_600_000_000
    old = hours(F.lit(now).cast("timestamp_ntz"), F.col("at"))
    age = F.when(old < 24, "<24h").when(old < 72, "24-72h").when(old < 168, "72h-7d").when(old < 720, "7d-30d").otherwise(">30d")
    wait = F.when(F.col("status") == "done", hours(F.col("done_at"), F.col("at")))
    return rows.groupBy("status", "rank", age.alias("age")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status").isin("ready", "running")).alias("blocking"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.round(F.avg(wait), 4).alias("average_wait"), F.round(F.max(wait), 4).alias("longest_wait"),
    )


def droppable_days(days: DataFrame, horizon, **open_work: DataFrame) -> DataFrame:
    """Days before the horizon with the rows of each kind of work that keeps them, the least kept first by age: place is the order in which free days are dropped.

    days and each kind of work: day. Free are days without any; others have no place.
    """
    out = days.where(F.col("day") < F.lit(horizon)).select("day").distinct()
    for name, rows in open_work.items():
        out = out.join(rows.groupBy("day").agg(F.count("*").alias(name)), "day", "left")
    out = out.na.fill(0, list(open_work)).withColumn("blockers", sum((F.col(c) for c in open_work), F.lit(0)))
    free = F.col("blockers") == 0
    return out.withColumn("place", F.when(free, F.row_number().over(Window.partitionBy(free).orderBy("day"))))  # a row a day


def opaque_cohorts(queue: DataFrame, seconds: int, least: int, day_rows: int) -> DataFrame:
    """Cohorts of opaque singletons of the chosen day, by group, poster and stretch of time, and their score.

    queue: header_id, group_id, poster, posted_at, bytes, name_key (null or blank if there is none), total_parts. Singletons have no name and at most one part, and no other
    header has their name. The day is the newest with at least ``day_rows`` of them, then the one with most.
    """
    named = F.trim(F.coalesce("name_key", F.lit("")))
    single = queue.where((named == "") & (F.coalesce("total_parts", F.lit(0)) <= 1)).withColumn("day", F.to_date("posted_at"))
    per_day = single.groupBy("day").agg(F.count("*").alias("n"))
    chosen = per_day.agg(F.coalesce(F.max(F.when(F.col("n") >= day_rows, F.col("day"))), F.max_by("day", F.struct("n", "day"))).alias("day"))
    bucket = F.floor(F.unix_micros(F.col("posted_at").cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    rows = single.join(F.broadcast(chosen), "day").groupBy("group_id", "poster", bucket.alias("bucket"))  # the choice is one row
    found = rows.agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"), F.min("header_id").alias("first"), F.max("header_id").alias("last"))
    return found.where(F.col("members") >= least).withColumn("score", F.col("members") * 1000 + F.least(F.lit(999), F.floor(F.col("bytes") / 1_000_000)).cast("long"))


def subject_cohorts(headers: DataFrame) -> DataFrame:
    """Cohorts of headers whose subjects tell all: file name, index and total, parts and size; the key is made of these, provider and group.

    headers: provider_id, group_id, file_name, file_index, file_total, part_number, total_parts, file_size, article_number.
    """
    sound = (F.trim(F.coalesce("file_name", F.lit(""))) != "") & (F.col("file_index") > 0) & (F.col("file_total") > 0) & (F.col("part_number") > 0) & (F.col("total_parts") > 1)
    keys = ["provider_id", "group_id", F.lower(F.trim("file_name")).alias("name"), "file_index", "file_total", "total_parts", F.coalesce("file_size", F.lit(0)).alias("file_size")]
    found = headers.where(sound).groupBy(*keys).agg(F.count("*").alias("articles"), F.min("article_number").alias("first"), F.max("article_number").alias("last"))
    text = F.concat_ws(":", "name", *[F.col(c).cast("string") for c in ("file_index", "file_total", "total_parts", "file_size")])
    key = F.concat(F.lit("subject:"), F.col("provider_id").cast("string"), F.lit(":"), F.col("group_id").cast("string"), F.lit(":"), F.md5(text.cast("binary")))
    return found.select(key.alias("cohort_key"), "articles", "first", "last", F.least(F.lit(1_000_000).cast("long"), F.col("articles") * 1000).alias("score"))


def claimed(cohort: DataFrame, queue: DataFrame, completion: DataFrame, limit: int, share: float = 0.7) -> DataFrame:
    """The next rows to assemble: lane -1 ready cohort rows; if they fill the limit, those only. Then lane 0, up to a share of the limit: structured
    rows whose file lacks parts; lane 1 the rest, oldest first.

    cohort: row_id, score; queue: row_id, group_id, name_key, day, file_index, total_parts; completion: group_id, name_key, day. The day of a completion key
    lies from one day before the row's to less than one day after it.
    """
    first = cohort.orderBy(F.desc("score"), "row_id").limit(limit).select(F.lit(-1).alias("lane"), "row_id")
    rest = queue.join(cohort.select("row_id"), "row_id", "left_anti")
    structured = (F.trim(F.coalesce("name_key", F.lit(""))) != "") & (F.col("file_index") > 0) & (F.col("total_parts") > 1)
    near = rest.where(structured).withColumn("d", F.explode(F.array(F.date_sub("day", 1), F.col("day"))))
    hit = near.join(completion.select("group_id", "name_key", F.col("day").alias("d")).distinct(), ["group_id", "name_key", "d"], "left_semi").select("row_id").distinct()
    a = rest.join(hit, "row_id", "left_semi").orderBy("day", "row_id").limit(int(limit * share)).select(F.lit(0).alias("lane"), "row_id", "day")
    b = rest.join(a.select("row_id"), "row_id", "left_anti").orderBy("day", "row_id").limit(limit).select(F.lit(1).alias("lane"), "row_id", "day")
    full = first.agg((F.count("*") >= limit).alias("full"))
    later = a.unionByName(b).join(F.broadcast(full), F.lit(True)).where("not full").drop("full")  # one row
    return first.withColumn("day", F.lit(None).cast("date")).unionByName(later).orderBy("lane", "day", "row_id").limit(limit).select("lane", "row_id")


def recovered_file_sets(files: DataFrame, hours: int = 24) -> DataFrame:
    """File sets of recovered files that span more than one group: at least two main files, all within some hours; coverage counts complete main files only.

    files: file_set_key, group_id, is_recovered, is_main, is_complete, expected_files, expected_archives, posted_at.
    """
    rows = files.where(F.col("is_recovered") & (F.trim("file_set_key") != ""))
    found = rows.groupBy("file_set_key").agg(
        F.count_distinct("group_id").alias("groups"), F.count_if("is_main").alias("main"), F.count_if(F.col("is_main") & F.col("is_complete")).alias("complete_main"), F.max("expected_files").alias("expected_files"),
        F.max("expected_archives").alias("expected_archives"), F.min("posted_at").alias("a"), F.max("posted_at").alias("b"),
    )
    near = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")) <= hours * 3_600_000_000
    share = lambda n: F.when(F.col(n) > 0, F.round(F.least(F.lit(100.0), 100.0 * F.col("complete_main") / F.col(n)), 4)).otherwise(0.0)
    return found.where((F.col("groups") > 1) & (F.col("main") >= 2) & near).select("file_set_key", "groups", "main", "complete_main", share("expected_files").alias("file_coverage"), share("expected_archives").alias("archive_coverage"))


def chosen_matches(matches: DataFrame, manual: DataFrame, least: float) -> DataFrame:
    """Per release the match that names it: the one set by hand, else the best at ``least`` or more; with how it was chosen.

    matches: release_id, match_id, score, title; manual: release_id, match_id.
    """
    best = matches.groupBy("release_id").agg(F.max_by(F.struct("match_id", "score"), F.struct("score", (-F.col("match_id")).alias("m"))).alias("w"))
    both = best.join(manual.withColumnRenamed("match_id", "by_hand"), "release_id", "full")
    auto = F.when(F.col("w.score") >= least, F.col("w.match_id"))
    return both.select("release_id", F.coalesce("by_hand", auto).alias("match_id"), F.when(F.col("by_hand").isNotNull(), "manual").when(auto.isNotNull(), "auto").otherwise("none").alias("how"))


def identity_score(cluster: Column, average: Column, title: Column) -> Column:
    """0 to 100: the cluster's and its matches' confidence, or the title's if that is higher."""
    return F.greatest(0.6 * 100 * cluster + 0.4 * 100 * average, 100 * title)


def first_to_reach(files: DataFrame) -> DataFrame:
    """Per release the poster that is the first, in posting order, to reach the highest count.

    That is, of the posters with most files, the one whose last file comes first. files: release_id, poster, posted_at, binary_id.
    """
    per = files.groupBy("release_id", "poster").agg(F.count("*").alias("n"), F.max(F.struct(F.col("posted_at").isNotNull().alias("known"), "posted_at", "binary_id")).alias("last"))
    return per.groupBy("release_id").agg(F.min_by(F.struct("poster", "n"), F.struct((-F.col("n")).alias("n"), "last")).alias("w")).select("release_id", "w.poster", "w.n")


def grouped_tags(tags: DataFrame) -> DataFrame:
    """release_id and its tags as a map of name to values, sorted, with how many names there are. tags: release_id, name, value."""
    one = tags.groupBy("release_id", "name").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))
    found = one.groupBy("release_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "values")))).alias("tags"))
    return found.withColumn("names", F.size(F.map_keys("tags")))
