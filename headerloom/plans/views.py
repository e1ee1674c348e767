"""The driver's tables seen as the archive's: parts, files, headers, work."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.sources.tables import table


def files(spark, sf_dir):
    """Orders as files of families (one a customer), with kinds by priority and completeness by status."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("family_key"),
        F.col("o_orderkey").alias("binary_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "opaque_set").when(F.col("o_orderpriority").startswith("2"), "numeric_obfuscated_set").when(F.col("o_orderpriority").startswith("3"), "archive_stem").otherwise("readable_title").alias("kind"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_main"),
        (F.col("o_orderstatus") == "F").alias("is_complete"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(0)).otherwise((F.col("o_custkey") % 12).cast("int")).alias("expected_files"),
        (F.col("o_orderkey") % 7).alias("file_index"),
        (F.col("o_orderkey") % 3).alias("group_id"),
        F.col("o_orderdate").alias("posted_at"),
    )


FILES = """files AS (
  SELECT o_custkey AS family_key, o_orderkey AS binary_id,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'opaque_set' WHEN '2' THEN 'numeric_obfuscated_set' WHEN '3' THEN 'archive_stem' ELSE 'readable_title' END AS kind,
         o_orderpriority <> '5-LOW' AS is_main, o_orderstatus = 'F' AS is_complete,
         CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey % 12 END AS expected_files,
         o_orderkey % 7 AS file_index, o_orderkey % 3 AS group_id, o_orderdate AS posted_at
  FROM orders)"""


def headers(spark, sf_dir):
    """Events as article headers: the user is the poster, the type the newsgroup."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("header_id"), F.col("event_type").alias("group_id"), (F.col("user_id") % 10).alias("poster"), F.col("ts").alias("posted_at"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes"), (F.col("event_id") % 997).alias("message_key"),
    )


HEADERS = """headers AS (
  SELECT event_id AS header_id, event_type AS group_id, user_id % 10 AS poster, ts AS posted_at,
         CAST(floor(value * 1000) AS BIGINT) AS bytes, event_id % 997 AS message_key
  FROM events)"""


def subjects(spark, sf_dir):
    """lineitem with a subject as posted: counters of files and parts, a quoted name, a yEnc mark, a size."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = F.col("l_linenumber").cast("string")
    size = F.floor("l_extendedprice").cast("long").cast("string")
    subject = F.concat(F.lit("["), n, F.lit('/7] "'), "p_name", F.lit(".part0"), n, F.lit('.rar" yEnc ('), n, F.lit("/7) "), size)
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_name", subject.alias("subject"))


SUBJECTS = """subjects AS (
  SELECT l_orderkey, l_linenumber, l_partkey, p_name,
         concat('[', l_linenumber, '/7] "', p_name, '.part0', l_linenumber, '.rar" yEnc (', l_linenumber, '/7) ', CAST(floor(l_extendedprice) AS BIGINT)) AS subject
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def work(spark, sf_dir):
    """Events as queued work: priority by type, open unless an error, ready if the value is 20 or more."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"), (F.col("user_id") % 20).alias("group_id"), F.length("event_type").cast("int").alias("priority"), F.col("ts").alias("ready_at"),
        (F.col("event_type") != "error").alias("is_open"), (F.col("value") >= 20).alias("is_ready"),
    )


WORK = """work AS (
  SELECT event_id AS row_id, user_id % 20 AS group_id, CAST(length(event_type) AS INTEGER) AS priority, ts AS ready_at,
         event_type <> 'error' AS is_open, value >= 20 AS is_ready
  FROM events)"""


def releases(spark, sf_dir):
    """Parts as releases with titles, sizes, times and payload counts."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("release_id"), F.col("p_name").alias("title"), F.lower("p_name").alias("search_title"),
        F.when(F.col("p_partkey") % 11 == 0, None).otherwise(F.timestamp_add("DAY", (F.col("p_partkey") % 365).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))).alias("posted_at"),
        F.when(F.col("p_partkey") % 13 == 0, None).otherwise(F.floor(F.col("p_retailprice") * 100).cast("long")).alias("size_bytes"),
        ((F.col("p_size") * 2) / 100.0).cast("double").alias("completion"), F.col("p_size").alias("quality"),
        (F.col("p_size") % 9).cast("int").alias("file_count"), (F.col("p_size") % 4).cast("int").alias("par_file_count"), (F.col("p_size") % 5).cast("int").alias("expected_archive_files"),
        F.when(F.col("p_size") % 6 == 0, None).otherwise(F.col("p_size") % 6 == 1).alias("passworded"),
    )


RELEASES = """releases AS (
  SELECT p_partkey AS release_id, p_name AS title, lower(p_name) AS search_title,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) END AS posted_at,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(floor(p_retailprice * 100) AS BIGINT) END AS size_bytes,
         CAST(p_size * 2 / 100.0 AS DOUBLE) AS completion, p_size AS quality,
         CAST(p_size % 9 AS INTEGER) AS file_count, CAST(p_size % 4 AS INTEGER) AS par_file_count, CAST(p_size % 5 AS INTEGER) AS expected_archive_files,
         CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 6 = 1 END AS passworded
  FROM part)"""


def seen(spark, sf_dir, source: str, exprs: list[str], where: str = "true"):
    """A table as other rows, by expressions that both engines know."""
    return table(spark, sf_dir, source).where(where).selectExpr(*exprs)


def seen_sql(name: str, source: str, exprs: list[str], where: str = "true") -> str:
    """The same as a common table expression."""
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {source} WHERE {where})"
