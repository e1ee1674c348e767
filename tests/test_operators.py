from pyspark.sql import functions as F

from headerloom.functions import text
from headerloom.operators import catalog, merge, parts, readiness


def test_logical_parts_keep_the_largest_copy(spark):
    rows = spark.createDataFrame([(1, 1, 10, 7, 1), (1, 1, 12, 9, 2), (1, 1, 12, 8, 3), (1, 2, 5, 1, 4)], "binary_id long, part_number int, segment_bytes long, article_id long, posted_at long")
    assert sorted(map(tuple, parts.logical_parts(rows).collect())) == [(1, 1, 12, 8, 3), (1, 2, 5, 1, 4)]


def test_changes_are_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "c"), (4, "d")], "k int, v string")
    assert sorted(map(tuple, merge.changed(old, new, ["k"], ["v"]).collect())) == [(2, "updated"), (3, "deleted"), (4, "inserted")]


def test_subject_counters(spark):
    c = text.counters(F.col("s"))
    rows = spark.createDataFrame([('[2/8] - "x.r01" yEnc (3/20)',), ("no counters",)], "s string").select(*[v.alias(k) for k, v in c.items()])
    assert [tuple(r) for r in rows.collect()] == [(2, 8, 3, 20, "x.r01", True), (0, 0, 1, 1, "", False)]


def test_blank_search_and_wildcards(spark):
    r = spark.createDataFrame([(1, "a_b", None), (2, "axb", None)], "release_id int, search_title string, posted_at timestamp").withColumn("title", F.col("search_title"))
    assert catalog.search(r, "  ").count() == 0
    assert [x.release_id for x in catalog.search(r, "A_B").collect()] == [1]


def test_weak_single_overrides_actionable(spark):
    files = spark.createDataFrame([("f", "opaque_set", True, True, 0), ("g", "archive_stem", True, True, 2), ("g", "archive_stem", True, False, 2)], "family_key string, kind string, is_main boolean, is_complete boolean, expected_files int")
    found = {r.family_key: (r.bucket, r.coverage) for r in readiness.readiness_bucket(readiness.family_summary(files)).collect()}
    assert found == {"f": ("weak_single_binary", 0.0), "g": ("actionable", 0.5)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "family_key string, kind string, is_main boolean, is_complete boolean, expected_files int")
    assert readiness.readiness_bucket(readiness.family_summary(empty)).count() == 0
