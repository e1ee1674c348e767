import datetime as dt

import pytest
from pyspark.sql import functions as F

from headerloom.functions import category, matching
from headerloom.operators import clusters, regroup
from headerloom.streaming import upserts

AT = dt.datetime(2024, 1, 1)
FILES = "family_key long, binary_id long, posted_at timestamp, poster string, stem string, title string, file_index int, expected_files int, size_bytes long, confidence double"


def file(binary_id, hours, family=1, poster="p", stem="s", title="some title", index=0, expected=0, size=100):
    return (family, binary_id, AT + dt.timedelta(hours=hours), poster, stem, title, index, expected, size, 0.9)


def clustered(spark, rows):
    return {r.binary_id: r.cluster_id for r in clusters.release_clusters(spark.createDataFrame(rows, FILES)).collect()}


def test_files_of_one_posting_are_one_cluster(spark):
    assert clustered(spark, [file(1, 0, index=1, expected=3), file(2, 1, index=2, expected=3), file(3, 2, index=3, expected=3)]) == {1: 1, 2: 1, 3: 1}


def test_same_index_and_other_totals_are_kept_apart(spark):
    assert clustered(spark, [file(1, 0, index=1, expected=3), file(2, 1, index=1, expected=3), file(3, 1, index=2, expected=4)]) == {1: 1, 2: 2, 3: 3}


def test_clusters_stay_open_for_good(spark):
    assert clustered(spark, [file(1, 0), file(2, 25), file(3, 23), file(4, 100)]) == {1: 1, 3: 1, 2: 1, 4: 1}


def test_families_nulls_and_empty_tables(spark):
    assert clustered(spark, []) == {}
    assert clustered(spark, [(1, 9, None, None, None, None, None, None, None, None)]) == {9: 9}
    nulls = (1, 5, AT, None, None, None, None, None, None, None)
    assert clustered(spark, [nulls, file(6, 0, family=2), file(7, 0, family=3)]) == {5: 5, 6: 6, 7: 7}


def test_regroup_keeps_the_largest_copy(spark):
    parts = spark.createDataFrame([("k", 1, 1, 10, 5), ("k", 2, 1, 20, 6), ("k", 2, 2, 7, 7), ("one", 3, 1, 1, 1), (None, 4, 1, 1, 1)], "group_key string, binary_id long, part_number int, segment_bytes long, article_id long")
    assert sorted((r.target_binary_id, r.part_number, r.segment_bytes, r.source_binary_id, r.copies) for r in regroup.regrouped_parts(parts).collect()) == [(1, 1, 20, 2, 2), (1, 2, 7, 2, 1)]
    assert [tuple(r) for r in regroup.superseded(parts).collect()] == [(2, 1)]


@pytest.mark.parametrize(
    ("name", "key", "volume"),
    [("Some.Show.part03.rar", "some show", 3), ("a b.r07", "a b", 9), ("x y.vol03+04.par2", "x y", 0), ("q w.7z.002", "q w", 2), ("rar", "rar", 0), ("", "", 0)],
)
def test_canonical_keys(spark, name, key, volume):
    row = spark.createDataFrame([(name,)], "n string").select(matching.canonical_key(F.col("n")).alias("k"), matching.archive_volume(F.col("n")).alias("v")).first()
    assert (row.k, row.v) == (key, volume)


def test_confidence_of_nulls_and_of_a_full_subject(spark):
    rows = spark.createDataFrame([(1, None, None), (2, '[1/3] "some title.mkv" yEnc (2/9)', "p"), (3, "abc", None)], "i int, s string, p string")
    none = F.lit(None)
    value = matching.confidence(F.col("s"), F.col("p"), none.cast("timestamp"), none.cast("long"), none, none.cast("string"))
    got = rows.select("i", F.round(value, 2).alias("c"), matching.match_status(value).alias("m")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, "low_confidence"), (2, 0.86, "matched"), (3, 0.16, "low_confidence")]


@pytest.mark.parametrize(
    ("title", "resolution", "want"),
    [
        ("Show.S01E02.1080p", "1080p", 5040), ("Film (1999) BluRay", "", 2050), ("Film 1999", "2160p", 2045), ("Game PS4", "", 1100), ("nintendo switch thing", "", 1035), ("Band - Album FLAC", "", 3040),
        ("manga epub", "", 7030), ("adobe thing", "", 4010), ("switches", "", 8010), ("", None, 8010), (None, None, 8010),
    ],
)
def test_categories(spark, title, resolution, want):
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(title, resolution)], "t string, r string").withColumn("x", category.words_of(F.col("t")))
    kind = category.category_kind(F.col("x"), none, none, none, none, F.lit(None).cast("long"), F.lit(None).cast("long"))
    assert rows.select(category.category_id(kind, F.col("x"), F.col("r")).alias("c")).first().c == want


def test_stream_batches_keep_the_newest_counts(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "k string, at timestamp, v long"

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes = upserts.bucket_counts(spark.readStream.schema(schema).parquet(source), "at", "1 day", "2 days", "k", measure=F.col("v"))
        upserts.write_changes(changes, target, state).awaitTermination()
        found = upserts.current(spark, target, ["k", "window_start"], "k string, window_start timestamp, n long, total long")
        return sorted((r.k, r.n, r.total) for r in found.collect())

    assert feed(("a", AT, 1), ("b", AT, 5)) == [("a", 1, 1), ("b", 1, 5)]
    assert feed(("a", AT, 2)) == [("a", 2, 3), ("b", 1, 5)]
