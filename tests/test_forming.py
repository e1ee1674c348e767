"""Dates, keys, merges, documents, packets and late rows on small tables with nulls, blanks and ties."""

import datetime as dt
import struct

from pyspark.sql import functions as F

from headerloom.functions import overview, probes
from headerloom.operators import admin, cohorts, ingest, inspection, lifecycle, merge, policy
from headerloom.sources import documents
from headerloom.streaming import upserts


def test_dates_in_their_layouts(spark):
    want = {
        "Mon, 02 Jan 2006 15:04:05 -0700": dt.datetime(2006, 1, 2, 22, 4, 5), "Mon, 2 Jan 06 15:04:05 GMT": dt.datetime(2006, 1, 2, 15, 4, 5), "2 Jan 70 15:04:05 EST": dt.datetime(1970, 1, 2, 15, 4, 5),
        "2 Jan 2006 15:04:05 +0130": dt.datetime(2006, 1, 2, 13, 34, 5), "2 Jan 2006 15:04:05 GMT": None, "2006-01-02T15:04:05Z": dt.datetime(2006, 1, 2, 15, 4, 5), "2006-01-02T15:04:05.5+02:00": dt.datetime(2006, 1, 2, 13, 4, 5),
        "31 Feb 2006 15:04:05 +0000": None, "": None, "yesterday": None, "2 Jan 2006": None,
    }
    rows = spark.createDataFrame([(t,) for t in want] + [(None,)], "t string").select("t", overview.posted_at(F.col("t")).alias("at")).collect()
    assert {r.t: r["at"] for r in rows} == want | {None: None}


def test_overview_rows_that_are_none(spark):
    good = "7\t s \tp\t2006-01-02T15:04:05Z\t<a>\t\t12\tx"
    lines = [good, good.replace("7", "0", 1), good.replace("7", "x", 1), "1\t2\t3", "", None, good.replace("<a>", "  ")]
    found = ingest.parsed(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [(r.article_number, r.subject, r.bytes, r.lines, r.xref) for r in found.collect()] == [(7, "s", 12, 0, "")] * 2
    assert ingest.accepted(found).count() == 1 and ingest.accepted(found, dt.datetime(2007, 1, 1)).count() == 0


def test_crossposts_and_patterns(spark):
    rows = spark.createDataFrame([(1, "a.b", "Xref: host a.b:1 C.D:2 c.d:5 e:x :3 f:0"), (2, "x", None), (3, "x", "")], "header_id long, group_name string, xref string")
    assert [tuple(r) for r in ingest.crosspost_groups(rows).collect()] == [(1, "c.d", 2)]
    assert overview.like_pattern("alt.*") == "alt.%" and overview.like_pattern("a_b%") == "%a\\_b\\%%" and overview.like_pattern("a?c") == "a_c"


def test_two_keys(spark):
    stored = spark.createDataFrame([(5, 1, 10, "m1"), (6, 1, 11, "m2")], "header_id long, group_id long, article_number long, message_id string")
    new = spark.createDataFrame([(0, 1, 10, "m2"), (1, 1, 99, "m1"), (2, 1, 12, "m9"), (3, 1, 12, "m8"), (4, 1, 13, "m9"), (5, 2, 10, "m1")], "ord long, group_id long, article_number long, message_id string")
    got = {r.ord: (r.header_id, r.as_ord, r.action) for r in ingest.resolve_by_two_keys(stored, new).collect()}
    assert got == {0: (5, None, "stored"), 1: (5, None, "stored"), 2: (None, 2, "insert"), 3: (None, 2, "resolve"), 4: (None, 2, "resolve"), 5: (None, 5, "insert")}


def test_merges_keep_what_is_better(spark):
    kind = "k long, family_key string, confidence double, file_index long, expected_files long"
    old = spark.createDataFrame([(1, "a", 0.9, 3, 2), (2, "b", 0.5, 3, 9), (3, "c", 0.5, 4, 1)], kind)
    new = spark.createDataFrame([(1, "x", 0.8, 7, 5), (2, "y", 0.5, 0, 1), (4, "z", 0.1, 1, None)], kind)
    got = sorted(map(tuple, merge.merged(old, new, ["k"], merge.no_downgrade(["family_key"])).collect()))
    assert got == [(1, "a", 0.9, 3, 5), (2, "y", 0.5, 3, 9), (3, "c", 0.5, 4, 1), (4, "z", 0.1, 1, None)]
    at = "k long, v string, updated_at long"
    got = merge.merged(spark.createDataFrame([(1, None, 5), (2, "a", 5)], at), spark.createDataFrame([(1, None, 9), (2, "b", 9)], at), ["k"], merge.touched(["v"]))
    assert sorted(map(tuple, got.collect())) == [(1, None, 5), (2, "b", 9)]


def test_children_of_named_parents_only(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "p long, c string")
    got = merge.replace_children(rows((1, "a"), (1, "b"), (2, "c")), rows((1, "n"), (3, "never")), spark.createDataFrame([(1,), (4,)], "p long"), "p")
    assert sorted(map(tuple, got.collect())) == [(1, "n"), (2, "c")]


def test_nzb_both_ways(spark):
    rows = [(1, "alt.b", 's "1" <&>', "p@x", 50, n, size, m) for n, size, m in [(2, 5, "<b@h>"), (1, 7, "<a@h>"), (1, 9, "<c&d@h>"), (3, 1, " "), (0, 1, "<z@h>")]] + [(1, "alt.a", "other", None, None, 1, 1, "<e@h>")]
    segments = spark.createDataFrame(rows, "release_id long, group_name string, file_subject string, poster string, posted_epoch long, part_number int, bytes long, message_id string")
    made = documents.nzb_documents(segments, spark.createDataFrame([(1, "T & t")], "release_id long, title string"))
    got = [tuple(r) for r in documents.nzb_segments(made).orderBy("subject", "number").collect()]
    assert got == [(1, "T & t", "other", "", 0, ["alt.a"], 1, 1, "e@h"), (1, "T & t", 's "1" <&>', "p@x", 50, ["alt.b"], 1, 9, "c&d@h"), (1, "T & t", 's "1" <&>', "p@x", 50, ["alt.b"], 2, 5, "b@h")]
    broken = spark.createDataFrame([(2, "<nzb><file"), (3, None), (4, "")], "release_id long, nzb string")
    assert documents.nzb_segments(broken).count() == 0


def tied_segments(spark):
    """Twenty parts, each of two articles of the same size."""
    rows = [(1, "alt.b", "s", "p@x", 50, n, 9, f"<{m}{n}@h>") for n in range(1, 21) for m in ("b", "a")] + [(1, "alt.b", "s", "p@x", 50, 21, None, "<a21@h>"), (1, "alt.b", "s", "p@x", 50, 21, 3, "<b21@h>")]
    return spark.createDataFrame(rows, "release_id long, group_name string, file_subject string, poster string, posted_epoch long, part_number int, bytes long, message_id string")


def test_nzb_takes_the_lesser_message_id_of_equal_sizes(spark):
    text = documents.nzb_documents(tied_segments(spark)).first().nzb
    assert "@h</segment>" in text and all(f">a{n}@h<" in text for n in range(1, 21)) and ">b21@h<" in text and text.count("<segment ") == 21


def test_segments_of_equal_sizes_read_back(spark):
    got = documents.nzb_segments(documents.nzb_documents(tied_segments(spark))).select("number", "bytes", "message_id").orderBy("number").collect()
    assert [tuple(r) for r in got] == [(n, 9, f"a{n}@h") for n in range(1, 21)] + [(21, 3, "b21@h")]


def test_repair_packets(spark):
    def packet(name, size, length=None):
        body = bytes(48) + struct.pack("<Q", size) + name
        return b"PAR2\0PKT" + struct.pack("<Q", length or 64 + len(body)) + bytes(32) + b"PAR 2.0\0FileDesc" + body

    data = b"noise" + packet(b"a.rar\0\0\0", 5) + b"??" + packet(b"A.RAR", 6) + packet("é b".encode(), 7) + packet(b"\xff", 8) + packet(b"", 9) + packet(b"cut", 3, 10**9) + packet(b"after", 4)
    got = probes.repair_targets(spark.createDataFrame([(1, data), (2, b""), (3, None), (4, b"PAR2\0PKT")], "file_id long, data binary")).collect()
    assert sorted(map(tuple, got)) == [(1, "a.rar", 5), (1, "é b", 7)]


def test_claims_of_full_cohorts(spark):
    queue = spark.createDataFrame([(k, 1, "n", dt.date(2024, 1, 1 + k), 1, 2) for k in range(6)], "row_id long, group_id long, name_key string, day date, file_index int, total_parts int")
    lacking = spark.createDataFrame([(1, "n", dt.date(2024, 1, 3))], "group_id long, name_key string, day date")
    cohort = lambda *ids: spark.createDataFrame([(i, i) for i in ids], "row_id long, score long") if ids else spark.createDataFrame([], "row_id long, score long")
    lanes = lambda c, n: [tuple(r) for r in admin.claimed(c, queue, lacking, n).collect()]
    assert lanes(cohort(4, 5), 2) == [(-1, 5), (-1, 4)] or sorted(lanes(cohort(4, 5), 2)) == [(-1, 4), (-1, 5)]
    assert lanes(cohort(5), 4) == [(-1, 5), (0, 2), (0, 3), (1, 0)]
    assert lanes(cohort(), 3) == [(0, 2), (0, 3), (1, 0)]


def test_inspection_takes_one_of_a_family(spark):
    files = spark.createDataFrame([(1, k, n, True, None) for k, n in enumerate(["a.part02.rar", "a.part01.rar", "b.r00", "b.rar", "c.7z.002", "x.nfo"])] + [(1, 9, "d.rar", False, None)], "release_id long, file_id long, file_name string, is_complete boolean, posted_at timestamp_ntz")
    now = dt.datetime(2024, 1, 2)
    results = spark.createDataFrame([(1, "archive", "failed", '{"error": {"retryable": true}}', dt.datetime(2024, 1, 1)), (3, "archive", "done", None, dt.datetime(2024, 1, 1)), (4, "par2", "done", None, now)], "file_id long, stage string, status string, details string, at timestamp_ntz")
    got = inspection.candidates(files, results, "archive", now).collect()
    assert sorted((r.file_name, r.again) for r in got) == [("a.part01.rar", True), ("c.7z.002", False)]


def test_titles_and_gate(spark):
    rows = spark.createDataFrame([("Two Words",), ("Film 2001",), ("abcdef123456",), ("12 34",), (None,), ("deadbeef",)], "t string")
    assert [r.r for r in rows.select(lifecycle.looks_readable(F.col("t")).alias("r")).collect()] == [True, True, False, False, False, False]
    assert policy.browse_ids(" TV ", "ALL") == policy.browse_ids("tv") and policy.browse_ids("tv", "x") == [] and policy.browsed("nothing") is None


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark does not change a window whose state is gone; one within it does."""
    kind = "at timestamp, key string"
    for day, rows in enumerate([[("2024-01-01 00:00:00", "a"), ("2024-01-10 00:00:00", "a")], [("2024-01-01 12:00:00", "a"), ("2024-01-09 12:00:00", "a")], [("2024-01-11 00:00:00", "a")]]):
        spark.createDataFrame(rows, "at string, key string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        upserts.write_changes(upserts.bucket_counts(events, "at", "1 day", "2 days", "key", measure=F.lit(1)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {str(r.window_start)[:10]: r.n for r in upserts.current(spark, str(tmp_path / "out"), ["key", "window_start"], "key string, window_start timestamp, n long, total long").collect()}
    assert got == {"2024-01-01": 1, "2024-01-10": 1, "2024-01-09": 1, "2024-01-11": 1}


def test_lanes_are_of_rows(spark):
    """Two rows of one id, one of them beside a known file; a known file of the next day and nulls count for none."""
    day = lambda n: dt.date(2024, 1, n)
    queue = spark.createDataFrame([(1, 1, "n", day(5)), (1, 1, "n", day(9)), (2, 1, "n", day(6)), (3, 1, "n", day(4)), (4, None, "n", day(5))], "row_id long, group_id long, name_key string, day date")
    known = spark.createDataFrame([(1, "n", day(5)), (1, "n", day(5)), (None, "n", day(5))], "group_id long, name_key string, day date")
    got = [tuple(r) for r in cohorts.claim_lanes(queue, known, 10).collect()]
    assert got == [("A", 1, 1, day(5)), ("A", 2, 1, day(6)), ("B", 3, 1, day(4)), ("B", 4, None, day(5)), ("B", 1, 1, day(9))]
