"""Release titles: candidates of each kind, the best of several, adoption, stems, nulls."""

import os

from pyspark.sql import functions as F

from headerloom.operators import titling

OPAQUE = "a8f3c9d2e7b14f60a8f3"


CASES = [
    ((OPAQUE, None, ["Some.Show.S01E02.1080p.mkv"]), ("Some Show S01E02 1080p", "media_filename", 0.88)),
    ((OPAQUE, None, ["x.part01.rar", "Big.Release.Name.rar", "Other.Film.mkv"]), ("Big Release Name", "package_filename", 0.90)),
    ((OPAQUE, None, ["Some.Show.sample.mkv", "a b.part1.rar", "a b.7z.001"]), ("", "source_obfuscated", 0.30)),
    (("A Readable Title", None, ["Quite.Another.Thing.mkv"]), ("A Readable Title", "source", 0.55)),
    (("private", None, ["Quite.Another.Thing.mkv"]), ("Quite Another Thing", "media_filename", 0.88)),
    (("Some Show S01E02", None, ["Some.Show.S01E02.720p.mkv"]), ("Some Show S01E02 720p", "media_filename", 0.88)),
    (("Some.Show", None, ["Some Show.mkv"]), ("Some Show", "source", 0.55)),
    ((OPAQUE, "nice.clear_stem", []), ("nice clear stem", "deobfuscated", 0.68)),
    ((None, "nice clear stem", []), ("nice clear stem", "deobfuscated", 0.68)),
    ((None, None, []), ("", "fallback", 0.0)),
    ((OPAQUE, None, [], [("archive_entry", "dir/Good Name/.mkv", 0.75)]), ("Good Name", "archive_entry", 0.75)),
    (("Readable Here", None, [], [("archive_entry", "Readable Here Too.mkv", 0.75)]), ("Readable Here", "source", 0.55)),
    ((OPAQUE, None, [], [("nfo", "==== x ====\n\n  ** Great Film 2019 **\n", 0.9), ("media_title", "Great Film", 0.9), ("guess", "No Such Source", 1.0)]), ("Great Film 2019", "nfo", 0.9)),
    (("Great Film", None, [], [("media_title", "A Much Longer Other Name", 0.9), ("media_title", "Great Film x", 0.9)]), ("Great Film x", "media_title", 0.9)),
    ((OPAQUE, None, ["Short Name.mkv", "A Longer Name.mkv", "Tiny X.mkv"]), ("A Longer Name", "media_filename", 0.88)),
]


def test_titles(spark):
    given = [(x + ((), ()))[:4] if len(x) == 3 else x for x, _ in CASES]
    releases = spark.createDataFrame([(i, x[0], x[1]) for i, x in enumerate(given)], "release_id long, source_title string, stem string")
    files = spark.createDataFrame([(i, n, f) for i, x in enumerate(given) for n, f in enumerate(x[2])], "release_id long, ord long, file_name string")
    inspected = spark.createDataFrame([(i, n, *y) for i, x in enumerate(given) for n, y in enumerate(x[3])], "release_id long, ord long, source string, value string, confidence double")
    found = {r.release_id: (r.title, r.title_source, r.title_confidence) for r in titling.release_titles(releases, files, inspected).collect()}
    assert found == {i: want for i, (_, want) in enumerate(CASES)}


READ = [
    ("", False, False), (OPAQUE, True, False), (f"{OPAQUE} x", True, False), (f"{OPAQUE} 1080p", False, True), ("deadbeef", True, False), ("Two Words", False, True), ("One", False, False), ("12345 x yz", False, False),
    ("x264", False, True), (None, False, False), ("abcdefghijklmnop.mkv", True, False),
]


def test_what_can_be_read(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(READ)], "i int, t string")
    got = titling.read(rows, "t").select("i", F.coalesce("t_obscure", F.lit(False)).alias("o"), F.coalesce("t_readable", F.lit(False)).alias("r")).collect()
    assert {r.i: (r.o, r.r) for r in got} == {i: (o, r) for i, (_, o, r) in enumerate(READ)}


def test_candidates_are_read_and_shuffled_once(spark):
    """No table is written on the way, and only releases and candidates are shuffled, each of them once."""
    releases = spark.createDataFrame([(1, OPAQUE, None), (2, None, None), (None, "Great Film", None)], "release_id long, source_title string, stem string")
    files = spark.createDataFrame([(1, 5, "dir\\Short Name.mkv"), (1, 6, "A Longer Name.mkv"), (2, 1, "x/sample/Some Name.mkv"), (None, 1, "Some Name.mkv")], "release_id long, ord long, file_name string")
    inspected = spark.createDataFrame([(1, 1, "media_title", "Some Name of Film", 0.88), (1, 2, "nfo", "Film 1999", 0.5), (2, 1, "media_title", "Two Words", 0.9)], "release_id long, ord long, source string, value string, confidence double")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    found = titling.release_titles(releases, files, inspected)
    assert sorted((r.release_id or 0, r.title, r.title_source) for r in found.collect()) == [(0, "Great Film", "source"), (1, "Some Name of Film", "media_title"), (2, "Two Words", "media_title")]
    assert set(os.listdir(folder)) == before
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert plan.count("Join") == 1
