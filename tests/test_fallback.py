"""Matches by metadata: each pair is scored once."""

from headerloom.operators import evidence

SIDE = "season int, episode int, year int, resolution string, video string, audio string, posted_at timestamp_ntz, size long"


def test_pairs_are_scored_once(spark):
    a = spark.createDataFrame([(1, 7, None, None, 2020, "720p", "", "aac", None, 1024)], f"release_id long, k long, {SIDE}").alias("a")
    b = spark.createDataFrame([("x", 7, None, None, 2020, "720p", "", "aac", None, 1, "TV"), ("y", 7, None, None, None, "", "", "", None, 0, None)], f"title string, k long, {SIDE}, category string").alias("b")
    scored = evidence.fallback_scored(a.join(b, a.k == b.k), "a", "b")
    assert sorted(tuple(r) for r in scored.collect()) == [(1, "x", 0.81, None), (1, "y", 0.0, None)]
    best = evidence.ranked_matches(scored, 3)
    assert [(r.title, r["rank"], r.applied) for r in best.collect()] == [("x", 1, False)]
    assert best._jdf.queryExecution().optimizedPlan().toString().count("round(") == 1
