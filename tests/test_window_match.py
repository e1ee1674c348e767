import datetime as dt
import random

import pytest

from headerloom.operators import enrich

START = dt.datetime(2024, 1, 1)


def brute(releases, entries, before, after):
    out = {}
    for r, at, s in releases:
        seen = []
        for e, when, b in entries:
            if at is None or when is None or not -before * 86400 <= (when - at).total_seconds() <= after * 86400:
                continue
            ratio = None if s is None or b is None else abs(b - s) / max(b, s, 1.0)
            hours = abs((when - at).total_seconds()) / 3600
            size = 0.0 if ratio is None else 0.55 if ratio <= 0.08 else 0.35 if ratio <= 0.15 else 0.18 if ratio <= 0.25 else -0.1 if ratio > 0.5 else 0.0
            seen.append((-round(size + (0.22 if hours <= 24 else 0.15 if hours <= 72 else 0.06 if hours <= 240 else -0.08), 2), e))
        if seen:
            out[r] = (min(seen)[1], -min(seen)[0], len(seen))
    return out


@pytest.mark.parametrize(("before", "after"), [(10, 3), (12, 2)])
def test_window_match_as_by_pairs(spark, before, after):
    """Sizes at the very edges of the steps, below 1, unknown; days and odd moments; windows beyond ten days."""
    r = random.Random(before)
    when = lambda: None if r.random() < 0.03 else START + dt.timedelta(days=r.randrange(60), seconds=r.choice([0, 0, 1, 43_200, r.randrange(86_400)]))
    size = lambda: r.choice([None, 0.0, 0.3, 0.93, 1.0, 1.05, 100.0, 92.0, 85.0, 75.0, 50.0, 200.0, 49.0, float(r.randrange(1, 4000)), 3000 * r.random()])
    releases = [(i, when(), size()) for i in range(150)]
    entries = [(i, when(), size()) for i in r.sample(range(10_000), 60)]
    kinds = "posted_at timestamp_ntz, size_bytes double"
    got = enrich.window_match(spark.createDataFrame(releases, f"release_id long, {kinds}"), spark.createDataFrame(entries, f"entry_id long, {kinds}"), before, after).collect()
    assert {x.release_id: (x.entry_id, x.score, x.candidates) for x in got} == brute(releases, entries, before, after) and len(got) == len({x.release_id for x in got})


def test_a_release_meets_no_entries_one_by_one(spark):
    """30,000 releases and entries of one day and about one size: 900 million pairs."""
    row = lambda n, first: spark.range(n).selectExpr(f"id + {first} AS {'entry_id' if first else 'release_id'}", "timestamp_ntz '2024-01-01' AS posted_at", "1000000.0D + id AS size_bytes")
    got = enrich.window_match(row(30_000, 0), row(30_000, 50_000)).agg({"release_id": "count", "entry_id": "max", "candidates": "min"}).first()
    assert sorted(got) == [30_000, 30_000, 50_000]
