"""Clusters against a plain loop over the rule, member by member, on random families."""

import cProfile
import datetime as dt
import pstats
import random

import pyarrow as pa

from headerloom.operators import clusters

AT = dt.datetime(2024, 1, 1)
SCHEMA = (
    "family_key long, binary_id long, posted_at timestamp, first_article_number long, poster string, stem string, title string, file_name string, family_title string, "
    "file_index int, expected_files int, size_bytes long, confidence double, is_auxiliary boolean"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def norm(x):
    return " ".join((x or "").lower().replace("_", " ").replace(".", " ").replace("-", " ").split())


def kind(f):
    name = (f["file_name"] or "").lower()
    return "repair" if name.endswith(".par2") or ".vol" in name else "info" if name.endswith(".nfo") else "archive" if name.endswith((".rar", ".zip", ".7z")) else ""


def related(a, b):
    return bool(a and b) and (a in b or b in a)


def alike(a, b):
    x, y = norm(a).split(), norm(b).split()
    return bool(x and y) and (x == y or sum(w in y for w in x) / min(len(x), len(y)) >= 0.6)


def dominant(members):
    counts, best, most = {}, "", 0
    for m in members:
        p = (m["poster"] or "").strip()
        if p:
            counts[p] = counts.get(p, 0) + 1
            if counts[p] > most:
                best, most = p, counts[p]
    return best


def score(f, members):
    total, index = f["expected_files"] or 0, f["file_index"] or 0
    if total > 0 and any(m["expected_files"] > 0 and m["expected_files"] != total for m in members):
        return 0.0
    layout = max([total] + [m["expected_files"] for m in members])
    if not f["is_auxiliary"] and index > 0 and layout > 1 and any(m["file_index"] == index for m in members):
        return 0.0
    companion = lambda m: kind(m) == "repair" or m["file_name"].endswith((".nfo", ".sfv"))
    stems = [norm(m["stem"]) for m in members if not companion(m) and norm(m["stem"])] or [norm(m["stem"]) for m in members if norm(m["stem"])]
    stem = related(norm(f["stem"]), stems[0] if stems else "")
    lead = dominant(members)
    poster = bool(lead) and (f["poster"] or "").strip().lower() == lead.lower()
    gaps = [abs((m["posted_at"] - f["posted_at"]).total_seconds()) / 3600 for m in members if m["posted_at"] and f["posted_at"]]
    gap = min(gaps, default=9e9)
    near = lambda a: a[0] if gap <= 2 else a[1] if gap <= 12 else a[2] if gap <= 24 else 0.0
    if kind(f) == "repair":
        whole = any(kind(m) != "repair" for m in members)
    elif kind(f) == "info":
        whole = any(related(norm(f["stem"]), norm(m["stem"])) for m in members)
    else:
        whole = any(kind(m) for m in members)
    if f["is_auxiliary"]:
        out = 0.10
        for cond, w in ((stem, 0.38), (poster, 0.18)):
            out += w if cond else 0.0
        out += near((0.18, 0.10, 0.05))
        out += 0.10 if whole else 0.0
        return min(1.0, out + f["confidence"] * 0.06)
    own = f["title"] or f["family_title"] or f["stem"]
    titles = [m["title"] for m in members if m["title"]]
    theirs = f["family_title"] or (titles[0] if titles else stems[0] if stems else "")
    sizes = [m["size_bytes"] for m in members if m["size_bytes"] > 0]
    size = f["size_bytes"] > 0 and any(abs(s - f["size_bytes"]) / max(s, f["size_bytes"]) <= 0.15 for s in sizes)
    places = [m["file_index"] for m in members if m["file_index"] > 0]
    inside = index > 0 and layout > 1 and bool(places) and (index in (min(places) - 1, max(places) + 1) or min(places) < index < max(places))
    out = 0.22
    out += 0.16 if poster else 0.0
    out += near((0.16, 0.10, 0.05))
    for cond, w in ((stem, 0.16), (alike(own, theirs), 0.08), (whole, 0.07), (size, 0.05), (inside, 0.12)):
        out += w if cond else 0.0
    return min(1.0, out + f["confidence"] * 0.10)


def by_loop(files):
    out = {}
    for family in {f["family_key"] for f in files}:
        own = [f for f in files if f["family_key"] == family]
        own.sort(key=lambda f: (f["is_auxiliary"], f["posted_at"] or dt.datetime(1970, 1, 1), f["first_article_number"], f["binary_id"]))
        found = []
        for f in own:
            best, at = 0.0, -1
            for i, members in enumerate(found):
                x = score(f, members)
                if x > best:
                    best, at = x, i
            if at < 0 or best < 0.55:
                best, at = 1.0, len(found)
                found.append([])
            found[at].append(f)
            out[f["binary_id"]] = (found[at][0]["binary_id"], round(best, 4))
    return out


def family(rng, key, n, begin):
    totals = rng.choice([[0], [3, 7], [0, 3, 7], [1, 2], [9]])
    title = rng.choice(["", "Some Show S01E02", "show pack"])
    for i in range(n):
        stem = rng.choice(["", "some show", "show", "x-y", "other"])
        yield {
            "family_key": key, "binary_id": begin + i, "posted_at": AT + dt.timedelta(hours=rng.choice([1, 3, 13, 30, 200]) * rng.random() * 20) if rng.random() > 0.1 else None,
            "first_article_number": rng.randrange(5), "poster": rng.choice(["", "Ann", "ann", "bob", "eve "]), "stem": stem, "title": rng.choice(["", "", "some show", "another show pack"]),
            "file_name": (stem or "x") + rng.choice([".rar", ".mkv", ".vol1+2.par2", ".nfo", ".sfv", ""]), "family_title": title, "file_index": rng.randrange(6), "expected_files": rng.choice(totals),
            "size_bytes": rng.choice([0, 100, 110, 140, 1000]), "confidence": rng.choice([0.0, 0.5, 0.9, 1.0]), "is_auxiliary": rng.random() < 0.3,
        }


def test_equal_to_the_rule_on_random_families(spark):
    rng = random.Random(3)
    files = [f for key in range(60) for f in family(rng, key, rng.randrange(1, 40), key * 100)]
    table = spark.createDataFrame([tuple(f[c] for c in NAMES) for f in files], SCHEMA).repartition(5)
    got = {r.binary_id: (r.cluster_id, r.score) for r in clusters.release_clusters(table).collect()}
    want = by_loop([f | {"stem": f["stem"] or f["file_name"].split(".")[0]} for f in files])
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_declared_families_are_a_sequence_for_each_total(spark):
    rows = [(1, 1, 3), (1, 2, 7), (2, 3, 3), (2, 4, 0), (None, 5, 3)]
    got = clusters.sequences(spark.createDataFrame(rows, "family_key long, binary_id long, expected_files int")).collect()
    assert {r.binary_id: r.unit for r in got} == {1: 3, 2: 7, 3: 0, 4: 0, 5: 0}


def test_files_of_the_third_day_and_auxiliary_files(spark):
    base = {"first_article_number": 0, "poster": "p", "stem": "a b", "title": "", "family_title": "", "file_index": 0, "expected_files": 0, "size_bytes": 10, "confidence": 0.9}
    files = [
        base | {"family_key": 1, "binary_id": 3, "posted_at": AT, "file_name": "a b.vol0+1.par2", "is_auxiliary": True},  # before its files
        base | {"family_key": 1, "binary_id": 1, "posted_at": AT + dt.timedelta(days=1), "file_name": "a b.rar", "is_auxiliary": False},
        base | {"family_key": 1, "binary_id": 2, "posted_at": AT + dt.timedelta(days=4), "file_name": "a b.r00", "is_auxiliary": False},
        base | {"family_key": 1, "binary_id": 4, "posted_at": AT, "file_name": "zz.nfo", "stem": "zz", "poster": "q", "is_auxiliary": True},
    ]
    table = spark.createDataFrame([tuple(f[c] for c in NAMES) for f in files], SCHEMA)
    assert {r.binary_id: r.cluster_id for r in clusters.release_clusters(table).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_a_null_family_is_one_family(spark):
    rows = [(None, 1, AT, "p", "s", "t", 0, 0, 1, 0.9), (None, 2, AT, "p", "s", "t", 0, 0, 1, 0.9)]
    schema = "family_key long, binary_id long, posted_at timestamp, poster string, stem string, title string, file_index int, expected_files int, size_bytes long, confidence double"
    assert sorted((r.family_key, r.binary_id, r.cluster_id) for r in clusters.release_clusters(spark.createDataFrame(rows, schema)).collect()) == [(None, 1, 1), (None, 2, 1)]


def rows_of(rng, n, each):
    """Files of sequences of ``each`` as the operator reads them."""
    for i in range(n):
        stem, kind = rng.choice(["some show", "show", "x y", "other"]), rng.choice(["", "archive", "repair", "info"])
        yield {
            "known": True, "family_key": i // each, "unit": 0, "binary_id": i, "dated": True, "posted": i * 3_600_000_000, "article": i, "is_auxiliary": i % each > 0.6 * each, "poster": rng.choice(["", "Ann", "ann", "bob"]),
            "stem": stem, "name_kind": kind, "is_companion": kind in ("repair", "info"), "own_title": "", "family_title": "", "file_index": rng.randrange(8), "expected_files": rng.choice([0, 3, 7]),
            "size_bytes": rng.choice([100, 110, 1000]), "confidence": rng.random(), "title": stem,
        }


def test_a_file_takes_few_steps():
    rows = pa.RecordBatch.from_pylist(list(rows_of(random.Random(5), 2000, 50)))
    profile = cProfile.Profile()
    profile.runcall(lambda: list(clusters._assign(iter([rows.slice(i, 500) for i in range(0, 2000, 500)]))))
    assert pstats.Stats(profile).total_calls / 2000 < 100


def test_many_clusters_are_narrowed_down_alike(spark):
    rng = random.Random(11)
    files = [f | {"family_key": 7, "binary_id": i, "poster": f"p{i % 9}", "stem": f"stem{i % 211} x", "family_title": "", "file_name": f["file_name"].replace("some show", "q")} for i, f in enumerate(f for k in range(40) for f in family(rng, k, 25, 0))]
    got = {r.binary_id: (r.cluster_id, r.score) for r in clusters.release_clusters(spark.createDataFrame([tuple(f[c] for c in NAMES) for f in files], SCHEMA)).collect()}
    want = by_loop(files)
    assert len({c for c, _ in want.values()}) > clusters.FEW
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_found_texts_are_kept_for_the_last_ones_only():
    held = clusters.Sequence()
    for i in range(3 * clusters.KEPT):
        held.stems[f"s{i % 7}"]
        assert list(held.stems.fits(f"s{i}")) == [clusters._related(f"s{i}", x) for x in held.stems.texts]
    assert len(held.stems.known) <= clusters.KEPT


def test_long_ids_beside_a_null_one(spark):
    base = {"first_article_number": 0, "poster": "p", "stem": "a b", "title": "", "family_title": "", "file_index": 0, "expected_files": 0, "size_bytes": 10, "confidence": 0.9, "file_name": "a b.rar", "is_auxiliary": False}
    files = [base | {"family_key": 1, "binary_id": i, "posted_at": AT + dt.timedelta(hours=n)} for n, i in enumerate((2**60 + 1, None))]
    got = clusters.release_clusters(spark.createDataFrame([tuple(f[c] for c in NAMES) for f in files], SCHEMA)).collect()
    assert {r.binary_id: r.cluster_id for r in got} == {2**60 + 1: 2**60 + 1, None: 2**60 + 1}
