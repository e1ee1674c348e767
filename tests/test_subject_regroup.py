"""Regrouping by subject counters on small tables: chains, files of two groups, canonical targets, earlier merges, copies of parts."""

import datetime as dt

from headerloom.operators import subject_regroup as regroup

AT = dt.datetime(2024, 1, 1)
FILES = "binary_id long, group_id long, binary_key string, release_family_key string, base_stem string, source_key string, file_name string, family_kind string, identity_reason string, file_index int, expected_files int, total_parts int, observed_parts int, status string, match_confidence double"
PARTS = "part_id long, binary_id long, part_number int, total_parts int, segment_bytes long, posted_at timestamp, file_name string, subject_name string, subject_index int, subject_total int, yenc_part int, yenc_total int"


def file(binary_id, name="a.rar", key=None, kind="contextual_obfuscated", reason="contextual_fallback", family="fam", status="active", observed=1, total=9):
    return (binary_id, 1, key or f"k{binary_id}", family, "", "", name, kind, reason, 1, 2, total, observed, status, 0.5)


def part(part_id, binary_id, number, size=10, name="a.rar", index=1, files=2, total=9):
    return (part_id, binary_id, number, total, size, AT, name, name, index, files, number, total)


def run(spark, files, parts, earlier=()):
    found = regroup.regrouped(spark.createDataFrame(files, FILES), spark.createDataFrame(parts, PARTS), spark.createDataFrame(list(earlier), "source long, target long"))
    return {k: [r.asDict() for r in v.collect()] for k, v in found.items()}


def edges(found):
    return {r["source"]: r["target"] for r in found["edges"]}


def test_fragments_end_in_the_smallest_and_its_parts_are_the_largest(spark):
    got = run(spark, [file(1), file(2), file(3, name="b.rar")], [part(1, 1, 1), part(2, 2, 1, 20), part(3, 2, 2), part(4, 3, 1, name="b.rar")])
    assert edges(got) == {2: 1}
    assert sorted((p["binary_id"], p["part_number"], p["part_id"]) for p in got["parts"]) == [(1, 1, 2), (1, 2, 3), (3, 1, 4)]
    files = {f["binary_id"]: f for f in got["files"]}
    assert (files[1]["identity_reason"], files[1]["binary_key"], files[1]["observed_parts"], files[1]["total_bytes"], files[1]["match_confidence"]) == (regroup.KIND, "a::a rar", 2, 30, 0.86)
    assert (files[2]["status"], files[2]["superseded_by"]) == ("superseded", 1) and files[3]["binary_key"] == "k3"
    assert [(d["group_id"], d["family_key"]) for d in got["dirty"]] == [(1, "fam")]


def test_the_canonical_file_is_the_target_even_if_it_is_later(spark):
    files = [file(1), file(2), file(9, key="a::a rar", kind="readable_title", reason="readable_title"), file(8, key="a::a rar", status="superseded")]
    assert edges(run(spark, files, [part(1, 1, 1), part(2, 2, 2)])) == {1: 9, 2: 9}


def test_chains_of_three_groups_end_in_one_file(spark):
    names = {1: "ab", 2: "bc", 3: "cd", 4: "d"}
    files = [file(i, name="x.rar") for i in names]
    # Groups by file index: {1, 2}, {2, 3}, {3, 4}.
    parts = [part(i * 10 + j, i, j, name="x.rar", index=index) for index, ids in ((1, (1, 2)), (2, (2, 3)), (3, (3, 4))) for j, i in enumerate(ids, 1)]
    assert edges(run(spark, files, parts)) == {2: 1, 3: 1, 4: 1}


def test_a_long_chain(spark):
    n = 40
    parts = [part(i * 10 + j, i + j, j + 1, name="x.rar", index=i + 1, files=99) for i in range(n) for j in (0, 1)]
    got = run(spark, [file(i, name="x.rar") for i in range(n + 1)], parts)
    assert edges(got) == {i: 0 for i in range(1, n + 1)}


def test_earlier_merges_join_in(spark):
    files = [file(1, reason="other"), file(5, status="superseded"), file(6), file(7, reason=regroup.KIND)]
    got = run(spark, files, [part(1, 1, 1), part(2, 1, 2), part(3, 5, 3), part(4, 7, 1), part(5, 7, 2)], [(5, 1), (6, 7)])
    assert edges(got) == {5: 1} and {p["binary_id"] for p in got["parts"]} == {1, 7}
    assert {f["binary_id"]: f["identity_reason"] for f in got["files"]}[1] == regroup.KIND


def test_nothing_to_do(spark):
    for files, parts in (([], []), ([file(1), file(2)], [part(1, 1, 1), part(2, 2, 1)]), ([file(1), file(2, name=None), file(3, family="")], [part(1, 1, 1), part(2, 2, 2), part(3, 3, 3)]), ([file(1, observed=9), file(2, observed=9)], [part(1, 1, 1), part(2, 2, 2)])):
        got = run(spark, files, parts)
        assert got["edges"] == got["dirty"] == [] and len(got["parts"]) == len(parts) and sorted(f["status"] for f in got["files"]) == ["active"] * len(files)


def test_edges_move_no_parts(spark, monkeypatch):
    """Edges alone write no table of moved parts, and parts are not written a second time when they are asked for."""
    from headerloom.plans import multipart

    seen, kept = [], regroup.written
    monkeypatch.setattr(regroup, "written", lambda df: seen.append(df.columns) or kept(df))
    edges = multipart.multipart_edges(spark, "/root/testdata/sf0.001")
    assert not any("part_id" in c for c in seen)
    seen.clear()
    made = regroup.regrouped(*multipart._given(spark, "/root/testdata/sf0.001"))
    assert sum("part_id" in c for c in seen) == 1
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, made["edges"].collect()))
