"""Vector codes against plain loops: rounds, ties, floors, unused entries, lengths, huge numbers, hot labels, nulls."""

import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from headerloom.llm import partcodes  # noqa: E402

SCHEMA = "vec_id long, embedding array<double>, label string, dim int, ids int, code int"


def by_loop(rows, words=4, rounds=2, scale=1024):
    """vec_id to (code, error, label_error, digest) of rows of one length that 4 divides, with distinct ids."""
    kept = sorted((i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    size = len(kept[0][1]) // 4
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:words]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda part, book: min((far(part, entry), e) for e, entry in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for e, parts in members.items():
                books[p][e] = [sum(x) // len(parts) for x in zip(*parts)]
    found = {i: [near(cut(v)[p], books[p]) for p in range(4)] for i, v, _ in kept}
    errors = {i: sum(d for d, _ in x) for i, x in found.items()}
    of_label = {}
    for i, _, label in kept:
        of_label[label] = of_label.get(label, 0) + errors[i]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in found[i]), errors[i], of_label[label], sha) for i, _, label in kept}


def coded(spark, rows, words=4, rounds=2):
    table = spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], SCHEMA).repartition(3)
    found = partcodes.compressed(table, words=words, rounds=rounds).collect()
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in found}


def random_rows(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(size=dim) * scale).tolist(), "hot" if i % 3 else str(i % 7)) for i in rng.permutation(n)]


@pytest.mark.parametrize("scale", [1.0, 0.002, 2e4])
def test_equal_to_loops(spark, scale, monkeypatch):
    monkeypatch.setattr(partcodes, "BLOCK", 16)
    monkeypatch.setattr(partcodes, "AT_ONCE", 5)
    rows = random_rows(120, 8, 3, scale)  # at 0.002 most parts tie; at 2e4 distances are beyond doubles
    rows += [(500, None, "x"), (501, [0.0] * 7 + [float("nan")], "x"), (502, [0.0] * 7 + [None], "x"), (503, [float("inf")] * 8, "x"), (504, rows[0][1], None)]
    assert coded(spark, rows) == by_loop(rows)


def test_fewer_rows_than_entries_and_no_rows(spark):
    rows = random_rows(3, 4, 1)
    got = coded(spark, rows, words=256, rounds=4)
    assert got == by_loop(rows, 256, 4) and all(error == 0 for _, error, _, _ in got.values())
    assert coded(spark, []) == {}


def test_repeated_rows_and_ids_without_number(spark):
    rows = [(1, [0.0] * 4, "a"), (1, [0.0] * 4, "a"), (None, [3.0] * 4, None), (2, [1.0] * 4, None)]
    table = spark.createDataFrame([(i, v, label, 1, 2, 3) for i, v, label in rows], SCHEMA)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in partcodes.compressed(table, words=2, rounds=0).collect()), key=repr)
    # Both entries begin as the repeated vector; the row without id begins none.
    assert got == sorted([(1, "00000000", 0, 0)] * 2 + [(2, "00000000", 4 * 1024**2, 40 * 1024**2), (None, "00000000", 36 * 1024**2, 40 * 1024**2)], key=repr)


def test_lengths_are_trained_apart(spark):
    rows = random_rows(40, 8, 5) + [(100 + i, v, "b") for i, v, _ in random_rows(30, 4, 6)] + [(900, [1.0, 2.0, 3.0], "c"), (901, [], "d")]
    got = coded(spark, rows)
    own = lambda keep: {k: v[:2] + v[3:] for k, v in got.items() if keep(k)}
    want = lambda x: {k: v[:2] + v[3:] for k, v in by_loop(x).items()}
    assert own(lambda k: k < 100) == want(rows[:40]) and own(lambda k: 100 <= k < 900) == want(rows[40:70])
    assert got[900][:3] == ("00000000", 0, 0) and got[901][:3] == ("00000000", 0, 0)


def test_errors_beyond_a_long_are_its_greatest(spark):
    rows = [(1, [0.0] * 4, "a"), (2, [1e300] * 4, "a"), (3, [-1e300] * 4, "a")]
    got = coded(spark, rows, words=1, rounds=0)
    assert got[2][1] == got[3][1] == got[1][2] == 2**63 - 1 and got[1][1] == 0
