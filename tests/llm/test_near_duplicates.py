"""Near-duplicate classes: repeated ids and rows, null ids, weights by count, hot buckets."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from headerloom.llm import dartminhash  # noqa: E402
from tests.llm.test_llm import classes, docs, jaccard, words  # noqa: E402


def changed(text, n, seed):
    w = text.split()
    for at in random.Random(seed).sample(range(len(w)), n):
        w[at] = f"new{seed}x{at}"
    return " ".join(w)


def test_one_document_of_several_texts(spark):
    a, b, c = (words(60, s) for s in (1, 2, 3))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, None), (11, None), (13, c), (None, c), (None, words(50, 4)), (None, words(50, 4))]
    got = dartminhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.is_first) for r in got if r.doc_id) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True), (9, 9, True), (11, 11, True), (13, 9, False)]
    assert sorted((r.class_id is None, r.class_id) for r in got if r.doc_id is None) == [(False, 9), (True, None), (True, None)]


@pytest.mark.parametrize("parts", [1, 5])
def test_distinct_documents(spark, parts):
    a, b, c, d = (words(80, s) for s in (1, 2, 3, 4))
    near = changed(a, 2, 9)
    assert jaccard(a, near) >= 0.8
    rows = [(3, a), (5, near), (5, b), (5, b), (6, b), (None, c), (None, c), (8, None), (8, None), (None, None), (9, "x"), (None, "x"), (4, d), (4, "y"), (4, ""), (None, changed(d, 1, 2))]
    table = docs(spark, rows).repartition(parts)
    got = dartminhash.distinct_documents(table)
    assert got.columns == table.columns
    want = [(3, a), (5, b), (None, c), (8, None), (8, None), (None, None), (9, "x"), (4, d), (4, "y"), (4, "")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert dartminhash.distinct_documents(table.limit(0)).count() == 0


def test_weights_by_count(spark):
    rng = np.random.default_rng(1)
    element = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    x, y = rng.uniform(0.3, 4, 200), rng.uniform(0.3, 4, 200)
    k = 4096
    one = dartminhash.signatures(np.r_[element, element], np.r_[x, y], np.repeat([0, 1], 200), 2, k)
    weighted = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((one[0] == one[1]).mean() - weighted) < 4 * (weighted * (1 - weighted) / k) ** 0.5
    base = words(60, 1)
    rows = [(1, base), (2, base), (3, changed(base, 1, 3)), (4, words(60, 5)), (5, "a b c d e " * 30)]
    got = {r.doc_id: r.class_id for r in dartminhash.near_duplicates(docs(spark, rows), weights="count").collect()}
    assert got == classes(rows)


def test_hot_buckets(spark, monkeypatch):
    """A bucket of many blocks: two large classes that only a few pairs link, and strays that share its band."""
    monkeypatch.setattr(dartminhash, "BLOCK", 16)
    r = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):  # chains of texts, each 0.8 or more from some and less from most
        w = list(base)
        for at in r.sample(range(0, 200, 4), r.randint(1, 9)):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    rows += [(400 + i, words(100, i)) for i in range(40)]
    got = {x.doc_id: x.class_id for x in dartminhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == classes(rows)


def test_block_pairs_meet_once(spark):
    members = [(7, node, node if node % 3 else 0, node % 3 == 0, bytes([node]), 3, 8) for node in range(100)] + [(8, node, node, False, b"", 1, 1) for node in range(5)]
    rows = spark.createDataFrame(members, "key long, node long, class_id long, main boolean, sig binary, rest int, of int")
    seen = {}
    for pair in dartminhash._block_pairs(rows).collect():
        for x in pair.a:
            for y in pair.b:
                if x.node < y.node or pair.a != pair.b and x.node > y.node:
                    key = (len(x.sig), *sorted((x.node, y.node)))
                    seen[key] = seen.get(key, 0) + 1
    want = {(1, x, y) for x in range(100) for y in range(x + 1, 100) if x % 3 or y % 3} | {(0, x, y) for x in range(5) for y in range(x + 1, 5)}
    assert want <= set(seen) and set(seen.values()) == {1} and not any(k[0] and k[1] % 3 == 0 and k[2] % 3 == 0 for k in seen)


def test_by_key_splits_hot_keys(spark):
    rows = spark.range(30_000).selectExpr("id as node", "case when id % 3 = 0 then -1 else id end as key")
    facts = rows.groupBy("key").count().withColumnRenamed("count", "n").where("key % 2 <> 0")
    got = dartminhash.by_key(rows, facts, "key", 30_000)
    assert got.count() == rows.where("key % 2 <> 0").count()
    assert got.groupBy("key").count().where("count > 1").collect() == [(-1, 10_000)]
