"""The pipeline's stages against plain loops on a small corpus, and the whole of it on edge rows."""

import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from headerloom.llm import bpe  # noqa: E402
from tests.llm.test_llm import classes  # noqa: E402
from tests.llm.test_llm import words as marked  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
STAGES = dict(corpus_pipeline.STAGES)


def words(n, seed):
    return marked(n, seed).replace(".", "").replace(",", "")


def corpus():
    good = [(i, " ".join(f"{words(12, 100 * i + j).capitalize()}." for j in range(6))) for i in range(60)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in words(50, i).split())) for i in range(30)]
    passage = " ".join(f"{words(11, 7000 + j)}." for j in range(6))
    r = random.Random(1)
    near = []
    for i in range(0, 60, 6):
        w = good[i][1].split()
        w[r.randrange(len(w))] = "other"
        near.append((200 + i, " ".join(w)))
    shared = [(300 + i, f"{words(9, 8000 + i)}. {passage} {words(9, 9000 + i)}.") for i in range(5)]
    rows = good + junk + near + [(400, good[3][1]), (401, good[3][1])] + shared
    return [(i, t, "en", "abc"[i % 3], len(t)) for i, t in rows], {i for i, _ in junk}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, junk = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    edges = [(500, None, None, None, None), (501, "", "en", "a", 0), (501, "", "en", "a", 0), (None, rows[5][1], "en", "b", 1)]
    spark.createDataFrame(rows + edges, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i not in junk), 0) for i, *_ in rows if i < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_quality_stage(spark, folder):
    rows, junk = corpus()
    kept = STAGES["quality classifier"](spark, table(spark, rows), folder)
    assert kept.columns == table(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - junk


def test_near_dedup_stage(spark, folder):
    rows, _ = corpus()
    of = classes([(i, t) for i, t, *_ in rows])
    got = STAGES["MinHash near-dedup"](spark, table(spark, rows), folder).collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in rows if of[r[0]] == r[0]) and len(got) < len(rows)


def test_substring_stage(spark, folder):
    rows = [r for r in corpus()[0] if r[0] >= 300 and r[0] < 400] + [(900, "One. Two.", "en", "a", 9)]
    got = {r.doc_id: r for r in STAGES["substring dedup"](spark, table(spark, rows), folder).collect()}
    for i, text, *_ in rows:
        parts = text.split(". ")
        want = text if i in (300, 900) else f"{parts[0]}. {parts[-1]}"
        assert got[i].text == want and got[i].n_chars == len(want)
    whole = [(1, rows[0][1], "en", "a", 1), (2, rows[0][1], "en", "a", 1)]
    assert [r.doc_id for r in STAGES["substring dedup"](spark, table(spark, whole), folder).collect()] == [1]
    bare = table(spark, rows).select("doc_id", "text").withColumnRenamed("doc_id", "doc_id")
    assert STAGES["substring dedup"](spark, bare, folder).columns == ["doc_id", "text"]


def test_mixing_stage(spark, folder):
    rows, _ = corpus()
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(t.split())
    total = 1.5 * sum(size.values())
    goal, open_ = {}, dict(zip(sorted(size), (5, 2, 1)))
    while True:
        left = total - sum(goal.values())
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * size[s]]
        if not over:
            goal |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            goal[s] = 2 * size[s]
            del open_[s]
    got = STAGES["mixing sources to target weights"](spark, table(spark, rows), folder).collect()
    for s in size:
        assert sum(len(r.text.split()) for r in got if r.source == s) == int(goal[s])
    texts = {i: t for i, t, *_ in rows}
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in got)


def test_token_stage(spark, folder):
    rows, _ = corpus()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {i: t for i, t, *_ in rows}
    for r in STAGES["byte-level BPE encoding and decoding"](spark, table(spark, rows), folder).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_whole_run(spark, folder):
    """Each stage by itself, one after the other, gives what run() gives; junk, copies and shared passages are gone."""
    step = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, folder).collect(), SCHEMA)
    want = sorted((r.doc_id or -1, hashlib.sha256(r.text.encode()).hexdigest()) for r in step.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in got) == want
    left = {r.doc_id for r in got}
    assert left and not left & ({i for i in range(100, 130)} | {200 + i for i in range(0, 60, 6)} | {400, 401, None})


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
