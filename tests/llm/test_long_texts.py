"""Long texts are read in steps: the same results as at once, and memory of a small multiple of the text."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from headerloom.llm import bpe, dartminhash, hyperlang, qda, shared, spans  # noqa: E402


def test_slice_hashes_do_not_depend_on_place_or_step(monkeypatch):
    r = random.Random(2)
    parts = ["a", "bc" * 40, "d" * 1000, "bc" * 40, "x" * 257, "a", "d" * 1000, "é" * 300]
    raw, at = shared.texts_of(pa.array([" ".join(r.choice(parts) for _ in range(60))]))
    start, end, _ = shared.words_of(raw, at)
    want = shared.slice_hashes(raw, start, end)
    body, seen = raw.tobytes(), {}
    for i, j, h in zip(start, end, want):
        assert seen.setdefault(body[i:j], h) == h
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(shared, "STEP_BYTES", 100)
    monkeypatch.setattr(shared, "_powers", [])
    assert np.array_equal(shared.slice_hashes(raw, start, end), want)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_grams_by_pieces(size):
    r = random.Random(size)
    for text in ["".join(r.choice("abé中 .\n\U00010400Z") for _ in range(r.randint(1, 80))) for _ in range(60)] + ["a", "  ", " a ", "....", "ab cd"]:
        raw, at = shared.texts_of(pa.array([text]))
        _, gram, count = hyperlang.grams_of(raw, at)
        got = hyperlang.long_grams(raw, at_once=size)
        assert dict(zip(got[0], got[1])) == dict(zip(gram, count))


def test_signatures_by_slices(monkeypatch):
    rng = np.random.default_rng(4)
    element, row = rng.integers(1, 1 << 62, 3000).astype(np.uint64), np.sort(rng.integers(0, 9, 3000))
    weight = rng.uniform(0.5, 2, 3000)
    want = dartminhash.signatures(element, weight, row, 9, 64)
    monkeypatch.setattr(dartminhash, "AT_ONCE", 37)
    assert np.array_equal(dartminhash.signatures(element, weight, row, 9, 64), want)


def test_tokens_of_long_texts(spark, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    r = random.Random(9)
    text = "".join(r.choice(["it's", " word", "  ", "\n", "é", " 中文", "123", " a", " b c", "!!", " The", "\t"]) for _ in range(4000))
    codec = bpe.Codec(bpe.read_ranks(path), bpe.code_classes())
    raw, at = shared.texts_of(pa.array([text]))
    for every in (5, 64, 1000, 1 << 20):
        cuts = [*bpe.safe_cuts(raw, every), len(raw)]
        ids = np.concatenate([codec.encode(raw[i:j], np.array([0, j - i]))[0] for i, j in zip(cuts, cuts[1:])])
        assert ids.tolist() == own.encode_ordinary(text) and codec.decode(ids).tobytes() == raw.tobytes()
    assert len(bpe.safe_cuts(raw, 64)) > 50
    long = " ".join(r.choice(["some", "Words", "here's", "x1"]) for _ in range(150_000))
    (row,) = bpe.encoded(spark.createDataFrame([(1, long)], "doc_id long, text string"), path).collect()
    assert list(row.ids) == own.encode_ordinary(long) and row.ends[-1] == len(long)


def test_memory_of_long_texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", "."]) for _ in range(3000)]
    raw, at = shared.texts_of(pa.array([" ".join(r.choice(words) for _ in range(900_000))]))

    def signature():
        hashes, row = shared.shingles_of(raw, at, 5)
        return dartminhash.signatures(*dartminhash._weighted(hashes, row, "set"), 1, 64)

    for run in (signature, lambda: hyperlang.Bundler().bundles(raw, at), lambda: qda.statistics(raw, at), lambda: spans.spans_of(raw, at)):
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 20 * len(raw)
