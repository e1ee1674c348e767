"""Alignment of two tokenizers against a walk over both, with rare pairs, forgotten chunks, long texts and texts that can't be given back."""

import collections
import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from headerloom.llm import crosstok  # noqa: E402

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, row int, pair string, n int"
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "  two  spaces\n\n and\ttabs  ", "Ünïcödé 中文字符 漢字 😀 test", "", None, " ", "\n", "x", "lower▁line", "<|endoftext|> and <s> </s> <unk>", "a\0b", "don't we'll it's",
    "word " * 500, "中" * 300, "　wide space  em", "The quick brown fox jumps over the lazy dog.", "é ﬁ Å", "numbers 123456 7.89e-10 0xFF", "tail ", " head", "a b", "\x1c x \x85 y",
]


@pytest.fixture(scope="module")
def pair():
    return crosstok.Pair(open(A, "rb").read(), open(B, "rb").read())


def by_walk(pair, texts):
    counts, found = collections.Counter(), []
    for text in texts:
        whole = pair.encode(" " + text) if text else None
        if whole is None:
            found.append(None)
            continue
        a, b = (x.tolist() for x in whole)
        i = j = at_a = at_b = 0
        links, groups, own = [], [], ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(pair.bytes_a[a[i]]), at_b + len(pair.bytes_b[b[j]])
            if end_a <= end_b:
                own[0].append(a[i])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                own[1].append(b[j])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(own)
                own = ([], [])
        counts.update(links)
        found.append((a, b, groups, links))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out, counts, found


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "p", 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def aligned(spark, texts):
    found = crosstok.aligned_documents(table(spark, texts), A, B).orderBy("doc_id").collect()
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found]


@pytest.mark.parametrize(("common", "chunks"), [(1 << 20, 1 << 17), (20, 1 << 17), (20, 10), (0, 3)])
def test_equal_to_a_walk(spark, pair, monkeypatch, common, chunks):
    monkeypatch.setattr(crosstok, "COMMON", common)
    monkeypatch.setattr(crosstok, "CHUNKS", chunks)
    assert aligned(spark, TEXTS) == by_walk(pair, TEXTS)[0]


def test_texts_that_are_not_given_back_have_no_tokens(spark, pair):
    assert [x[:4] for x in aligned(spark, ["lower▁line", "fine", "fine and lower▁line"])] == [(0, 0, 0, 0), aligned(spark, ["fine"])[0][:4], (0, 0, 0, 0)]


def test_long_texts_in_pieces(spark, pair, monkeypatch):
    text = "Some words, 中文 and more; then\n\nnext lines here. " * 300
    want = by_walk(pair, [text, "short", text + "▁"])[0]
    monkeypatch.setattr(crosstok, "STEP_BYTES", 1000)
    monkeypatch.setattr(crosstok, "CHUNKS", 20)
    assert len(crosstok.pieces_of(text, 1000)) > 5 and "".join(crosstok.pieces_of(text, 1000)) == " " + text
    assert aligned(spark, [text, "short", text + "▁"]) == want


def test_ids_and_counts(spark, pair):
    _, counts, found = by_walk(pair, TEXTS)
    ids = crosstok.token_ids(table(spark, TEXTS), A, B).orderBy("doc_id").collect()
    assert [(r.ids_a, r.ids_b) for r in ids] == [(x[0], x[1]) if x else ([], []) for x in found]
    got = crosstok.pair_counts(table(spark, TEXTS), A, B).collect()
    assert {(r.id_a, r.id_b): r.n for r in got} == counts


def test_an_empty_table(spark):
    assert aligned(spark, []) == []
    assert crosstok.pair_counts(table(spark, []), A, B).collect() == []
