"""Language profiles and the quality discriminant against plain loops, and on edge rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from headerloom.llm import hyperlang, qda  # noqa: E402
from tests.llm.test_llm import docs, words  # noqa: E402


def letters(text):
    out = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return " " + " ".join(out.split()) + " " if out.strip() else ""


def bundle(text, width):
    """The sum of the products of rotated letter vectors, gram by gram."""
    plain, total = letters(text), np.zeros(width)
    sign = {c: hyperlang._vectors(np.array([ord(c)]), width)[0].astype(float) for c in set(plain)}
    for i in range(len(plain) - 2):
        a, b, c = (sign[x] for x in plain[i : i + 3])
        total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


TEXTS = ["Ab cd", "  ab,cd", "a", "ab", "Straße ÑANDÚ ñandú", "x1y2z3 x y z", "İstanbul ıI", "中文 字符 mixed Text\n\nlines", "\U00010400\U00010428 b", "''!!", ""]


def test_bundles_by_loops():
    import pyarrow as pa

    from headerloom.llm.shared import texts_of

    got = hyperlang.Bundler(512, 3).bundles(*texts_of(pa.array(TEXTS)))
    assert np.array_equal(got, np.array([bundle(t, 512) for t in TEXTS]))


def test_letter_vectors_are_nearly_orthogonal():
    x = hyperlang._vectors(np.arange(97, 123), 512).astype(float)
    off = (x @ x.T)[~np.eye(26, dtype=bool)] / 512
    assert set(np.unique(x)) == {-1.0, 1.0} and abs(off).max() < 0.25 and abs(off.mean()) < 0.02


def test_predictions_by_loops(spark):
    r = random.Random(2)
    make = lambda alphabet, n: " ".join("".join(r.choice(alphabet) for _ in range(5)) for _ in range(n))
    rows = [(i, make(["abcdefg", "efghijk", "ijklmno"][i % 3], 1 + i % 12), ["b", "a", "c"][i % 3]) for i in range(90)]
    learned = hyperlang.prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    unit = lambda x: x / np.linalg.norm(x)
    want = {}
    for _, text, lang in rows:
        want[lang] = want.get(lang, 0) + unit(bundle(text, 512))
    assert sorted(learned) == ["a", "b", "c"] and all(np.allclose(learned[x], want[x]) for x in want)
    table = docs(spark, [(i, t) for i, t, _ in rows])
    for x in hyperlang.identified(table, learned).collect():
        cosine = {lang: unit(bundle(rows[x.doc_id][1], 512)) @ unit(want[lang]) for lang in want}
        assert x.lang_pred == max(sorted(cosine), key=cosine.get) and x.score == pytest.approx((max(cosine.values()) + 1) / 2)


def test_language_edges(spark):
    """Equal prototypes go to the first name; repeated, long and null rows; an empty table; columns of other names."""
    same = spark.createDataFrame([(1, "abc abc", "zz"), (2, "abc abc", "yy"), (3, None, "xx"), (4, "12", "ww"), (5, "abc", None)], "doc_id long, text string, lang string")
    learned = hyperlang.prototypes(same)
    assert sorted(learned) == ["yy", "zz"]
    rows = [(1, "abc"), (1, "abc"), (None, "abc"), (2, "abc " * 100_000), (3, None), (4, "9"), (5, "x" * 300_000)]
    got = hyperlang.identified(docs(spark, rows), learned).collect()
    assert Counter(r.lang_pred for r in got) == {"yy": 5, "und": 2}
    assert hyperlang.identified(docs(spark, []), learned).count() == 0
    assert hyperlang.prototypes(same.limit(0)) == {}


def statistics(text):
    """The statistics of one text, word by word."""
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
    if not w:
        return [0.0] * len(qda.NAMES)
    raw, size = text.encode(), [len(x.encode()) for x in w]
    n, mean = len(w), sum(size) / len(w)
    ascii_ = [chr(b) for b in raw if b < 128 and not chr(b).isspace() and 33 <= b < 127]
    solid = len(ascii_) + sum(b >= 128 for b in raw)
    share = lambda x, of: math.sqrt(min(max(x / of, 0), 1))
    marks = sum(not c.isalnum() for c in ascii_)
    last = [x.encode()[-1:] for x in w]
    ends = lambda of: sum(x in of for x in last)
    lines, at = [], 0
    for part in text.split("\n")[:-1]:
        lines.append(part + "\n")
        at += len(part) + 1
    lines += [text[at:]] if text[at:] else []
    stops = [b".", b"?", b"!", b":", b";", b","]
    odd = sum(x == b"!" or x not in stops and 33 <= x[0] < 127 and not x.isalnum() for x in last)
    full = ends([b".", b"?"])
    return [
        math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(max(sum(s * s for s in size) / n - mean**2, 0))), math.log1p(max(size)),
        len(set(w)) / n**0.8, share(sum(c.isupper() for c in ascii_), solid), share(sum(c.isdigit() for c in ascii_), solid), share(marks, solid),
        share(odd, n), share(ends(stops), n), share(sum(b >= 128 for b in raw), solid), math.log1p(len(lines) / n * 10),
        share(len(lines) - len(set(lines)), len(lines)), math.log(n / (full + 1)),
    ]


def test_statistics_by_loops():
    import pyarrow as pa

    from headerloom.llm.shared import texts_of

    r = random.Random(6)
    texts = ["".join(r.choice("abcAB019 .,!?:;#\n\té中 ") for _ in range(r.randint(0, 300))) for _ in range(200)] + ["", " \n", "one", "a\na\na\nb", "A!! B!! c."]
    got = qda.statistics(*texts_of(pa.array(texts)))
    assert np.allclose(got, np.array([statistics(t) for t in texts]))


def test_scores_by_log_densities():
    """Scores against densities with inverses and determinants in place of Cholesky factors."""
    r = np.random.default_rng(3)
    x = {0: r.normal(0, 1, (80, 14)) @ r.normal(size=(14, 14)), 1: r.normal(0.4, 1, (120, 14)) @ r.normal(size=(14, 14))}
    model = qda.Discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()})
    scatter = {c: (v - v.mean(0)).T @ (v - v.mean(0)) for c, v in x.items()}
    whole = (scatter[0] + scatter[1]) / 200
    scale = np.sqrt(np.diag(whole))
    points = np.concatenate([x[0][:20], x[1][:20]])
    dense = {}
    for c, v in x.items():
        cov = (0.7 * scatter[c] / len(v) + 0.3 * whole) / np.outer(scale, scale)
        cov = 0.98 * cov + 0.02 * np.trace(cov) / 14 * np.eye(14)
        z = (points - v.mean(0)) / scale
        dense[c] = np.log(len(v) / 200) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
    assert np.allclose(model.score(points), 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -500, 500))))


def test_quality_edges(spark):
    rows = [(i, words(30, i)) for i in range(20)] + [(30, "x" * 300_000), (31, words(40_000, 3)), (32, None), (33, ""), (33, ""), (None, "y")]
    labels = lambda pairs: spark.createDataFrame(pairs, "doc_id long, label int")
    for label in (0, 1):  # a single class is all that is known
        got = qda.scored(docs(spark, rows), labels([(i, label) for i in range(9)])).collect()
        assert len(got) == len(rows) and {r.score for r in got} == {float(label)}
    some = labels([(i, i % 2) for i in range(20)] + [(33, 1), (99, 1), (None, 0)])
    got = qda.scored(docs(spark, rows), some).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (32, 33)}) == 1
    assert qda.scored(docs(spark, []), some).count() == 0 and qda.kept(docs(spark, []), some).count() == 0
