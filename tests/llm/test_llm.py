"""The corpus operators against brute force, on small tables with nulls, empty texts, repeated rows and clashing names."""

import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from headerloom.llm import additive, bpe, dartminhash, hyperlang, mix, qda, spans, tagpaths, urlfilter, vafile  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANDOM = random.Random(5)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + r.choice(["", "", "", ".", ","]) for _ in range(n))


EDGES = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (903, "one"), (None, "two words"), (904, "x" * 200_000)]
DOC = "doc_id long, text string, d string, t string, later string, ids string, label int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "d", "t", "l", "i", 9) for i, t in rows], DOC)


def jaccard(a, b, n=5):
    def sets(t):
        w = t.split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def classes(texts):
    """doc_id to least doc_id of its component, by all pairs."""
    of = {i: i for i, _ in texts}
    find = lambda i: i if of[i] == i else find(of[i])
    for i, a in texts:
        for j, b in texts:
            if i < j and (a == b or a.split() and b.split() and jaccard(a, b) >= 0.8):
                x, y = sorted((find(i), find(j)))
                of[y] = x
    return {i: find(i) for i in of}


def test_near_duplicates(spark):
    base = [words(120, s) for s in range(6)]
    rows = []
    for k, text in enumerate(base):
        rows.append((len(rows), text))
        for n in range(3):
            w = text.split()
            for at in random.Random(k * 10 + n).sample(range(len(w)), 1 + n * 6):
                w[at] = "changed" + str(at)
            rows.append((len(rows), " ".join(w)))
    rows += [(50, base[0]), (51, base[0]), (52, "short text"), (53, "short text")]
    got = dartminhash.near_duplicates(docs(spark, rows + EDGES)).collect()
    want = classes(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None and r.doc_id < 900} == want
    assert len(got) == len(rows) + len(EDGES)
    assert {r.class_id for r in got if r.doc_id is None} == {None}
    assert dartminhash.near_duplicates(docs(spark, [])).count() == 0


def test_mix_takes_each_target(spark):
    rows = [(i, words(5 + i % 9, i), ["a", "b", None, "c"][min(i % 8, 3)]) for i in range(400)]
    table = spark.createDataFrame(rows + [(1000, None, "a"), (1001, "", None), (1002, "x", "c"), (1002, "x", "c")], "doc_id long, text string, source string")
    got = mix.mix(table).collect()
    assert len(got) == table.count()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.taken for r in own) == int(own[0].target)
        assert sum(r.size for r in own) == own[0].source_size
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mix.mix(table.limit(0)).count() == 0
    mixed = mix.mixed_documents(table)
    assert mixed.columns == table.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)


def embeddings(spark, n=600, dim=16):
    x = np.random.default_rng(3).normal(size=(n, dim)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [None] * dim), (n + 2, [float("nan")] * dim), (n + 3, [0.0] * dim), (n + 4, x[0].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), x


def test_additive_recall(spark):
    table, x = embeddings(spark)
    x = np.vstack([x, x[:1]])
    ids = np.r_[np.arange(600), 604]
    got = {}
    for r in additive.nearest(table, "vec_id % 20 = 0", k=10).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in range(0, 600, 20):
        score = x @ x[q]
        own = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        assert [r.rank for r in sorted(got[q], key=lambda r: r["rank"])] == list(range(1, 11)) or len(got[q]) == 10
        assert all(abs(r.score - float(x[list(ids).index(r.vec_id)] @ x[q])) < 1e-9 for r in got[q])
        hits += len({ids[i] for i in own} & {r.vec_id for r in got[q]})
    assert hits / (30 * 10) >= 0.9
    assert additive.nearest(table.limit(0), "true").count() == 0


def test_exact_top_k(spark):
    table, x = embeddings(spark)
    rows = [(i, np.floor(v * 1024).astype(int)) for i, v in enumerate(x)] + [(603, np.zeros(16, int)), (604, np.floor(x[0] * 1024).astype(int))]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vafile.top_k(table, "vec_id % 100 = 0", k=5).collect()}
    for q in range(0, 600, 100):
        best = sorted((-int(v @ rows[q][1]), i) for i, v in rows if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert vafile.top_k(table.where("vec_id < 3"), "vec_id = 0").count() == 2
    assert vafile.top_k(table.limit(0), "true").count() == 0


PAGES = {
    "<html><body><nav><a href=1>Home</a></nav><article><h1>Title &amp; more</h1><p>First&nbsp;<b>bo</b>ld\n text.<p>Second.</article><footer>Foot, note.</footer>": "Title & more First bold text. Second.",
    "<body><div id=content><h2>Head</h2><p>A long paragraph, with commas, and a stop. And another one, too.</p><p>A second paragraph, with commas, and a stop. And another one, too.</p><p>A third one, with commas, and a stop. And another one, too, and more.</p><p>Short</p></div><div class=sidebar><p>Side text that is short</p></div><div id=comments><p>First! I agree.</p></div>": "Head A long paragraph, with commas, and a stop. And another one, too. A second paragraph, with commas, and a stop. And another one, too. A third one, with commas, and a stop. And another one, too, and more. Short",
    "<main><p>A text, with <script>var a='</p>'</script>marks, goes on and on, as long as it has, well, something to say.</p></main><form>Name <input></form><div class='cookie-notice'>Cookies</div>": "A text, with marks, goes on and on, as long as it has, well, something to say.",
    "plain text": "plain text",
    "": "",
    "<!-- open": "",
}


def test_main_text(spark):
    rows = [(i, f"u{i}", h) for i, h in enumerate(PAGES)] + [(99, None, None), (99, None, None)]
    got = tagpaths.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: t for i, t in enumerate(PAGES.values())} | {99: ""}
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/", "http://example.com/enx", "http://notexample.com/en/", "http://net/es/", "http://x.net/es", "ftp://b.net/fr/a://c.com/", "http://com", "http://a.com?b"] * 3

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = urlfilter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: judge(u) for i, u in enumerate(urls)}
    assert urlfilter.judged(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_languages(spark):
    langs = {"aa": "abcdef", "bb": "efghij", "cc": "ñöüabx"}
    make = lambda k, s: " ".join("".join(random.Random(f"{k}{s}{i}").choice(langs[k]) for _ in range(6)) for i in range(30))
    rows = [(i, make(k, i), k) for i, k in enumerate(list(langs) * 30)]
    table = spark.createDataFrame(rows + [(500, "abc", None)], "doc_id long, text string, lang string")
    learned = hyperlang.prototypes(table.where("doc_id % 3 <> 1 or doc_id > 60"))
    got = {r.doc_id: r for r in hyperlang.identified(docs(spark, [(i, t) for i, t, _ in rows] + [(600, None), (601, "12 !"), (602, "\U00010400b")]), learned).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows]) > 0.95
    assert [got[i].lang_pred for i in (600, 601)] == ["und", "und"] and got[602].lang_pred in langs
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in hyperlang.identified(docs(spark, [(1, "a")]), {}).collect()} == {"und"}


def test_quality(spark):
    good = [(i, words(60, i)) for i in range(120)]
    bad = [(i, " ".join(w.upper() + "!!" for w in words(60, i).split())) for i in range(120, 200)]
    table = docs(spark, good + bad + EDGES)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(200) if i % 5] + [(1, None), (2, 7)], "doc_id long, label int")
    got = {r.doc_id: r for r in qda.scored(table, labels).collect()}
    assert np.mean([got[i].predicted == (i < 120) for i in range(0, 200, 5)]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 200 + len({i for i, _ in EDGES})
    kept = qda.kept(table, labels)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert {r.score for r in qda.scored(table, labels.limit(0)).collect()} == {0.5}


def test_bpe(spark):
    ranks = bpe.read_ranks(PATH)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    letters = "''''sstdmrevlLabZ  \n\t 　9½!!.ß中😀é́​"
    texts = ["".join(RANDOM.choice(letters) for _ in range(n % 90)) for n in range(600)] + ["<|endoftext|> it's", "a" * 3000, "!" * 3000, "\n" * 50 + "x", None, ""]
    table = docs(spark, list(enumerate(texts)) + [(None, "x"), (3, "y")])
    coded = bpe.encoded(table, PATH, keep=("d",))
    for r in coded.where("doc_id is not null and d = 'd'").collect():
        if r.doc_id == 3:
            continue
        text = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text)
        assert (r.ends[-1] if r.ends else 0) == len(text.encode())
    for r in bpe.digests(coded, PATH).where("doc_id <> 3").collect():
        text = (texts[r.doc_id] or "").encode()
        ids = own.encode_ordinary(text.decode())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
    assert {r.doc_id: bytes(r.body).decode() for r in bpe.decoded(coded.where("doc_id <> 3"), PATH).collect()} == {i: t or "" for i, t in enumerate(texts) if i != 3}


def test_sentence_spans(spark):
    sentences = lambda n, s: [" ".join("".join(random.Random(f"{s}{i}{j}").choice("abcdefgh") for _ in range(5)) for j in range(9)) + "." for i in range(n)]
    shared = sentences(6, "shared")
    rows = []
    for i in range(40):
        mine = sentences(5, i)
        rows.append((i, " ".join(mine[:2] + (shared if i % 3 == 0 else []) + mine[2:])))
    rows += [(100, " ".join(sentences(5, 7))), (101, "A line.\nA line.\nA line.")]
    got = {r.doc_id: r.text for r in spans.deduplicated(docs(spark, rows + EDGES)).collect() if r.doc_id is not None}

    def brute():
        """Windows of every sentence, the first place of each kept."""
        first, covered = {}, {}
        for i, text in sorted(rows):
            parts = [x for line in text.split("\n") for x in line.replace(". ", ".\x00").split("\x00")]
            size = [len(x.split()) for x in parts]
            for a in range(len(parts)):
                b = a + 2
                while b < len(parts) and sum(size[a:b]) < 25:
                    b += 1
                if b <= len(parts) and sum(size[a:b]) >= 25:
                    if tuple(parts[a:b]) in first:
                        covered.setdefault(i, set()).update(range(a, b))
                    first.setdefault(tuple(parts[a:b]), i)
            if i in covered:
                yield i, " ".join(x for k, x in enumerate(parts) if k not in covered[i])
            else:
                yield i, text

    assert {i: got[i] for i, _ in rows} == dict(brute())
    assert [got[i] for i in (900, 901, 902, 903)] == [None, "", " \n\t", "one"]
    assert spans.deduplicated(docs(spark, [])).count() == 0
    assert spans.deduplicated(docs(spark, rows)).columns == docs(spark, []).columns


@pytest.mark.parametrize("parts", [1, 8])
def test_sentence_spans_of_repeated_rows(spark, parts):
    passage = " ".join(" ".join(f"{c}{s}{j}" for j in range(20)) + "." for s in range(5) for c in "p")
    other = passage.replace("p", "q")
    rows = [(3, passage), (3, passage), (8, "Before it. " + passage), (None, other), (None, other), (None, "Before it. " + other)]
    got = spans.deduplicated(docs(spark, rows).repartition(parts)).collect()
    assert sorted(r.text for r in got if r.doc_id is not None) == sorted([passage, passage, "Before it."])
    # The three null ids are in the order of their text hashes: the passage stays in the first document, in each of its rows.
    nulls = [r.text for r in got if r.doc_id is None]
    assert sorted(nulls) in (sorted([other, other, "Before it."]), sorted(["", "", "Before it. " + other]))


def test_sentence_spans_against_all_runs(spark):
    def passage(lengths, name):
        return [" ".join(f"{name}{s}x{j}" for j in range(n)) + "." for s, n in enumerate(lengths)]

    r, texts = random.Random(11), []
    shared = [passage(x, f"p{k}") for k, x in enumerate([(14, 13, 8), (45, 39), (45, 20, 4), (8, 13, 14), (4, 20, 45), (39, 45), (3, 30, 2, 2), (50,), (10, 10), (30,)])]
    shared += [passage([r.choice([1, 3, 8, 14, 24, 25, 39, 40, 60]) for _ in range(r.randint(2, 6))], f"r{k}") for k in range(30)]
    for k, own in enumerate(shared):
        for copy in range(3):
            before, after = (passage([r.randint(1, 30)], f"{w}{k}c{copy}") for w in "ba")
            texts.append((before if copy != 1 else []) + own + (after if copy != 2 else []))
    texts.append(shared[0] + shared[0] + passage([3], "z"))

    first, covered = {}, {}
    for i, parts in enumerate(texts):
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                size = sum(len(x.split()) for x in parts[a:b])
                if b - a >= 2 and size >= 25 or b - a == 1 and size >= 40:
                    if tuple(parts[a:b]) in first:
                        covered.setdefault(i, set()).update(range(a, b))
                    first.setdefault(tuple(parts[a:b]), (i, a))
    want = {i: " ".join(x for k, x in enumerate(parts) if k not in covered.get(i, ())) for i, parts in enumerate(texts)}
    got = spans.deduplicated(docs(spark, [(i, " ".join(parts)) for i, parts in enumerate(texts)]), count_col="removed").collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: r.removed for r in got} == {i: len(covered.get(i, ())) for i in want}


def test_mixed_documents_of_repeated_ids(spark):
    text = lambda n, name: " ".join(f"{name}{j}" for j in range(n))
    rows = [(i, text(20 + i, f"d{i}x"), "abc"[i % 3]) for i in range(30)]
    rows += [(None, "", "a"), (None, None, "a"), (None, text(70, "n"), "a"), (None, text(90, "m"), "b"), (None, text(71, "o"), "c")]
    rows += [(100, "", "a"), (100, text(75, "p"), "b"), (100, text(76, "q"), "c"), (100, text(3, "s"), "c"), (101, text(80, "t"), "c"), (101, None, "c"), (101, text(81, "u"), "a")]
    rows += [(None, text(5, "v"), "r")] * 7 + [(102, text(5, "w"), None)] * 7
    table = spark.createDataFrame([(*r, k, 0) for k, r in enumerate(rows)], "doc_id long, text string, source string, k long, n_chars int").repartition(3)
    own = {(i, s, len((t or "").split())): t for i, t, s in rows}
    want = []
    for r in mix.mix(table).collect():
        held, left = own[r.doc_id, r.source, r.size], r.taken
        while left > 0:
            want.append((r.doc_id, r.source, " ".join(held.split()[:left])))
            left -= r.size
    mixed = mix.mixed_documents(table)
    assert mixed.columns == table.columns
    got = mixed.collect()
    assert sorted([(r.doc_id, r.source, r.text) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in got)
    # Rows equal in all but k are taken as often as each other, but for one epoch.
    for source in ("r", None):
        times = [sum(r.k == k for r in got) for k, x in enumerate(rows) if x[2] == source]
        assert max(times) - min(times) <= 1
    assert mix.mixed_documents(table.limit(0)).count() == 0
