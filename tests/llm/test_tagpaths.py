"""Tag-path ratios: pages of several shapes, the ratios against plain loops, the threshold's effect, hostile pages."""

import collections
import hashlib
import math
import os
import re
import tracemalloc

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("public_tokenizers")

from headerloom.llm import tagpaths  # noqa: E402

LONG = "<p>A long paragraph, with commas, and a stop. And another one, too, that goes on for a while.</p>"
TEXT = "A long paragraph, with commas, and a stop. And another one, too, that goes on for a while."
PAGES = {
    "lists": (f"<article><h1>T</h1>{LONG}<ul><li>milk</li><li>eggs</li></ul><h2><a href=1>Sub</a></h2><p>So.</p><table><tr><td>12</table></article><div class=zz>Buy now!</div>", f"T {TEXT} milk eggs Sub So. 12"),
    "short box inside": (f"<article><h1>T</h1>{LONG}<div class=xq>Shoes</div>{LONG}<ul class=more><li><a href=1>One story</a><li><a href=2>Another</a></ul><p>End.</p></article>", f"T {TEXT} {TEXT} End."),
    "no article": (f"<body><div class=top>Site name</div><div class=mid><h1>Title</h1>{LONG}{LONG}<p>So.</p></div><div class=low><h3>Links</h3><ul><li><a>aa</a><li><a>bb</a></ul></div><div class=end>Shoes</div>", f"Title {TEXT} {TEXT} So."),
    "main": (f"<main><div class=content><header><h1>Head</h1></header>{LONG}{LONG}<section><h2>Sec</h2><p>Also short.</p></section><aside>Side, long.</aside></div><div class=zz><p>Nice one.</p></div></main>", f"Head {TEXT} {TEXT} Sec Also short."),
    "boxes inside": (f"<article><h1>A head</h1><div class=lead><p>Short lead here, with a mark or two.</p></div><div class=body>{LONG * 6}<p>So.</p></div></article><div class=foo>{LONG}</div>", f"A head Short lead here, with a mark or two. {' '.join([TEXT] * 6)} So."),
    "nested boxes": (f"<div id=w><div class=q><h1>Site</h1></div><div class=r><div class=s><h2>Story</h2>{LONG * 4}</div><div class=t><ul><li><a>x</a></ul><p>Tip, of the day.</p></div></div></div>", f"Story {' '.join([TEXT] * 4)}"),
    "sibling articles": (f"<main>{LONG}<article class='post odd'>{LONG}</article><article class='post even'><p>A short one.</p></article></main>", f"{TEXT} {TEXT} A short one."),
    "long footer": (f"<article><h1>Tt</h1>{LONG}{LONG}</article><footer>{LONG}</footer>", f"Tt {TEXT} {TEXT}"),
    "no text": ("<nav>a b</nav><script>x</script><form><input value=z><select><option>y</select></form>", ""),
    "an advert in an article": (f'<body><article><h1>T t</h1>{LONG}<div class="xq7">Buy now! Huge discount on shoes</div>{LONG}</article></body>', f"T t {TEXT} {TEXT}"),
    "a story in a box of any name": (f'<nav>x</nav><div class="post-widgets"><h1>Ti</h1>{LONG * 3}</div><footer>f</footer>', f"Ti {' '.join([TEXT] * 3)}"),
    "a paragraph of any name": (f'<article>{LONG}<div class="share-price tags">{LONG}</div></article>', f"{TEXT} {TEXT}"),
    "a form around": (f"<form action=x><article>{LONG}{LONG}</article><input><button>Go</button></form><footer>f, g.</footer>", f"{TEXT} {TEXT}"),
    "layout table": (f"<table><tr><td class=menu><a>x</a><br><a>y</a></td><td>{LONG}</td></tr></table>", TEXT),
    "hidden": (f"<div>{LONG}<p hidden>no</p><p style='display: none'>no</p></div>", TEXT),
}


def test_pages_of_several_shapes():
    assert {k: tagpaths.main_text(page) for k, (page, _) in PAGES.items()} == {k: want for k, (_, want) in PAGES.items()}


def test_threshold_decides():
    page = PAGES["short box inside"][0] + "<footer>Foot, note.</footer>"
    found = [tagpaths.main_text(page, t) for t in (0.0, 0.45, 0.9, 2.0)]
    assert found[0] == f"T {TEXT} Shoes {TEXT} One story Another End. Foot, note."
    assert found[1:] == [f"T {TEXT} {TEXT} End.", f"{TEXT} {TEXT} End.", ""]


def by_loops(blocks, paths):
    """The fused ratios, block by block and path by path."""

    def ratio(own, plain=False):
        if not own:
            return 0.0
        size = sum(len(t) - (min(n, len(t)) if plain else 0) for t, _, n in own) / len(own)
        return math.sqrt(size) * (1 + math.sqrt(sum(sum(c in ".,;:!?。，！？；、…" for c in t) for t, _, _ in own) / len(own)))

    def within(p, outer):
        while p and p != outer:
            p = paths[p][3]
        return p == outer

    def weight(p):
        if not p:
            return 1.0
        standing, box, _, around = paths[p]
        rest = weight(around)
        if box != p or standing == 1 and paths[around][0] == 1:
            return rest
        text = lambda q: sum(len(t) - min(n, len(t)) for t, b, n in blocks if within(b, q))
        beside = [q for q in range(1, len(paths)) if paths[q][1] == q and paths[paths[q][3]][1] == paths[around][1]]
        return rest * math.sqrt(text(p) / max(1, *map(text, beside)) if len(beside) > 1 else text(p) / max(1, text(p)))

    box_of = lambda b: paths[b[1]][1]
    row = [ratio([x for x in blocks if x[1] == b[1]]) for b in blocks]
    smooth = []
    for i, b in enumerate(blocks):
        before = row[i - 1] if i and box_of(blocks[i - 1]) == box_of(b) else row[i]
        after = row[i + 1] if i + 1 < len(blocks) and box_of(blocks[i + 1]) == box_of(b) else row[i]
        smooth.append(0.25 * before + 0.5 * row[i] + 0.25 * after)
    out = []
    for p, (standing, box, heading, _) in enumerate(paths):
        mine = [i for i, b in enumerate(blocks) if b[1] == p]
        if not mine:
            out.append(0.0)
            continue
        boxes = [q for q in range(len(paths)) if paths[q][1] == q and within(q, box)] if heading else [box]
        fused = 0.5 * sum(smooth[i] for i in mine) / len(mine) + 0.5 * max(ratio([b for b in blocks if box_of(b) == q], True) for q in boxes)
        linked = sum(min(blocks[i][2], len(blocks[i][0])) for i in mine) / sum(len(blocks[i][0]) for i in mine)
        out.append(fused * (1.0 if heading else max(1 - linked, 0.05)) * weight(p) * {1: 2**0.5, 0: 1.0, -1: 0.5**0.5}[standing])
    return out


def test_ratios_by_loops():
    for page, _ in PAGES.values():
        blocks, paths = tagpaths.blocks_of(page)
        assert tagpaths.ratios(blocks, paths) == pytest.approx(by_loops(blocks, paths))


def test_ratios_decide_and_names_do_not(monkeypatch):
    pages = [page for page, _ in PAGES.values()]
    found = [tagpaths.main_text(page) for page in pages]
    renamed = [re.sub(r"class=(\"[^\"]*\"|'[^']*'|[^\s>]+)", lambda m: f"class=z{hashlib.md5(m.group(1).encode()).hexdigest()[:6]}".translate(str.maketrans("0123456789", "ghijklmnop")), page) for page in pages]
    assert [tagpaths.main_text(page) for page in renamed] == found
    real = tagpaths.ratios
    monkeypatch.setattr(tagpaths, "ratios", lambda blocks, paths: (real(blocks, paths) > 0) * 1.0)
    blind = [tagpaths.main_text(page) for page in pages]
    assert sum(a != b for a, b in zip(blind, found)) >= 8
    monkeypatch.setattr(tagpaths, "ratios", lambda blocks, paths: np.roll(real(blocks, paths), 1))
    assert sum(tagpaths.main_text(page) != text for page, text in zip(pages, found)) >= 8


def test_pages_of_the_test_tables():
    """Text-blind, every page of the table is another; with any names, next to no word is."""
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    wrong = words = blind = 0
    pages = [page for page in pq.read_table(path, columns=["html"])["html"].to_pylist() if page]
    for page in pages:
        named = re.sub(r'class="ad"', 'class="qz"', page)
        # The table's pages hold their text in one article element.
        want = collections.Counter(tagpaths.main_text(re.search(r"<article>.*</article>", page, re.S).group()).split())
        got = collections.Counter(tagpaths.main_text(named).split())
        wrong, words = wrong + sum((want - got).values()) + sum((got - want).values()), words + sum(want.values())
        blind += tagpaths.main_text(named, 0.0) != tagpaths.main_text(named)
    assert wrong < 0.01 * words and blind > 0.9 * len(pages)


def test_hostile_pages():
    pages = ["<div>" * 50_000 + "text, here." + "</div>" * 50_000, "<ul><li>" * 20_000 + "text, here.", "<a>" * 50_000 + "text, here.", "<p" * 30_000 + ">", "<!--" * 30_000, "<script" * 30_000, "</x>" * 50_000]
    tracemalloc.start()
    found = [tagpaths.main_text(page) for page in pages]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[:2] == ["text, here."] * 2 and most < 200 << 20


def test_long_null_and_repeated_rows(spark):
    rows = [(1, "u", f"<article>{LONG * 20_000}</article>", 3), (2, None, None, 3), (2, None, "", 3), (None, "u", "<p>x</p>", 3), (None, "u", "<p>x</p>", 3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id or 0, r.url or "", r.n_chars, r.text[:4]) for r in tagpaths.extracted(table).collect())
    assert got == [(0, "u", 1, "x")] * 2 + [(1, "u", 20_000 * (len(TEXT) + 1) - 1, "A lo"), (2, "", 0, ""), (2, "", 0, "")]
    empty = tagpaths.extracted(table.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]
