"""Main text of HTML pages by tag-path ratios (Wu, Li, Hu and Wang, 2013).

A page is cut into blocks of text, each with its path from the root: block-level tags with their class
or id. For every path of a page, characters and punctuation marks a block are taken, and their
square roots multiplied. This ratio is smoothed over neighbouring blocks of one box (div, section, cell ...; in an
article or main element only div), and fused with the ratio of the whole box (a heading's with that of the best box in its own), with the path's share of link
text, and with the weight of the box: at each level the root of its share of the text of the largest box beside it.
Paths whose fused ratio is at least a share of the page's highest are content, whatever element they lie in. What HTML's own elements say
(article and main; footer, aside, and header outside of these) shifts a ratio by a factor of at most 2 between them: it settles near ties and nothing else.
Names of classes and ids tell paths apart and are never read. Only markup that holds no text of a page (head, scripts, navigation, controls of
forms, hidden elements) is no block.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.shared import steps

#: A path is content if its fused ratio is at least this share of the page's highest.
THRESHOLD = 0.45
#: Neighbours' weights in smoothing, and the share of the box's ratio in the fused one.
SMOOTH, BOX = (0.25, 0.5, 0.25), 0.5
#: What a ratio is multiplied by in an article or main element, elsewhere, and in a footer, aside or outer header: no more than 2 apart.
ARTICLE, OTHER = 2**0.5, 0.5**0.5
#: What is left of a ratio whose text is all links.
LINKED = 0.05

# Tags of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("head nav noscript template button select option object iframe svg canvas dialog menu audio video map".split())
_OTHER = frozenset(("footer", "aside"))
_BOXES = frozenset("html body div section article main aside footer td th figure details fieldset blockquote center".split())
_CONTENT = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(script|style|title|textarea|xmp|noembed)\b[^>]*>(?:.*?</\1\s*>|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[/!?][^>]*>|<[a-zA-Z][^>]*>?|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_MARK = re.compile(r"[.,;:!?。，！？；、…]")


def _attributes(text: str) -> tuple[str, bool]:
    """(class or id without digits, whether hidden)."""
    label = ""
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return label, True
        if name in ("class", "id"):
            label = label or re.sub(r"\d+", "", value)
    return label, False


def blocks_of(page: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, bool, int]]]:
    """(blocks, paths) of a page.

    A block is (text, path, characters of links). A path is (standing, path of its box, whether a heading, path around it): the
    standing is 1 in an article or main element, -1 in a footer, aside or outer header, else 0.
    """
    paths, number = [(0, 0, False, 0)], {}
    # Open elements: tag, path, never text, in a link.
    stack = [("", 0, False, False)]
    held = {}  # open elements by tag
    blocks, buffer, links = [], [], 0

    def flush():
        nonlocal buffer, links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                blocks.append((text, stack[-1][1], links))
            buffer, links = [], 0

    def pop_to(n):
        if stack[-1][1] != stack[n - 1][1] or any(x[0] not in _INLINE for x in stack[n:]):
            flush()
        for x in stack[n:]:
            held[x[0]] -= 1
        del stack[n:]

    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            if not stack[-1][2]:
                text = html.unescape(text)
                buffer.append(text)
                if stack[-1][3]:
                    links += len("".join(text.split()))
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if held.get(tag):
                n = len(stack) - 1
                while stack[n][0] != tag:
                    n -= 1
                pop_to(n)
            elif tag not in _INLINE:
                flush()
            continue
        if tag in _VOID:
            if tag == "br":
                buffer.append("\n")
            elif tag == "hr":
                flush()
            continue
        if tag not in _INLINE:
            flush()
        if tag in _CLOSES_P and held.get("p"):
            n = len(stack) - 1
            while stack[n][0] != "p":
                n -= 1
            pop_to(n)
        if tag in _CLOSED_BY_SAME and any(held.get(x) for x in _CLOSED_BY_SAME[tag]):
            n = len(stack) - 1
            while n and stack[n][0] not in _SCOPES[tag] and stack[n][0] not in _CLOSED_BY_SAME[tag]:
                n -= 1
            if n and stack[n][0] in _CLOSED_BY_SAME[tag]:
                pop_to(n)
        _, path, never, link = stack[-1]
        standing, box, _, _ = paths[path]
        label, hidden = _attributes(m.group(4)) if m.group(4) else ("", False)
        never = never or tag in _NEVER or hidden and tag not in ("html", "body")
        if tag not in _INLINE:
            key = (path, tag, label)
            if key not in number:
                number[key] = len(paths)
                if tag in _OTHER or tag == "header" and standing < 1:
                    standing = -1
                elif tag in _CONTENT and standing == 0:
                    standing = 1
                paths.append((standing, len(paths) if tag in _BOXES and (tag == "div" or paths[path][0] < 1) else box, tag in _HEADINGS, path))
            path = number[key]
        stack.append((tag, path, never, link or tag == "a"))
        held[tag] = held.get(tag, 0) + 1
    flush()
    return blocks, paths


def ratios(blocks, paths) -> np.ndarray:
    """The fused ratio of each path; 0 for a path without a block of its own."""
    k = len(paths)
    path = np.array([b[1] for b in blocks], np.int64)
    size = np.array([len(b[0]) for b in blocks], float)
    marks = np.array([len(_MARK.findall(b[0])) for b in blocks], float)
    link = np.minimum(np.array([b[2] for b in blocks], float), size)
    standing = np.array([x[0] for x in paths])
    box = np.array([x[1] for x in paths])
    heading = np.array([x[2] for x in paths])

    def ratio(of, n, size=size):
        """The ratio of the blocks' groups ``of``: roots of characters and of marks a block."""
        count = np.maximum(np.bincount(of, minlength=n), 1)
        return np.sqrt(np.bincount(of, size, n) / count) * (1 + np.sqrt(np.bincount(of, marks, n) / count))

    own, whole = ratio(path, k), ratio(box[path], k, size - link)
    under = whole.copy()  # a heading goes with the best box that its own box holds
    for p in range(k - 1, 0, -1):
        if box[p] == p:
            around = box[paths[p][3]]
            under[around] = max(under[around], under[p])
    whole = np.where(heading, under[box], whole[box])
    linked = np.bincount(path, link, k) / np.maximum(np.bincount(path, size, k), 1)
    plain = np.where(heading, 1.0, np.maximum(1 - linked, LINKED))  # a heading may well be a link
    # Smoothing over neighbours in page order, as far as they lie in the same box; at its ends a block stands for the missing one.
    row, lies = own[path], box[path]
    same = lies[1:] == lies[:-1]
    before, after = row.copy(), row.copy()
    before[1:][same], after[:-1][same] = row[:-1][same], row[1:][same]
    smooth = SMOOTH[0] * before + SMOOTH[1] * row + SMOOTH[2] * after
    n = np.bincount(path, minlength=k)
    fused = (1 - BOX) * np.bincount(path, smooth, k) / np.maximum(n, 1) + BOX * whole
    return fused * plain * weights(paths, np.bincount(path, size - link, k)) * np.array([1.0, ARTICLE, OTHER])[standing] * (n > 0)


def weights(paths, size: np.ndarray) -> np.ndarray:
    """The weight of each path's box by the text in it: the product of the roots of its share at each level; boxes within an article or main element have that one's."""
    total = size.astype(float)
    for p in range(len(paths) - 1, 0, -1):  # a path comes after the one around it
        total[paths[p][3]] += total[p]
    most = {}
    for p, (_, box, _, around) in enumerate(paths):
        if p and box == p:
            beside = paths[around][1]
            most[beside] = max(most.get(beside, 0.0), total[p])
    out = np.ones(len(paths))
    for p, (standing, box, _, around) in enumerate(paths):
        if p:
            out[p] = out[around]
            if box == p and not (standing == 1 and paths[around][0] == 1):
                out[p] *= (total[p] / max(most[paths[around][1]], 1.0)) ** 0.5
    return out


def chosen(blocks, paths, threshold: float = THRESHOLD) -> list[str]:
    """The texts of the blocks whose paths are content, in page order."""
    if not blocks:
        return []
    fused = ratios(blocks, paths)
    return [b[0] for b in blocks if fused[b[1]] >= threshold * fused.max()]


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """The page's main text: blocks with single spaces inside, joined by a space; empty if there is none."""
    return " ".join(chosen(*blocks_of(page), threshold))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    ``threshold`` is the share of the page's highest fused ratio that makes a path content; 0 takes all blocks.

    The whole html is read, whatever its length; null and empty pages have an empty text, and so have
    pages without content; text without any tag is content. Rows that repeat are read each; an empty
    table gives an empty one; other columns are ignored. No shuffle.
    """

    def run(batches):
        for part in steps(batches, "html"):
            text = [main_text(page, threshold) if page else "" for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(run, f"page_id {dict(plain.dtypes)['page_id']}, url string, text string, n_chars long")
