"""Language identification with hyperdimensional profiles (Joshi, Halseth and Kanerva, 2016).

Every letter owns a random vector of +1 and -1, made from a hash of the letter. An n-gram is the product
of its letters' vectors, each rotated by its place; a text is the sum of its n-grams' vectors. Texts of
one language, brought to length one and added up, are its prototype, and a text gets the language whose
prototype has the highest cosine with it. Letters are lower-cased; everything else is one space, which also
stands at both ends.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.shared import mixed, steps, texts_of

WIDTH, GRAM = 512, 3
SPACE = 32
#: N-grams whose vectors a worker keeps, and those that one product of matrices takes at once.
CACHE, AT_ONCE = 1 << 16, 4096
TEXTS_AT_ONCE = 256
#: Bytes of a long text that are read at once.
LONG = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point that is a letter; SPACE for all others."""
    out = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _vectors(code: np.ndarray, width: int) -> np.ndarray:
    """(codes, width) random signs, the same for the same code everywhere."""
    seed = mixed(code.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(width // 64, dtype=np.uint64) + np.uint64(1))
    bits = np.unpackbits(seed.view(np.uint8), axis=1)
    return (1 - 2 * bits.astype(np.int8)).reshape(len(code), width)


def bound(grams: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(grams, width) products of the rotated letter vectors of (grams, n) code points."""
    letters, which = np.unique(grams, return_inverse=True)
    base, which = _vectors(letters, width), which.reshape(grams.shape)
    out = np.ones((len(grams), width), np.int8)
    for j in range(grams.shape[1]):
        out *= np.roll(base, grams.shape[1] - 1 - j, axis=1)[which[:, j]]
    return out


def grams_of(raw: np.ndarray, at: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count): how often each gram, n code points of 21 bits in one number, stands in each row with a letter."""
    code = _letters()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    begin = np.searchsorted(lead, at[:-1])
    row = np.searchsorted(at, lead, "right") - 1
    # Runs of spaces become one; texts are kept apart by a space at each end.
    edge = np.zeros(len(code), bool)
    edge[begin[begin < len(code)]] = True
    solid = code != SPACE
    keep = solid | (np.append(False, solid[:-1]) & ~edge)
    code, row = code[keep], row[keep]
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    some = np.searchsorted(heads, np.arange(len(code)), "right")
    full = np.full(len(code) + 2 * len(heads), SPACE, np.uint64)
    owner = np.empty(len(full), np.int64)
    place = np.arange(len(code)) + 2 * some - 1
    full[place] = code
    owner[place] = row
    owner[place[heads] - 1] = row[heads]
    tails = np.append(heads[1:], len(code)) - 1
    owner[place[tails] + 1] = row[tails]
    if len(full) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(full) - n + 1
    gram = np.zeros(size, np.uint64)
    for j in range(n):
        gram = gram << np.uint64(21) | full[j : j + size]
    inside = owner[:size] == owner[n - 1 :]
    blank = np.uint64((SPACE << 21) | SPACE)  # a text's last space and the space at its end
    inside &= (gram & np.uint64((1 << 42) - 1)) != blank
    gram, owner = gram[inside], owner[:size][inside]
    if n == 3 and len(at) <= 1 << 16 and (not len(code) or int(code.max()) < 1 << 16):
        low = np.uint64((1 << 16) - 1)  # row and three letters of 16 bits each make one number
        key = owner.astype(np.uint64) << np.uint64(48) | gram >> np.uint64(42) << np.uint64(32) | (gram >> np.uint64(21) & low) << np.uint64(16) | gram & low
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        one = key[new]
        gram = (one >> np.uint64(32) & low) << np.uint64(42) | (one >> np.uint64(16) & low) << np.uint64(21) | one & low
        return (one >> np.uint64(48)).astype(np.int64), gram, np.diff(np.append(new, len(key)))
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))) if len(gram) else np.zeros(0, np.int64)
    return owner[new], gram[new], np.diff(np.append(new, len(gram)))


def long_grams(raw: np.ndarray, n: int = GRAM, at_once: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(gram, count) of one text, read piece by piece; the last letters of a piece go before the next one."""
    grams, counts, rest, begin = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.full(1, SPACE, np.uint32), 0
    while begin < len(raw):
        end = min(begin + at_once, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        code = np.concatenate([rest, _letters()[np.frombuffer(raw[begin:end].tobytes().decode().encode("utf-32-le"), "<u4")]])
        if end == len(raw):
            code = np.append(code, np.uint32(SPACE))
        code = code[np.append(True, (code[1:] != SPACE) | (code[:-1] != SPACE))]
        size = max(len(code) - n + 1, 0)
        gram = np.zeros(size, np.uint64)
        for j in range(n):
            gram = gram << np.uint64(21) | code[j : j + size].astype(np.uint64)
        both, of = np.concatenate([grams, gram]), np.concatenate([counts, np.ones(size, np.int64)])
        grams, which = np.unique(both, return_inverse=True)
        counts = np.bincount(which, of, len(grams)).astype(np.int64)
        rest, begin = code[max(len(code) - n + 1, 0) :], end
    return grams, counts


class Bundler:
    """Sums of n-gram vectors, with a cache of the vectors."""

    def __init__(self, width: int = WIDTH, n: int = GRAM):
        self.width, self.n = width, n
        self.known, self.vectors = np.zeros(0, np.uint64), np.zeros((0, width), np.float32)

    def _of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct grams."""
        new = np.setdiff1d(grams, self.known, assume_unique=True)
        if len(new):
            if len(self.known) + len(new) > CACHE:
                self.known, self.vectors = np.zeros(0, np.uint64), np.zeros((0, self.width), np.float32)
                new = grams
            parts = np.stack([(new >> np.uint64(21 * (self.n - 1 - j))) & np.uint64((1 << 21) - 1) for j in range(self.n)], axis=1)
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.vectors = known[order], np.concatenate([self.vectors, bound(parts, self.width).astype(np.float32)])[order]
        return self.vectors[np.searchsorted(self.known, grams)]

    def bundles(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(rows, width) sums of the vectors of each row's grams; zeros for a row without a letter."""
        rows = len(at) - 1
        out = np.zeros((rows, self.width), np.float32)
        for lo in range(0, rows, TEXTS_AT_ONCE):
            hi = min(rows, lo + TEXTS_AT_ONCE)
            if at[hi] - at[lo] > 4 * LONG and hi == lo + 1:
                gram, count = long_grams(raw[at[lo] : at[hi]], self.n)
                row = np.zeros(len(gram), np.int64)
            else:
                row, gram, count = grams_of(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], self.n)
            distinct, which = np.unique(gram, return_inverse=True)
            for i in range(0, len(distinct), AT_ONCE):
                part = (which >= i) & (which < i + AT_ONCE)
                own = distinct[i : i + AT_ONCE]
                table = np.zeros((hi - lo, len(own)), np.float32)
                table[row[part], which[part] - i] = count[part]
                out[lo:hi] += table @ self._of(own)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def _batches(batches, column: str):
    for part in steps(batches, column, 1 << 20):
        yield part, *texts_of(part.column(column))


def prototypes(labelled: DataFrame, width: int = WIDTH, n: int = GRAM) -> dict[str, np.ndarray]:
    """Language to the sum of its texts' bundles, each of length one. labelled: lang, text; each task adds up its own first."""

    def run(batches):
        bundler, total = Bundler(width, n), {}
        for part, raw, at in _batches(batches, "text"):
            unit = _unit(bundler.bundles(raw, at).astype(float))
            lang = np.array(part.column("lang").to_pylist(), object)
            for one in set(lang):
                total[one] = total.get(one, 0) + unit[lang == one].sum(axis=0)
        for one, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * width), pa.array(np.arange(width), pa.int32()), pa.array(x)], ["lang", "at", "value"])

    plain = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    sums = plain.mapInArrow(run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for lang, at, value in sums.collect():  # width numbers a language
        found.setdefault(lang, np.zeros(width))[at] = value
    return {x: found[x] for x in sorted(found) if found[x].any()}


def identified(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, n: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1: half of the cosine and one).

    Every whole text counts. A text that is null or has no letter gets ``und`` and score 0, and so does
    any if no language is learned; equal cosines go to the language that comes first. Repeated rows are
    predicted each; an empty table gives an empty one; other columns are not looked at.
    """
    names = list(learned)
    profile = _unit(np.array([learned[x] for x in names])) if names else np.zeros((0, width))

    def run(batches):
        bundler = Bundler(width, n)
        for part, raw, at in _batches(batches, "text"):
            bundle = bundler.bundles(raw, at)
            some = (bundle != 0).any(axis=1) & bool(names)
            lang, score = np.full(len(bundle), "und", object), np.zeros(len(bundle))
            if some.any():
                cosine = _unit(bundle[some].astype(float)) @ profile.T
                best = cosine.argmax(axis=1)
                lang[some] = np.array(names, object)[best]
                score[some] = np.clip((cosine[np.arange(len(best)), best] + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
