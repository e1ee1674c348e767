"""Substring dedup by sliding spans of sentences.

A text is cut into sentences: after . ? ! (and their full-width forms) before white space, and at line
feeds. A run is ``sentences`` or more sentences in a row that hold at least ``words`` words, or a single
sentence of ``alone`` words. Of all runs the shortest that begins and the shortest that ends at each sentence
are its spans, or a sentence of ``alone`` words by itself: together they cover each sentence of any run and lie
within it, so what all runs would find repeated these find too. Spans are hashed to 128 bits
over their words and grouped over all documents; the first place of each, by doc_id and position, is
kept, and every sentence that any later place covers is removed. Places of one span that a task holds
together are compared there; only the earliest of them goes on to the global grouping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from headerloom.llm.shared import mixed, slice_hashes, steps, texts_of, words_of, written

SENTENCES, WORDS, ALONE = 2, 25, 40
#: Words of a run in the query and the pipeline. A passage of over 50 words that stands amid other sentences shares neither its
#: first nor its last sentence with its copies: on sf0.1 runs of 20 words find 0.984 of those documents and leave 0.984 of clean ones
#: alone, runs of 25 words 0.962 and 0.990. Single sentences of ALONE words find one document more and touch no clean one.
SHORT = 20
#: Spans that a task compares with each other before they are shuffled.
TOGETHER = 1 << 19
_STOP = np.zeros(256, bool)
_STOP[list(b".?!")] = True
#: Full-width full stop, exclamation and question mark, and the ideographic full stop, in UTF-8.
_WIDE = [b"\xef\xbc\x8e", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xe3\x80\x82"]


def sentences_of(raw: np.ndarray, at: np.ndarray):
    """Words (start, end, row) and, for each word, the number of its sentence, counted over all rows together."""
    start, end, row = words_of(raw, at)
    if not len(start):
        return start, end, row, np.zeros(0, np.int64)
    last = raw[end - 1]
    final = _STOP[last]
    for mark in _WIDE:
        long = (end - start >= 3) & (last == mark[2])
        long[long] = (raw[end[long] - 3] == mark[0]) & (raw[end[long] - 2] == mark[1])
        final |= long
    feeds = np.flatnonzero(raw == 10)
    broken = np.searchsorted(feeds, start[1:]) > np.searchsorted(feeds, end[:-1])  # a line feed between the words
    new = np.append(True, final[:-1] | broken | (row[1:] != row[:-1]))
    return start, end, row, np.cumsum(new) - 1


def spans_of(raw: np.ndarray, at: np.ndarray, sentences: int = SENTENCES, words: int = WORDS, alone: int = ALONE):
    """(row, position, length, hash, second hash) of the spans that begin or end at each sentence, where one fits; none twice."""
    start, end, row, of = sentences_of(raw, at)
    if not len(of):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n = int(of[-1]) + 1
    first = np.searchsorted(of, np.arange(n + 1))  # words before each sentence
    owner = row[first[:-1]]
    begin = np.searchsorted(owner, owner)  # the first sentence of each sentence's text
    stop = np.searchsorted(owner, owner, "right")
    reach = np.searchsorted(first, first[:-1] + words)  # sentences up to here hold enough words
    reach = np.maximum(reach, np.arange(n) + sentences)
    single = np.diff(first) >= alone
    reach[single] = np.arange(n)[single] + 1
    fits = reach <= stop
    back = np.searchsorted(first, first[1:] - words, "right") - 1  # sentences from here hold enough words
    back = np.minimum(back, np.arange(n) + 1 - sentences)
    ends = back >= begin
    if sentences <= 2 and words <= alone:
        ends &= ~single  # the other sentences of a run that ends in a single one begin spans within it
    ends[ends] = reach[back[ends]] != np.arange(n)[ends] + 1
    one, reach = np.append(np.arange(n)[fits], back[ends]), np.append(reach[fits], np.arange(n)[ends] + 1)
    word = slice_hashes(raw, start, end)
    keys = []
    # The hash of words i..j as a polynomial of their hashes, from prefix sums.
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        powers = np.full(len(word) + 1, np.uint64(base))
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(len(word) + 1, np.uint64(pow(base, -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(mixed(word + np.uint64(base)) * powers[:-1]))
        size = (first[reach] - first[one]).astype(np.uint64)
        keys.append(mixed((sums[first[reach]] - sums[first[one]]) * inverse[first[one]] + size))
    return owner[one], one - begin[one], reach - one, keys[0], keys[1]


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text")).where("text is not null")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS, alone: int = ALONE) -> DataFrame:
    """d (doc_id), t (hash of the text), at (first sentence, from 0), n (sentences), the hashes h, g of every span, and
    ``later``: whether the task holds an earlier place of the span, so that this one is known not to be the first."""

    def out(held):
        none, d, t, at, n, h, g = (np.concatenate(x) for x in zip(*held))
        later = _later(none, d, t, at, h, g)
        kinds = [pa.array(d, mask=none), pa.array(t), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(later)]
        return pa.RecordBatch.from_arrays(kinds, ["d", "t", "at", "n", "h", "g", "later"])

    def run(batches):
        held, size = [], 0
        for part in steps(batches):
            row, at, n, h, g = spans_of(*texts_of(part.column("text")), sentences, words, alone)
            d = part.column("d")
            none = d.is_null().to_numpy(zero_copy_only=False)
            d, t = pc.fill_null(d, 0).to_numpy(zero_copy_only=False), part.column("t").to_numpy(zero_copy_only=False)
            held.append((none[row], d[row], t[row], at, n, h, g))
            size += len(row)
            if size >= TOGETHER:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return _plain(docs, id_col, text_col).mapInArrow(run, "d long, t long, at int, n int, h long, g long, later boolean")


def _later(none, d, t, at, h, g) -> np.ndarray:
    """Whether each span has an equal one (h, g) with an earlier place (null doc_id last, doc_id, t, at) among these.

    Rows equal in doc_id and text have the same places: a place is later only where it differs from the first of its span.
    """
    later = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    among = order[np.append(same, False) | np.append(False, same)] if len(h) else order
    among = among[np.lexsort((at[among], t[among], d[among], none[among], g[among], h[among]))]
    new = np.append(True, (h[among][1:] != h[among][:-1]) | (g[among][1:] != g[among][:-1]))[: len(among)]
    first = among[np.maximum.accumulate(np.where(new, np.arange(len(among)), 0))]
    later[among] = np.any([x[among] != x[first] for x in (none, d, t, at)], axis=0)
    return later


def repeated(found: DataFrame) -> DataFrame:
    """d, t, at, n of the spans (as of spans()) that are not the first of their hash, by doc_id (null last), text hash and position.

    The first places are found by an aggregate that combines in each task before it shuffles. They are
    written, so that the join back shuffles both sides and adaptive execution can split a span that a
    great share of all documents holds.
    """
    order = F.struct(F.col("d").isNull().alias("none"), "d", "t", "at")
    known, found = found.where("later"), found.where("not later")
    first = found.groupBy("h", "g").agg(F.count("*").alias("many"), F.min(order).alias("first")).where("many > 1").select(F.col("h").alias("h1"), F.col("g").alias("g1"), "first")
    first = written(first)
    both = found.join(first, (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")))
    return both.where(order != F.col("first")).select("d", "t", "at", "n").unionByName(known.select("d", "t", "at", "n"))


def _without(raw: np.ndarray, at: np.ndarray, gone: list[set[int]]) -> list[str | None]:
    """The texts without the sentences ``gone`` names for each row; a row with none named is None."""
    start, end, row, of = sentences_of(raw, at)
    body = raw.tobytes()
    begin = np.searchsorted(row, np.arange(len(at)))
    out = []
    for i, numbers in enumerate(gone):
        if not numbers:
            out.append(None)
            continue
        lo, hi = begin[i], begin[i + 1]
        own = of[lo:hi] - of[lo]
        sentence = np.unique(own)
        kept = sentence[~np.isin(sentence, list(numbers))]
        first = np.searchsorted(own, np.append(sentence, len(sentence)))
        # A kept sentence takes the white space after it along; what stands before the first word stays.
        edge = np.append(start[lo + first[:-1]], at[i + 1])
        text = b"".join(body[edge[k] : edge[k + 1]] for k in kept)
        if len(kept) and kept[-1] != sentence[-1]:
            text = text.rstrip(b" \t\n\x0b\x0c\r")
        out.append((body[at[i] : edge[0]] + text if len(kept) else b"").decode())
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = SENTENCES, words: int = WORDS, alone: int = ALONE, count_col: str | None = None) -> DataFrame:
    """docs with each text free of the sentences that a span with an earlier place covers; other columns as they are.

    The earlier place is that of the smaller doc_id (null last), then text hash, then position. A text
    left without a sentence is empty; texts without removed sentences, null and empty ones stay as they
    are. Rows equal in doc_id and text are one document, and each keeps what the document keeps.
    ``count_col`` adds a column with the number of removed sentences. An empty table gives an empty one.
    """
    later = repeated(written(spans(docs, id_col, text_col, sentences, words, alone)))
    gone = later.groupBy("d", "t").agg(F.collect_set(F.struct("at", "n")).alias("gone"))
    fields = [f"c{i}" for i in range(len(docs.columns))]  # names of their own, so that no column of docs clashes
    id_, place = fields[docs.columns.index(id_col)], docs.columns.index(text_col)
    own = docs.toDF(*fields).withColumn("key", F.xxhash64(F.col(fields[place]).cast("string")))
    rows = own.join(gone, F.col(id_).cast("long").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")), "left").select(*fields, "gone")
    names = fields + (["count"] if count_col else [])

    def run(batches):
        for part in steps(batches, fields[place]):
            gone = [{s for x in those or () for s in range(x["at"], x["at"] + x["n"])} for those in part.column("gone").to_pylist()]
            columns = [part.column(c) for c in fields]
            if any(gone):
                old = columns[place]
                new = _without(*texts_of(old), gone)
                hit = pa.array([x is not None for x in new])
                columns[place] = pc.if_else(hit, pa.array(new, old.type), old)
            more = [pa.array([len(x) for x in gone], pa.int32())] if count_col else []
            yield pa.RecordBatch.from_arrays(columns + more, names)

    kinds = [StructField(c, f.dataType) for c, f in zip(fields, docs.schema)] + ([StructField("count", IntegerType())] if count_col else [])
    return rows.mapInArrow(run, StructType(kinds)).toDF(*docs.columns, *([count_col] if count_col else []))
