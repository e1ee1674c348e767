"""Quality by regularised quadratic discriminant analysis (Friedman, 1989).

Every whole text becomes a dozen statistics, transformed towards normal shape. Class means and
covariances come from sums over all labelled rows (each task adds up its own, then sums are added).
Each covariance is shrunk towards the pooled one and towards a multiple of the identity. A score is the
logistic of the difference of the classes' log densities with their priors; Mahalanobis distances use
the Cholesky factors, which are computed once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from headerloom.llm.shared import slice_hashes, steps, texts_of, words_of, written

#: Share of the pooled covariance in a class's, and of the mean variance's multiple of the identity.
POOLED, ROUND = 0.3, 0.02
NAMES = ("words", "bytes_a_word", "spread_of_lengths", "longest", "distinct", "upper", "digits", "marks", "odd_ends", "stops", "other_bytes", "lines", "repeated_lines", "words_a_stop")

_KIND = np.zeros(256, np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KIND[128:] = 5
_STOP = np.zeros(256, bool)
_STOP[list(b".?!:;,")] = True


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) finite statistics of the texts raw[at[i]:at[i + 1]]; a text without words has zeros."""
    n = len(at) - 1
    start, end, row = words_of(raw, at)
    words = np.bincount(row, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, n) / some
    deviation = np.sqrt(np.maximum(np.bincount(row, length**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)

    def distinct(start, end, row):
        if not len(row):
            return np.zeros(n)
        key = np.stack([row.astype(np.uint64), slice_hashes(raw, start, end)])
        key = key[:, np.lexsort(key)]
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        return np.bincount(key[0][new].astype(np.int64), minlength=n).astype(float)

    kind, count = _KIND[raw], np.zeros((6, n))
    full_ = np.flatnonzero(at[1:] > at[:-1])
    if len(full_):
        for k in range(1, 6):
            count[k, full_] = np.add.reduceat(kind == k, at[full_], dtype=np.int64)
    solid = np.maximum(count[1:].sum(axis=0), 1)
    last = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    stop = _STOP[last]
    odd = (_KIND[last] == 4) & ~stop | (last == ord("!"))
    full = np.isin(last, np.frombuffer(b".?", np.uint8))
    # Lines: slices between line feeds.
    mark = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, at]))
    first, after = mark[:-1], mark[1:]
    own = np.searchsorted(at, first, "right") - 1
    lines = np.bincount(own, minlength=n).astype(float)
    different = distinct(first, after, own)
    stops = np.bincount(row, full, n)
    share = lambda x, of: np.sqrt(np.clip(x / of, 0, 1))
    out = np.stack(
        [
            np.log1p(words), np.log1p(mean), np.log1p(deviation), np.log1p(longest),
            distinct(start, end, row) / some**0.8, share(count[2], solid), share(count[3], solid), share(count[4], solid),
            share(np.bincount(row, odd, n), some), share(np.bincount(row, stop, n), some), share(count[5], solid),
            np.log1p(lines / some * 10), share(np.maximum(lines - different, 0), np.maximum(lines, 1)), np.log(some / (stops + 1)),
        ],
        axis=1,
    )
    out[words == 0] = 0
    return out


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array<double>): the statistics of every row's whole text; null is as empty."""

    def run(batches):
        for part in steps(batches):
            x = statistics(*texts_of(part.column(1)))
            at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], ["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, x array<double>")


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Class to (rows, sum of x, sum of outer products) of ``rows`` (label, x); each task adds up before the shuffle."""
    d = len(NAMES)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in np.unique(label):
                own = np.concatenate([np.ones((int((label == c).sum()), 1)), x[label == c]], axis=1)
                total[int(c)] = total.get(int(c), 0) + own.T @ own
        for c, m in total.items():
            at = np.arange(m.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, c), pa.int32()), pa.array(at, pa.int32()), pa.array(m.reshape(-1))], ["label", "at", "value"])

    sums = rows.select("label", "x").mapInArrow(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for label, at, value in sums.collect():  # (1 + statistics) squared numbers a class
        found.setdefault(label, np.zeros((d + 1) ** 2))[at] = value
    return {c: (m[0], m[1 : d + 1], m.reshape(d + 1, d + 1)[1:, 1:]) for c, m in found.items()}


class Discriminant:
    """The two classes' log densities; a class without rows leaves the score at the share of the other."""

    def __init__(self, of: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, round_: float = ROUND):
        self.parts, self.only = [], None
        of = {c: of[c] for c in (0, 1) if c in of}
        if len(of) < 2:
            self.only = float(next(iter(of))) if of else 0.5
            return
        n = {c: m[0] for c, m in of.items()}
        mean = {c: m[1] / m[0] for c, m in of.items()}
        scatter = {c: m[2] - m[0] * np.outer(mean[c], mean[c]) for c, m in of.items()}
        whole = sum(scatter.values()) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(whole), 1e-6))
        unit = np.outer(self.scale, self.scale)
        for c in (0, 1):
            cov = ((1 - pooled) * scatter[c] + pooled * n[c] * whole) / n[c] / unit
            cov = (1 - round_) * cov + round_ * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((mean[c], np.linalg.inv(factor), np.log(n[c] / sum(n.values())) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if self.only is not None:
            return np.full(len(x), self.only)
        dense = []
        for mean, inverse, prior in self.parts:
            z = ((x - mean) / self.scale) @ inverse.T
            dense.append(prior - 0.5 * (z**2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(dense[0] - dense[1], -500, 500)))


def learned(rows: DataFrame, labelled: DataFrame) -> Discriminant:
    """The model of ``rows`` (doc_id, x) and their labels (doc_id, label)."""
    label = labelled.select(F.col("doc_id").alias("__of"), F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    return Discriminant(moments(rows.join(label, F.col("doc_id") == F.col("__of"))))


def kept(docs: DataFrame, labelled: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that scored() predicts 1 for. Statistics are made again here, so no text is shuffled."""
    model = learned(written(described(docs, id_col, text_col)), labelled)

    def run(batches):
        for part in steps(batches, text_col):
            yield part.filter(pa.array(model.score(statistics(*texts_of(part.column(text_col)))) >= threshold))

    return docs.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in docs.schema]))


def scored(docs: DataFrame, labelled: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold, else 0).

    labelled: doc_id, label (0 or 1; others are left out) of the rows to learn from; a document with
    several labels counts with each. Null and empty texts have all statistics zero, and a score as any
    other. Repeated rows are scored each; a null doc_id is scored and learns nothing. If a class has no
    labelled row the score is the other class's label, and 0.5 without any. Other columns are ignored.
    """
    rows = written(described(docs, id_col, text_col))
    model = learned(rows, labelled)
    d = len(NAMES)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
