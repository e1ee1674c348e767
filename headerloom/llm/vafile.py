"""Exact top-k search with vector-approximation files (Weber, Schek and Blott, 1998).

The file holds one byte a dimension: the number of the cell, between the block's least and greatest
value in that dimension, that the component lies in. For a query the cells give a lower and an upper
bound of every inner product; cells of a dimension are of one width, so both come from one product of
matrices. A first pass scans the cells and keeps what can still be among the k best by the k-th best
lower bound, of a pilot share of the rows and of the rows at hand. A second reads exact vectors in the order of the upper bound: a few of each query first, then those that
can still reach the k-th best result of these, ties included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headerloom.llm.blocks import bytes_of, first_copies, nth_of, queries_of, ranked, rescored, scan_of, usable
from headerloom.llm.shared import written

CELLS = 256
#: What bounds are widened by, as a share of the greatest product: rounding of doubles stays far below it.
SLACK = 1e-9
#: Queries whose bounds are worked out at once.
AT_ONCE = 128


def encode(matrix: np.ndarray) -> dict[str, bytes]:
    """The least value and the width of the cells of each dimension, and the rows' cell numbers. The x of cell c lie in low + c * width + [0, width - 1]."""
    low, high = matrix.min(axis=0), matrix.max(axis=0)
    width = np.floor((high - low) / CELLS) + 1
    cell = np.clip(np.floor((matrix - low) / width), 0, CELLS - 1).astype(np.uint8)
    return {"low": low.tobytes(), "width": width.tobytes(), "cells": cell.tobytes()}


encode.fields = ("low", "width", "cells")


def bounds(query: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper bounds of the inner products of each query and row, how far the lower ones are below them for each query)."""
    slack = np.where(query.any(axis=1), SLACK * (np.abs(query) @ np.maximum(np.abs(low), np.abs(low + width * CELLS))) + 1e-6, 0)
    upper = (query * width) @ cells.T.astype(float)
    upper += (query @ low + np.maximum(query, 0) @ (width - 1) + slack)[:, None]
    return upper, np.abs(query) @ (width - 1) + 2 * slack


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact; what a long cannot hold is its nearest end."""
    most = np.abs(a).max(axis=1) * np.abs(b).max(axis=1) * a.shape[1]
    if (most < 2.0**53).all():
        return (a * b).sum(axis=1).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q)), ends.min), ends.max) for p, q in zip(a, b)], np.int64)


def _merge(k: int):
    def merge(own, ids, upper, lower):
        """Without the rows whose upper bound is below the k-th best lower bound of their query, and of those with an exact score those behind the k best."""
        order = np.lexsort((-lower, own))
        own, ids, upper, lower = own[order], ids[order], upper[order], lower[order]
        nth = nth_of(own)
        at = np.arange(len(own)) - nth + k - 1
        some = at < len(own)
        some[some] = own[at[some]] == own[some]
        least = np.where(some, lower[np.where(some, at, 0)] if len(lower) else lower, -np.inf)
        keep = upper >= least
        exact = np.flatnonzero(keep & (upper == lower))
        exact = exact[np.lexsort((ids[exact], -upper[exact], own[exact]))]
        keep[exact[nth_of(own[exact]) >= k]] = False
        return own[keep], ids[keep], upper[keep], lower[keep]

    return merge


def top_k(table: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest integer inner product with each query, ties to the smaller vec_id.

    Components are floor(scale * x). ``is_query`` is a condition on vec_id; a query is compared with
    all rows but those of its own id. Rows whose vector is null, empty or holds null or non-finite
    components take no part; vectors of different lengths are not compared; rows that repeat an id
    count each; fewer than k candidates give fewer rows. Components and scores beyond the range of a long count as its
    nearest end.
    """
    vectors = usable(table, id_col, vector_col).select("vec_id", F.transform("x", lambda v: F.floor(v * float(scale)).cast("double")).alias("x"))
    held = written(first_copies(vectors, k))
    asked = written(vectors.where(is_query))
    merge = _merge(k)

    def search(row):
        own, query, limit = queries_of(row)
        ids = bytes_of(row, "ids", np.int64)
        cells = bytes_of(row, "cells", np.uint8).reshape(len(ids), -1)
        low, width = bytes_of(row, "low", float), bytes_of(row, "width", float)
        found = []
        for begin in range(0, len(own), AT_ONCE):
            o = own[begin : begin + AT_ONCE]
            upper, gap = bounds(query[begin : begin + AT_ONCE], low, width, cells)
            mine = o[:, None] == ids
            upper[mine] = -np.inf
            least = limit[begin : begin + AT_ONCE]
            if len(ids) > k:
                least = np.maximum(least, np.partition(upper, len(ids) - k, axis=1)[:, len(ids) - k] - gap)
            q, at = np.nonzero((upper >= least[:, None]) & ~mine)
            found.append((o[q], ids[at], upper[q, at], upper[q, at] - gap[q]))
        return merge(*(np.concatenate(x) for x in zip(*found)))

    found = scan_of(asked, held, encode, 64, search, merge, "upper double, lower double", "lower", k)
    order = Window.partitionBy("query_id")
    every = order.orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumn("least", F.nth_value("lower", k).over(every)).where("least is null or upper >= least")
    found = found.groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper"))
    found = written(found.withColumn("turn", F.row_number().over(order.orderBy(F.desc("upper"), "vec_id"))))
    first = written(rescored(found.where(F.col("turn") <= 2 * k), asked, held, scores, "long"))
    sure = ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = found.where(F.col("turn") > 2 * k).join(sure, "query_id", "left").where("kth is null or upper >= kth")
    return ranked(first.unionByName(rescored(rest, asked, held, scores, "long")), k)
