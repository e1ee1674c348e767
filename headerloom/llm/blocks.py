"""Blocks of vectors, and a stated query set against all rows, block by block.

Vectors are packed into blocks of bounded size where they lie (no shuffle): queries with their vectors,
candidates with a short code only. Queries and candidates are dealt to a grid of groups, and each group of
queries meets each group of candidates under a key of both, so the work is split over many tasks and neither side is
ever whole in one place. A pilot scan of one row in PILOT gives each query a score below which no row is wanted, so
what the scan of all rows passes on does not grow with the number of groups. What it finds likely is
joined with the original vectors by id and scored again exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headerloom.llm.shared import written

#: Rows of a block of candidates and of a block of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Groups of candidates, or more if a group would be of more than GROUP bytes; one in PILOT candidates is scanned first.
ACROSS, GROUP, PILOT = 4, 1 << 28, 64
#: Multiplications that a cell of the grid is meant to hold, as far as there are no more cells than four times the shuffle's partitions.
WORK = 1 << 29
#: Found rows that a task holds before it passes them on.
HELD = 1 << 20


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (array<double>) of the rows whose vector is there, not empty, and holds finite numbers only; rows without id are left out."""
    x = F.col(vector_col).cast("array<double>")
    sound = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and size(x) > 0").where(sound)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, lengths) of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _of_one_length(batch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, ids, matrix) for each length of vectors in a batch of vec_id and x."""
    flat, size = vectors_of(batch.column("x"))
    ids, begin = batch.column("vec_id").to_numpy(zero_copy_only=False), np.cumsum(size) - size
    out = []
    for dim in np.unique(size):
        of = np.flatnonzero(size == dim)
        out.append((of, ids[of], flat[begin[of][:, None] + np.arange(dim)]))
    return out


def first_copies(vectors: DataFrame, k: int) -> DataFrame:
    """vectors without the rows that can be in no result of k rows: k rows of the same vector and id, or of k + 1 smaller ids, come before them.

    So a vector that a great share of all rows holds is a bounded number of candidates. Tasks thin their
    own rows out before the shuffle, which is by vector.
    """

    def thinned(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for of, ids, matrix in _of_one_length(batch):
                key = np.ascontiguousarray(np.column_stack([matrix, ids.view(np.float64)])).view(f"V{8 * (matrix.shape[1] + 1)}").ravel()
                order = np.argsort(key, kind="stable")
                new = np.append(True, key[order][1:] != key[order][:-1])
                nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                keep[of[order[nth < k]]] = True
            yield batch.filter(pa.array(keep))

    order = Window.partitionBy("x").orderBy("vec_id")
    few = vectors.select("vec_id", "x").mapInArrow(thinned, "vec_id long, x array<double>")
    few = few.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k + 1)
    return few.withColumn("nth", F.row_number().over(order) - F.rank().over(order)).where(F.col("nth") < k).select("vec_id", "x")


def piloted(vectors: DataFrame) -> DataFrame:
    """About one in PILOT of the vectors, by a hash."""
    return vectors.where(F.pmod(F.xxhash64("vec_id", "x"), F.lit(PILOT)) == 0)


def packed(vectors: DataFrame, encode, rows: int = BLOCK) -> DataFrame:
    """dim, n, ids and the fields of ``encode``: blocks of rows of one dimension, in order of vec_id within the block.

    encode(matrix) gives a dict of field name to bytes for a (n, dim) matrix of doubles; its key set is
    encode.fields. A column ``least`` (double) of vectors is a field more.
    """
    limits = "least" in vectors.columns
    fields = encode.fields + (("least",) if limits else ())
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())] + [(f, pa.binary()) for f in fields])

    def run(batches):
        for batch in batches:
            least = batch.column("least").to_numpy(zero_copy_only=False) if limits else None
            for of, ids, matrix in _of_one_length(batch):
                for part in np.array_split(np.arange(len(ids)), -(-len(ids) // rows)):
                    part = part[np.argsort(ids[part], kind="stable")]
                    data = {"dim": matrix.shape[1], "n": len(part), "ids": ids[part].astype(np.int64).tobytes()} | encode(matrix[part])
                    if limits:
                        data["least"] = least[of[part]].astype(float).tobytes()
                    yield pa.RecordBatch.from_pylist([data], schema)

    return vectors.mapInArrow(run, "dim int, n int, ids binary, " + ", ".join(f"{f} binary" for f in fields))


def _plain(matrix: np.ndarray) -> dict[str, bytes]:
    return {"rows": matrix.astype(float).tobytes()}


_plain.fields = ("rows",)


def query_blocks(asked: DataFrame) -> DataFrame:
    """Blocks of queries (vec_id, x, least) with their vectors and the score below which nothing is wanted."""
    return packed(asked.select("vec_id", "x", "least"), _plain, QUERY_BLOCK)


def scan_of(asked: DataFrame, candidates: DataFrame, encode, bytes_a_row: int, search, merge, kinds: str, pilot_column: str, pilot_place: int) -> DataFrame:
    """What ``search`` finds of all candidates for all queries asked, as of scanned().

    The pilot's row of place ``pilot_place`` in its order by ``pilot_column``, highest first, gives a query its least score; a query
    for which the pilot finds fewer has none.
    """
    first = written(query_blocks(asked.withColumn("least", F.lit(float("-inf")))))
    pilot = written(packed(piloted(candidates), encode))
    found = scanned(grid(first, pilot, shape_of(first, pilot, bytes_a_row, 1)), search, merge, kinds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(pilot_column)))
    least = found.withColumn("place", place).where(F.col("place") == pilot_place).select(F.col("query_id").alias("vec_id"), F.col(pilot_column).cast("double").alias("least"))
    asked = asked.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    queries, blocks = written(query_blocks(asked)), written(packed(candidates, encode))
    return scanned(grid(queries, blocks, shape_of(queries, blocks, bytes_a_row)), search, merge, kinds)


def shape_of(queries: DataFrame, candidates: DataFrame, bytes_a_row: int, groups: int | None = None) -> tuple[int, int]:
    """(groups of queries, groups of candidates) for blocks that are written: about WORK multiplications a cell."""
    asked = queries.agg(F.sum(F.col("n")), F.max("dim"), F.count("*")).first()
    held = candidates.agg(F.sum(F.col("n")), F.count("*")).first()
    if not asked[0] or not held[0]:
        return 1, 1
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = min(max(1, asked[0] * held[0] * asked[1] // WORK), 4 * partitions)
    across = groups or min(max(ACROSS, held[0] * bytes_a_row // GROUP), held[1])
    return min(-(-cells // across), asked[2]), across


def grid(queries: DataFrame, candidates: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Rows of (block of queries, block of candidates), each pair of one dimension once; the fields of queries are prefixed with q_."""
    down, across = shape
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], deal("ids", down).alias("down")).withColumn("across", every(across))
    right = candidates.withColumn("across_", deal("ids", across)).withColumn("down_", every(down))
    on = (F.col("down") == F.col("down_")) & (F.col("across") == F.col("across_")) & (F.col("q_dim") == F.col("dim"))
    return left.hint("merge").join(right, on).drop("down", "across", "down_", "across_", "q_dim")


def scanned(pairs: DataFrame, search, merge, kinds: str) -> DataFrame:
    """query_id, vec_id and more columns ``kinds`` of what the rows of grid() find.

    search(row) gives arrays (query ids, ids, ...) of one pair of blocks, and merge(arrays) drops of them what is
    no longer needed; a task merges what its pairs give before it passes rows on.
    """
    names = ["query_id", "vec_id", *[x.split()[0] for x in kinds.split(", ")]]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                held.append(search({name: batch.column(name)[r] for name in batch.schema.names}))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merge(*(np.concatenate(x) for x in zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merge(*(np.concatenate(x) for x in zip(*held)))], names)

    return pairs.mapInArrow(run, f"query_id long, vec_id long, {kinds}")


def rescored(likely: DataFrame, asked: DataFrame, vectors: DataFrame, score, kind: str) -> DataFrame:
    """query_id, vec_id, score of the pairs ``likely`` (query_id, vec_id), on the vectors that belong to them.

    score(a, b) gives a number for each row of two matrices. An id of several rows stands for each of them.
    """

    def run(batches):
        for batch in batches:
            flat, size = vectors_of(batch.column("q"))
            other, _ = vectors_of(batch.column("x"))
            begin, out = np.cumsum(size) - size, None
            for dim in np.unique(size):
                of = np.flatnonzero(size == dim)
                at = begin[of][:, None] + np.arange(dim)
                part = score(flat[at], other[at])
                out = np.empty(len(size), part.dtype) if out is None else out
                out[of] = part
            if out is not None:
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(out)], ["query_id", "vec_id", "score"])

    both = likely.select("query_id", "vec_id").join(vectors.select("vec_id", "x"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "query_id")
    both = both.where(F.size("q") == F.size("x")).select("query_id", "vec_id", "q", "x")
    return both.mapInArrow(run, f"query_id long, vec_id long, score {kind}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller vec_id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def leading(own: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (highest score, then smallest id) of each query ``own``."""
    order = np.lexsort((ids, -score, own))
    own, ids, score = own[order], ids[order], score[order]
    keep = nth_of(own) < k
    return own[keep], ids[keep], score[keep]


def nth_of(own: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal numbers."""
    first = np.append(True, own[1:] != own[:-1])[: len(own)]
    return np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))


def bytes_of(row: dict, name: str, kind) -> np.ndarray:
    return np.frombuffer(row[name].as_buffer(), kind)


def queries_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, matrix, least scores) of a row's block of queries."""
    ids = bytes_of(row, "q_ids", np.int64)
    return ids, bytes_of(row, "q_rows", float).reshape(len(ids), -1), bytes_of(row, "q_least", float)
