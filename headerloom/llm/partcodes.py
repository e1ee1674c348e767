"""Vector code compression: product quantisation (Jegou, Douze and Schmid, 2011) in whole numbers, trained on every row.

Components become whole numbers and rows are packed, where they lie, into blocks of columns: one NumPy array a
dimension. A round of training is one treeAggregate over the RDD of blocks: a task adds up squared differences
dimension by dimension, takes the nearest entry of each part, and adds its rows to int64 tensors of sums and counts
with np.add.at; the tensors, of a fixed size, are merged through the reduction tree. All numbers are whole, so
neither the order of rows nor the shape of the tree changes a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.blocks import vectors_of
from headerloom.llm.hotkeys import with_facts
from headerloom.llm.shared import written

PARTS, WORDS, ROUNDS = 4, 256, 4
#: Rows of a block, and rows whose distances to all entries are held at once.
BLOCK, AT_ONCE = 4096, 512
_LONG = np.iinfo(np.int64)


def packed(table: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """dim, n_ids, ids (int64, those of null ids last), labels, width (bytes of a number), columns (dimension by dimension) of blocks of rows."""
    x = F.col(vector_col).cast("array<double>")
    sound = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("x")).where("x is not null").where(sound)
    whole = F.transform("x", lambda v: F.when(F.abs(v * float(scale)) < 2.0**63, F.floor(v * float(scale))).when(v < 0, _LONG.min).otherwise(_LONG.max).cast("long"))
    rows = rows.select("vec_id", "label", whole.alias("x"))
    kind = rows.schema["label"].dataType.simpleString()
    names = ["dim", "n_ids", "ids", "labels", "width", "columns"]

    def run(batches):
        for batch in batches:
            flat, size = vectors_of(batch.column("x"))
            begin, ids = np.cumsum(size) - size, batch.column("vec_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                of = np.flatnonzero(size == dim)
                for part in np.array_split(of, -(-len(of) // BLOCK)):
                    part = part[np.lexsort((number[part], ~known[part]))]
                    columns = np.zeros((-(-dim // PARTS) * PARTS, len(part)), np.int64)
                    columns[:dim] = flat[begin[part] + np.arange(dim)[:, None]]
                    most = max(-int(columns.min(initial=0)), int(columns.max(initial=0)))
                    width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1) or w == 8)
                    labels = batch.column("label").take(pa.array(part))
                    cells = [[int(dim)], [int(known[part].sum())], [number[part].tobytes()], pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), labels), [width], [columns.astype(f"i{width}").tobytes()]]
                    kinds = [pa.int32(), pa.int32(), pa.binary(), None, pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(cells, kinds)], names)

    return rows.mapInArrow(run, f"dim int, n_ids int, ids binary, labels array<{kind}>, width int, columns binary")


def columns_of(row, wide: bool) -> np.ndarray:
    """(dimensions, rows) of a block: doubles if all distances are whole numbers that doubles hold, else Python's integers."""
    dims = -(-row["dim"] // PARTS) * PARTS
    n = len(row["ids"]) // 8
    numbers = np.frombuffer(row["columns"], f"i{row['width']}").reshape(dims, n)
    return numbers.astype(object if wide else float)


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of the nearest entry of a (entries, dimensions) book for each column; ties to the lower place."""
    n = columns.shape[1]
    place, least = np.zeros(n, np.int64), np.zeros(n, columns.dtype)
    book = book.astype(columns.dtype)
    for begin in range(0, n, AT_ONCE):
        part = columns[:, begin : begin + AT_ONCE]
        far = np.zeros((part.shape[1], len(book)), columns.dtype)
        gap = np.empty_like(far)
        for j in range(len(part)):
            np.subtract(part[j][:, None], book[:, j], out=gap)
            np.multiply(gap, gap, out=gap)
            far += gap
        at = far.argmin(axis=1)
        place[begin : begin + AT_ONCE], least[begin : begin + AT_ONCE] = at, far[np.arange(len(at)), at]
    return place, least


def _smallest(state: dict, found: dict, words: int) -> dict:
    """The rows of the ``words`` smallest ids of each length, equal ids in order of their components."""
    for dim, (ids, rows) in found.items():
        if dim in state:
            ids, rows = np.concatenate([state[dim][0], ids]), np.concatenate([state[dim][1], rows])
        order = np.lexsort((*rows.T[::-1], ids))[:words]
        state[dim] = ids[order], rows[order]
    return state


def first_books(blocks: DataFrame, words: int = WORDS) -> dict[int, np.ndarray]:
    """Length of vectors to the (entries, dimensions) of its smallest ids, by a reduction tree that passes on ``words`` rows at most."""

    def seen(state, row):
        ids = np.frombuffer(row["ids"], np.int64)[: row["n_ids"]]
        # Ids are in order: those behind the last wanted one are tied with it or no use.
        some = int(np.searchsorted(ids, ids[words - 1], "right")) if len(ids) >= words else len(ids)
        rows = np.frombuffer(row["columns"], f"i{row['width']}").reshape(-1, len(row["ids"]) // 8)[:, :some].T.astype(np.int64)
        return _smallest(state, {row["dim"]: (ids[:some], rows)}, words) if some else state

    found = blocks.select("dim", "n_ids", "ids", "width", "columns").rdd.treeAggregate({}, seen, lambda a, b: _smallest(a, b, words))
    return {dim: rows for dim, (_, rows) in found.items()}


def _split(rows: np.ndarray) -> list[np.ndarray]:
    return np.split(rows, PARTS, axis=1)


def trained(blocks: DataFrame, words: int = WORDS, rounds: int = ROUNDS) -> tuple[dict[int, list[np.ndarray]], dict[int, bool]]:
    """(length of vectors to the books of its parts, length to whether its numbers need Python's integers)."""
    most = blocks.select("dim", "width", F.size("labels").alias("n"), "columns").rdd.treeAggregate({}, _seen_most, _merged_most)
    # Doubles hold a part's distance below 2**53; a tensor of int64 holds sums below 2**63.
    wide = {dim: 4 * top * top * max(dim, 1) >= 2**53 or top * n >= 2**62 for dim, (top, n) in most.items()}
    books = {dim: _split(rows.astype(object) if wide[dim] else rows) for dim, rows in first_books(blocks, words).items()}
    numbers = blocks.select("dim", "ids", "width", "columns").rdd
    for _ in range(rounds):
        held = blocks.sparkSession.sparkContext.broadcast(books)  # entries: a fixed number for each length

        def seen(state, row, held=held):
            dim = row["dim"]
            if dim not in held.value:
                return state
            columns = columns_of(row, wide[dim])
            if dim not in state:
                kind = object if wide[dim] else np.int64
                state[dim] = [(np.zeros(book.shape, kind), np.zeros(len(book), np.int64)) for book in held.value[dim]]
            for part, book, (sums, counts) in zip(np.split(columns, PARTS), held.value[dim], state[dim]):
                place, _ = nearest(part, book)
                np.add.at(sums, place, part.T if wide[dim] else part.T.astype(np.int64))
                np.add.at(counts, place, 1)
            return state

        found = numbers.treeAggregate({}, seen, _merged)
        for dim, tensors in found.items():
            for book, (sums, counts) in zip(books[dim], tensors):
                used = counts > 0
                book[used] = sums[used] // (counts[used].astype(object) if wide[dim] else counts[used])[:, None]
        held.unpersist()
    return books, wide


def _seen_most(state, row):
    numbers = np.frombuffer(row["columns"], f"i{row['width']}")
    most = max(-int(numbers.min(initial=0)), int(numbers.max(initial=0)))
    top, n = state.get(row["dim"], (0, 0))
    return state | {row["dim"]: (max(top, most), n + row["n"])}


def _merged_most(a, b):
    return a | {dim: (max(a[dim][0], top), a[dim][1] + n) if dim in a else (top, n) for dim, (top, n) in b.items()}


def _merged(a, b):
    for dim, tensors in b.items():
        if dim in a:
            for (sums, counts), (more, n) in zip(a[dim], tensors):
                sums += more
                counts += n
        else:
            a[dim] = tensors
    return a


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, decimal and joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def coded(blocks: DataFrame, books: dict[int, list[np.ndarray]], wide: dict[int, bool]) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every row of the blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((books, {dim: digest(book) for dim, book in books.items()}))
    kind = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches):
        books, digests = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in ("dim", "n_ids", "ids", "width", "columns")}
                ids, dim = np.frombuffer(row["ids"], np.int64), row["dim"]
                known = pa.array(ids, mask=np.arange(len(ids)) >= row["n_ids"])
                if dim in books:
                    found = [nearest(part, book) for part, book in zip(np.split(columns_of(row, wide[dim]), PARTS), books[dim])]
                    places = np.stack([place for place, _ in found], axis=1).astype(np.uint16 if any(len(b) > 256 for b in books[dim]) else np.uint8)
                    text = places.astype(places.dtype.newbyteorder(">")).tobytes().hex()
                    step = len(text) // len(ids)
                    code = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
                    error = pa.array([min(int(e), _LONG.max) for e in sum(least for _, least in found)], pa.int64())
                else:  # no row of this length has an id, so there is no entry
                    code, error = pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64())
                sha = pa.array([digests.get(dim)] * len(ids), pa.string())
                yield pa.RecordBatch.from_arrays([known, batch.column("labels")[r].values, code, error, sha], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return blocks.mapInArrow(run, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")


def compressed(table: DataFrame, scale: int = 1024, words: int = WORDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: every row's part codes and what they leave.

    Components are floor(scale * x), beyond a long's range its nearest end. Rows whose vector is null or holds null or
    non-finite components are left out; every other row counts in each round. A part's book begins with the ``words``
    smallest ids, of repeated ids in order of their components; a row without id is coded but begins no entry. Vectors of
    different lengths are trained apart, each length with its own books; a length that 4 does not divide is filled with
    zeros, an empty vector has empty parts; a length of which no row has an id has null codes. Fewer rows than ``words``
    give fewer entries. Errors and their sums beyond a long are its greatest; null labels are one label, however many
    rows a label has. Repeated rows count each; other columns are ignored; an empty table gives an empty one.
    The books (``words`` rows for each length) pass through the driver, rows never do.
    """
    blocks = written(packed(table, scale, id_col, vector_col, label_col))
    books, wide = trained(blocks, words, rounds)
    rows = written(coded(blocks, books, wide))
    least = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG.max).cast("decimal(38,0)")).cast("long")
    sums = written(rows.groupBy("label").agg(least.alias("label_error"), F.count("*").alias("__n")))
    return with_facts(rows, sums, "label", "__n", rows.count()).drop("__n")
