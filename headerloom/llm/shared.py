"""Helpers that several operators of this package use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text that one vectorised step holds at once; its arrays need about 60 times as much memory.
STEP_BYTES = 1 << 18
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_folder(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one of our own in local runs."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/headerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(): for small tables; Spark removes the files when nothing refers to them any more."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without making Python strings; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text and ``rows`` rows each at most, and one row at least. No row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            reach = (ends[begin - 1] if begin else 0) + most
            end = max(begin + 1, min(begin + rows, int(np.searchsorted(ends, reach, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes other than the six ASCII white-space characters."""
    solid = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for the positions of one step."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(STEP_BYTES + 1, np.uint64(base))
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def slice_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each slice, in order of their starts: equal bytes give equal hashes, wherever they stand.

    The hash is a polynomial of the bytes. It is worked out for slices within one step of bytes at a time, and for longer ones
    step by step, so memory does not grow with the text.
    """
    up, down = _power_tables()
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        begin = int(start[i])
        j = max(int(np.searchsorted(start, begin + STEP_BYTES, "left")), i + 1)
        if end[j - 1] > begin + STEP_BYTES:  # the last one reaches beyond
            j -= 1
        if j > i:
            part = raw[begin : int(end[i:j].max())]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            lo, hi = start[i:j] - begin, end[i:j] - begin
            out[i:j] = (sums[hi] - sums[lo]) * down[lo]
            i = j
        else:
            total, factor = 0, 1
            for at in range(begin, int(end[i]), STEP_BYTES):
                part = raw[at : min(at + STEP_BYTES, int(end[i]))]
                total += int(((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)]).sum(dtype=np.uint64)) * factor
                factor = factor * int(up[STEP_BYTES]) % 2**64
            out[i] = total % 2**64
            i += 1
    return mixed(out + (end - start).astype(np.uint64))


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run values[i:i+size]; as many as there are whole runs."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(_BASE) + values[j : j + n]
    return mixed(out)


def shingles_of(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words, in order. A row with fewer words has one: all its words; none if it has no word."""
    start, end, row = words_of(raw, at)
    word = slice_hashes(raw, start, end)
    first = np.searchsorted(row, np.arange(len(at)), "left")
    count = np.diff(first)
    runs = run_hashes(word, size)
    whole = row[: len(runs)] == row[size - 1 :][: len(runs)]
    hashes, owner = runs[whole], row[: len(runs)][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for n in range(1, size):
            of = count[short] == n
            value = np.full(int(of.sum()), np.uint64(n))
            for j in range(n):
                value = value * np.uint64(_BASE) + word[first[short[of]] + j]
            extra[of] = mixed(value)
        hashes, owner = np.concatenate([hashes, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows of df: those with the lowest hashes of ``key``.

    A share of all hashes that holds about twice as many rows is filtered first, so what the tasks
    send for the final choice does not grow with their number.
    """
    total = df.count()
    hashed = df.withColumn("__h", F.xxhash64(key))
    if total > 4 * n:
        hashed = hashed.where(F.col("__h") < int(-(2**63) + 2.0**64 * (2 * n + 64) / total))
    return hashed.orderBy("__h", key).limit(n).drop("__h")


def crc32_mod(column: str, n: int):
    """crc32 of the number as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
