"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.session import checkpoint_dir

#: Stands for a null doc_id wherever ids are compared: after every real id.
NULL_ID = np.iinfo(np.int64).max


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table that one task reads.
TASK_ROWS = 50_000


def materialized(df: DataFrame, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut.

    A ``narrow`` table (a few numbers a row) is read by a task for every
    TASK_ROWS of its rows, not by one for each partition that made it.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    return out.coalesce(out.count() // TASK_ROWS + 1) if narrow else out


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes blocks and shards, and nothing else."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def sha256_hex(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def arrow_binary(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values in a row as uint8, offsets int64); nulls are empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int, rows: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows at most and of about ``most`` bytes of a text column, so that long texts do not add up."""
    ends = arrow_binary(batch.column(column))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + rows, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1, batch.num_rows)
        hi = max(hi, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """doc_id as int64, null as NULL_ID."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy().astype(np.int64)


class WordHashes(dict):
    """bytes -> 64-bit hash of a word; emptied when it has grown large."""

    LIMIT = 60_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system: a worker outlives its tasks, and an executor
    holds one for each core and Python step beside its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A function for mapInArrow that leaves nothing behind when its task ends."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()
    return task


def tidied_group(run: Callable) -> Callable:
    """As ``tidied``, for the tables of one group."""
    def group(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()
    return group


def tidied_pair(run: Callable) -> Callable:
    """As ``tidied``, for the tables of a group of two frames."""
    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()
    return pair


_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer, in place."""
    h ^= h >> np.uint64(32)
    h *= _C[0]
    h ^= h >> np.uint64(29)
    h *= _C[1]
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive uint64 symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = symbols[:n] * _C[1]
    for j in range(1, k):
        h ^= h >> np.uint64(31)
        h *= _C[2]
        h += symbols[j:j + n]
    return mix(h)
