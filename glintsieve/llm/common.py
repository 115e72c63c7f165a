"""Shared helpers: the shared folder, written tables, numpy views of Arrow strings and word hashes."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glintsieve.sinks.shared import fresh_path, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession) -> int:
    """Number of partitions for an explicit repartition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever others there are."""
    return df.select(*[df[n] for n in names])


def fresh_name(df: DataFrame, label: str) -> str:
    """A column name that df does not have yet."""
    taken = {n.lower() for n in df.columns}
    name = f"_{label}"
    while name in taken:
        name = f"_{name}"
    return name


# --- numpy views ---------------------------------------------------------------------------------


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def by_size(batch: pa.RecordBatch, name: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of the column each: bounds memory with long texts."""
    offsets, _ = text_buffer(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE = (np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) << _U(1)) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_SHINGLE = 0x369DEA0F31A53F85


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer buffer comes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))


def words_of(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, their byte starts and ends, and the first word of each text (n + 1)."""
    n = len(data)
    _Powers.reach(n + 1)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~_SEPARATOR[data]
    first, last = word.copy(), word.copy()
    if n:
        first[1:] &= ~word[:-1] | edge[1:n]
        last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    values = (_TABLE[_LOWER] if lower else _TABLE)[data]
    values *= _Powers.up[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _Powers.down[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def grams_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each position on; past the end, of the words that are left."""
    out = np.zeros(len(words), np.uint64)
    for j in range(min(n, len(words))):
        out[: len(words) - j] += words[j:] * _U(pow(_SHINGLE, j + 1, 1 << 64))
    return mixed(out)


def windows_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each position on, for any n at the cost of one pass; len(words) - n + 1 of them."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    _Powers.reach(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _Powers.up[: len(words)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * _Powers.down[:count])


@contextmanager
def lean(release: Callable[[], None] | None = None) -> Iterator[None]:
    """For a task that fills large caches without cycles: no garbage collection meanwhile, and afterwards what other tasks of the worker need."""
    gc.disable()
    try:
        yield
    finally:
        if release:
            release()
        gc.enable()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
        if trim:
            trim(0)


def local_file(uri: str):
    """A pyarrow filesystem and the path in it, for file names in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
