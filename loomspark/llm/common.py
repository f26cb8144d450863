"""Shared plumbing: materialised tables, checked broadcasts and vectorised byte tokenisation."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Tables, adopted, drop_table, materialize, shared_dir  # noqa: F401

#: Spaces and the controls U+0009 to U+000D end a word.
WORD = r"[^\x20\x09-\x0D]+"
_DELIM = np.zeros(256, dtype=bool)
_DELIM[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_small(df: DataFrame, table: DataFrame, on: str | list[str], max_rows: int = 100_000) -> DataFrame:
    """Left join, broadcasting ``table`` only when it is counted to have at most ``max_rows``.

    Beyond that bound a shuffled join is planned, whose skewed partitions AQE splits.
    """
    if table.limit(max_rows + 1).count() <= max_rows:
        table = F.broadcast(table)
    return df.join(table, on, "left")


def give_back() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def frugal(run):
    """``run`` over Arrow batches that hands freed memory back to the system when its task ends, so that
    workers which wait for the next stage stay small."""

    def call(batches):
        yield from run(batches)
        give_back()

    return call


def utf8_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and their n+1 offsets (from 0); a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray, delim: np.ndarray = _DELIM) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of every word; no word crosses the end of a document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~delim[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[-1] = True, True
    np.logical_not(inside[:-1], out=first[1:-1])
    first[off[off < len(data)]] = True
    start = np.flatnonzero(inside & first[:-1])
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    cuts = off[(off > 0) & (off <= len(data))] - 1
    last[cuts] = True
    return start, np.flatnonzero(inside & last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Words beyond this many bytes are hashed one by one.
LONG = 256


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: eight bytes at a time, mixed into what precedes them.

    No family of words is known to collide, as some do under polynomials modulo 2**64. Hashes still choose
    candidates only: what removes or links compares the words.
    """
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    some = slice(None)
    for at in range(0, LONG, 8):
        left = size[some] - at
        x = eight[start[some] + at]
        short = np.flatnonzero(left < 8)
        x[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        h[some] = mix(h[some] ^ (x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(at)))
        some = np.flatnonzero(size > at + 8)
        if not len(some):
            return h
    import xxhash

    raw = memoryview(padded)
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]])
    return h


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one array (windows may cross documents)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : j + n]
        h ^= h >> np.uint64(32)
    return mix(h)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """Pieces of a batch of at most ``most`` bytes of text, or of one row."""
    off = utf8_buffer(batch.column(batch.schema.get_field_index(column)))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def ragged(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``data`` put together, and the n+1 offsets of the slices there."""
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return data[np.repeat(starts - off[:-1], sizes) + np.arange(off[-1])], off


def to_ipc(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(raw) as reader:
        return reader.read_next_batch()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed bytes: differences, byte plane by byte plane."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
