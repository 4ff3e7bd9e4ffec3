"""Vectorised scans of Arrow string columns: bytes, words and rolling hashes with numpy."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of the class [\x20\x09-\x0D], which separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def bound_batches(spark, size: int = 4 << 20) -> None:
    """Let Arrow batches of this session hold at most size bytes: they carry whole texts, and both the JVM's and the
    worker's copies of a batch lie outside the heap. A smaller setting is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)\s*(b|k|m|g)?b?", str(spark.conf.get(key)).strip().lower())
    scale = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if not now or not 0 < int(now[1]) * scale[now[2] or "b"] <= size:
        spark.conf.set(key, str(size))


def _lower(table: np.ndarray) -> np.ndarray:
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


def alnum_table() -> np.ndarray:
    """Byte -> lower-cased byte of the word class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lowering A-Z, else 0."""
    table = np.zeros(256, np.uint8)
    table[0x30:0x3A] = np.arange(0x30, 0x3A)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return _lower(table)


def space_table(lower: bool = True) -> np.ndarray:
    """Byte -> byte (A-Z lowered if asked) outside the space class, else 0. The byte 0 is a word byte there: it maps to 1."""
    table = np.arange(256).astype(np.uint8)
    table[0] = 1
    if lower:
        _lower(table)
    table[list(SPACES)] = 0
    return table


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and what the C library keeps for later adds up beside the JVM."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about `limit` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


def word_bounds(mapped: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-zero bytes that don't cross row bounds."""
    inside = mapped != 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(mapped))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mapped bytes, word starts, word ends, for each row the index of its first word, with an end mark)."""
    mapped = table[data]
    starts, ends = word_bounds(mapped, offsets)
    return mapped, starts, ends, np.searchsorted(starts, offsets)


def word_array(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as one Arrow binary array."""
    sizes = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=sizes[1:])
    packed = mapped[mapped != 0]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes), pa.py_buffer(packed)])


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i], times the inverse base to the i, the polynomial hash of data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = _VALUES[data]
    values *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of data[start:end] for each span."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])
