"""Word and window hashing of whole text columns, without a Python loop over words.

An Arrow string column is one UTF-8 buffer plus offsets.  The kernels below work
on that buffer with numpy: words are the runs of bytes other than the ASCII white
space 0x20 and 0x09-0x0D (all bytes of a multi-byte character are above 0x7F, so
bytes and characters agree), hashes are polynomials modulo 2**64 taken from prefix
sums, and the hash of ``k`` consecutive words comes from a second prefix sum.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "second": 0xA0761D6478BD642F}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n (B is odd, so it has an inverse)."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (_BASES[kind], pow(_BASES[kind], -1, 2**64)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[kind] = (out[0], out[1])
    return _POWERS[kind]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h + np.uint64(salt)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0]:o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


class Words:
    """Words of a run of rows: byte ``start``/``end`` of each, ``first[i]:first[i+1]`` are those of row i."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = False):
        self.raw = LOWER[raw] if lower else raw
        inside = ~SPACE[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = off[:-1][off[:-1] < off[1:]]
        begins[edge] = inside[edge]
        last = off[1:][off[:-1] < off[1:]] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)

    def hashes(self) -> np.ndarray:
        p, q = _powers("byte", len(self.raw) + 1)
        total = np.empty(len(self.raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[self.raw] * p[:len(self.raw)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(np.uint64))


def sequence_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray | int, second: bool = False) -> np.ndarray:
    """Hash of the words ``h[start : start + length]`` of each start; ``second``: an independent one."""
    kind = "second" if second else "word"
    p, q = _powers(kind, len(h) + 1)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum((mix(h, 0x51ED270B) if second else h) * p[:len(h)], out=total[1:])
    return mix((total[start + length] - total[start]) * q[start] + np.asarray(length).astype(np.uint64))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """First word of every window of ``width`` consecutive words that lies in one row."""
    n = first[1:] - first[:-1]
    count = np.maximum(n - width + 1, 0)
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[:-1] - (ends - count), count)


TEXT_ROWS = 1000  # rows of an Arrow batch that holds whole texts


def small_batches(spark: SparkSession) -> None:
    """Whole texts cross to Python in batches of at most ``TEXT_ROWS`` rows: Spark's 10,000 take tens of MB for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver next collects garbage.

    For steps that checkpoint what they read again; the session's own setting is put back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(fn):
    """``fn`` (a generator over batches, or a function of one or two tables) with its memory given back when it ends."""
    def over(batches):
        try:
            yield from fn(batches)
        finally:
            release_memory()

    def of(table):
        try:
            return fn(table)
        finally:
            release_memory()

    def of_both(left, right):
        try:
            return fn(left, right)
        finally:
            release_memory()

    return over if inspect.isgeneratorfunction(fn) else of if len(inspect.signature(fn).parameters) == 1 else of_both


def pieces(col: pa.Array, most: int = 2 << 20):
    """(first row, last row + 1) of runs of rows with at most ``most`` bytes of text, or one longer row."""
    _, off = text_buffer(col)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, to
        at = to


def pack_sorted(sorted_values: np.ndarray) -> bytes:
    """Sorted integers as byte planes of their differences (the high planes compress well)."""
    d = np.diff(sorted_values, prepend=0).astype(np.uint64)
    planes = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    low = (d & np.uint64(255)).astype(np.uint8).tobytes()
    high = b"".join(((d >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8).tobytes() for k in range(1, planes))
    return len(d).to_bytes(8, "little") + low + zlib.compress(high, 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    d = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    high = np.frombuffer(zlib.decompress(blob[8 + n:]), np.uint8)
    for k in range(len(high) // n if n else 0):
        d += high[k * n:(k + 1) * n].astype(np.int64) << (8 * (k + 1))
    return np.cumsum(d)


class ArrayLookup:
    """Position of 64-bit keys, for whole arrays: a hash table, and further ones for the keys that clash in it."""

    BITS = 19

    def __init__(self, keys: np.ndarray, none: int):
        self.none, shift = none, np.uint64(64 - self.BITS)
        self.levels = []
        values, rng = np.arange(len(keys), dtype=np.int32), np.random.default_rng(0)
        while len(keys):
            best = None
            for _ in range(8):
                by = rng.integers(1, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                slot = (keys * by) >> shift
                first = np.unique(slot, return_index=True)[1]
                if best is None or len(first) > len(best[2]):
                    best = by, slot, first
            by, slot, first = best
            table, value = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, none, np.int32)
            table[slot[first]], value[slot[first]] = keys[first], values[first]
            self.levels.append((by, table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, self.none, np.int32)
        for by, table, value in self.levels:
            slot = (h * by) >> np.uint64(64 - self.BITS)
            hit = table[slot] == h
            out[hit] = value[slot[hit]]
        return out
