"""Hashes of words, shared by the operators that work on word sequences."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from xxhash import xxh3_64_intdigest

#: Odd multipliers for combining and finishing hashes (fixed values of a well-known 64-bit finaliser and its kin).
M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class Recent(dict):
    """Results of ``make`` by key, for the keys of late. When ``most`` keys are there they become the old ones, and those
    that were old till then go, so that keys in frequent use stay and memory is bounded: long keys aren't kept at all."""

    def __init__(self, make: Callable, most: int = 50_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


#: The 64-bit hash of a word (bytes).
word_hash = xxh3_64_intdigest


class WordHashes(Recent):
    """64-bit hash of each word (bytes)."""

    def __init__(self, most: int = 50_000):
        super().__init__(word_hash, most)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= M1
    h ^= h >> np.uint64(33)
    h *= M2
    h ^= h >> np.uint64(33)
    return h


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive entries of h."""
    if len(h) < n:
        return h[:0]
    count, out = len(h) - n + 1, np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = mix(out * M3 + h[i : i + count])
    return out


def crc(key: object) -> int:
    """crc32 of a key's text, as the folds of held-out rows use it."""
    return zlib.crc32(str(key).encode())


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that neither an executor nor its Python workers hold much more text than they work on.

    A setting of the session, read when a query starts; smaller ones than these stay.
    """
    for name, most in (("maxRecordsPerBatch", 2_000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some ``most_bytes`` of text in ``column``, or of one row that has more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker that gives its memory back when a task ends, as the worker outlives it."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library, which has its own ways

    return wrapped
