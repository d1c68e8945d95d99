"""Shared helpers: table access, shared scratch folders, and byte-level word views in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import discard, key_bitmap, scratch, settle, stored, with_hit  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words over Arrow text buffers -------------------------------------------------------------

_B = np.arange(256)
LOWER = np.where((_B >= 0x41) & (_B <= 0x5A), _B + 0x20, _B).astype(np.uint8)
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased; bytes from 0x80 up only occur in such words.
ALNUM = (((_B >= 0x30) & (_B <= 0x39)) | ((_B >= 0x61) & (_B <= 0x7A)) | ((_B >= 0x41) & (_B <= 0x5A)) | (_B >= 0x80))
#: Word bytes of [^\x20\x09-\x0D].
NONSPACE = ~((_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D)))

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    global _pow
    if not _pow or len(_pow[0]) < n:
        size = max(n, 1 << 20)
        _pow = []
        for b in (_BASE, _INV):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _pow.append(np.multiply.accumulate(p))
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of several texts held in one byte buffer.

    data: the lower-cased bytes; starts, ends: each word's bytes; splits: the words of text i are
    splits[i]..splits[i+1]. Hashes of any byte range come from one running sum over the buffer.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM):
        self.data, self.offsets = LOWER[data], offsets
        isw = np.zeros(len(data) + 2, bool)
        isw[1:-1] = kind[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        inner = isw[1:-1]
        self.starts = np.flatnonzero(inner & (~isw[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(inner & (~isw[2:] | cut[1:])) + 1
        self.splits = np.searchsorted(self.starts, offsets)
        self._sum: np.ndarray | None = None

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        power, inverse = _powers(len(self.data) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=self._sum[1:])
        s = self.starts if starts is None else starts
        e = self.ends if ends is None else ends
        return mix((self._sum[e] - self._sum[s]) * inverse[s])


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: None


def release() -> None:
    """Give memory that earlier batches have freed back to the system: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of about `most` text bytes: (rows, their bytes, offsets). Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not wide and not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.string())
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null may cover bytes
        valid = np.asarray(col.is_valid())
        if (np.diff(offsets)[~valid] > 0).any():
            kept = col.fill_null("")
            yield from text_slices(pa.RecordBatch.from_arrays([kept if i == batch.schema.get_field_index(column) else c for i, c in enumerate(batch.columns)], names=batch.schema.names), column, most)
            return
    release()
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
