"""Vectorised word tables of Arrow text columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are folded to a-z
before hashing.  Words are identified by 64-bit hashes: a keyed polynomial over
the bytes (modulo 2**64) with a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # texts are worked on in slices of about this size
BATCH_ROWS = 1000  # texts that a Python worker gets at a time

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RAW_KEYS = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_KEYS = _RAW_KEYS[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS, _INVERSES


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of some texts: byte positions in ``data``, text number, hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n_texts = data, offsets, len(offsets) - 1
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = solid.copy()
        last = solid.copy()
        if n:
            first[1:] &= ~solid[:-1] | edge[1:n]
            last[:-1] &= ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        #: words before each text; one more entry at the end
        self.bounds = np.searchsorted(self.start, offsets)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """A hash of each word; without ``fold`` capitals differ from small letters."""
        n = len(self.data)
        up, down = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_KEYS if fold else _RAW_KEYS)[self.data] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def bounded_batches(spark) -> None:
    """From here on, the session sends Python workers at most ``BATCH_ROWS`` rows at a time:
    rows of texts are large, and a worker holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about ``limit`` bytes; a
    longer text makes a run of its own."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end
    pa.default_memory_pool().release_unused()


def list_array(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.ListArray:
    """Consecutive runs of ``values`` as a list column."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
