"""Vectorised words of Arrow text batches: positions, 64-bit word ids, rolling shingle ids.

A batch is worked on as one byte buffer in chunks of about one megabyte of whole documents, so
memory is bounded by the chunk or by the longest single document, about 60 bytes for each of
its bytes. Word ids are polynomial sums over a random byte table modulo 2^64 with a final mix;
two different words share an id with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE_CODES.copy()
_LOWER[65:91] = _BYTE_CODES[97:123]
_BASE = 0x9E6C63D0876A9A47
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.multiply.accumulate(np.full(n - 1, base, np.uint64))
    return out


class _Table:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)


_table = _Table()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranged(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial sums of ``values[start:end]``, independent of where the range lies."""
    _table.need(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _table.up[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * _table.down[starts]


class Chunk:
    """Whole documents of one batch: bytes, word bounds and ids.

    ``offsets`` bound the documents in ``data``; ``first[d]`` is document d's first word and
    ``first[d + 1]`` ends it. ``rows`` is the slice of the batch.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice, fold: bool) -> None:
        self.data, self.offsets, self.rows = data, offsets, rows
        text = ~SPACE[data]
        begins, ends = text.copy(), text.copy()
        if len(data):
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begins[1:] &= ~text[:-1] | edge[1:-1]
            ends[:-1] &= ~text[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.ids = mixed(ranged((_LOWER if fold else _BYTE_CODES)[data], self.starts, self.ends))

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def document_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), self.n_words)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all runs of ``width`` words inside one document, and their ids."""
        n = len(self.ids)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], self.n_words)[: n - width + 1]
        at = np.flatnonzero(np.arange(width, n + 1) <= last)
        return at, mixed(ranged(self.ids, at, at + width))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds.astype(np.int64) - bounds[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of whole documents of about ``limit`` bytes, one document at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield slice(start, stop)
        start = stop


def chunks(column: pa.Array, fold: bool = False) -> Iterator[Chunk]:
    """The chunks of a text column; ``fold`` lower-cases A-Z in the ids."""
    data, offsets = buffer_of(column)
    for rows in slices(offsets):
        low = offsets[rows.start]
        own = offsets[rows.start : rows.stop + 1] - low
        yield Chunk(data[low : offsets[rows.stop]], own, rows, fold)


def mapped(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """The iterator function mapInArrow takes, from a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return run


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
