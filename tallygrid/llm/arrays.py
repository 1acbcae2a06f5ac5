"""Words, lines and n-grams of Arrow text columns as numpy arrays.

Texts are read in place from Arrow's UTF-8 buffer: no string object is made.  A word's
64-bit hash is a polynomial over its bytes, taken from one running sum per block, so
the work per byte is a few vector operations.  Blocks are cut between words, which
bounds memory whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so powers have inverses modulo 2**64
_U = np.uint64

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: Bytes that do not continue a UTF-8 character.
LEADS = (np.arange(256) & 0xC0) != 0x80
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


@dataclass
class Spans:
    """Words (or lines) of some texts: 64-bit hash, byte range, first span of each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


@dataclass
class Texts:
    """A text column: bytes and the offset of each text (null counts as empty)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, breaks: np.ndarray = SPACES, fold: np.ndarray = SAME) -> Spans:
        """Maximal runs of bytes that are no ``breaks``, hashed after ``fold``."""
        data, offsets = self.data, self.offsets
        hashes, starts, ends = [], [], []
        at, stop = 0, len(data)
        while at < stop:
            to = min(at + BLOCK, stop)
            while to < stop and not breaks[data[to]]:
                more = np.flatnonzero(breaks[data[to : to + BLOCK]])
                to += int(more[0]) if len(more) else min(BLOCK, stop - to)
            block = data[at:to]
            inside = ~breaks[block]
            edge = np.ones(len(block) + 1, bool)
            edge[1:-1] = inside[1:] != inside[:-1]
            cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")]
            edge[cut - at] = True
            places = np.flatnonzero(edge)
            first = places[:-1]
            word = inside[first]
            first, last = first[word], places[1:][word]
            up, down = _power_tables(len(block))
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_BYTE[fold[block]] * up[: len(block)], out=sums[1:])
            h = (sums[last] - sums[first]) * down[first]
            hashes.append(mix(h + (last - first).astype(np.uint64)))
            starts.append(first + at)
            ends.append(last + at)
            at = to
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        return Spans(h, start, end, np.searchsorted(start, offsets))

    def counts(self, kind: np.ndarray) -> np.ndarray:
        """Running count of bytes of a ``kind`` (a table of 256 booleans)."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(kind[self.data], out=out[1:])
        return out


def texts_of(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return Texts(data[at[0] : at[-1]], at - at[0])


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text (always at least one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def windows(spans: Spans, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the ascending ``sizes``: the hashes of so many consecutive spans of one
    text, and the index of the first.  Each hash extends that of the next shorter run."""
    h, owner = spans.hash, spans.owner
    out = h
    for n in range(1, sizes[-1] + 1):
        if n > len(h):
            out = out[:0]
        elif n > 1:
            out = mix(out[: len(h) - n + 1]) + h[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(owner[: len(out)] == owner[len(owner) - len(out) :])
            yield n, mix(out[at] + _U(n)), at


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per span) over each text."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def seen_twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Which keys repeat an earlier one."""
    out = np.zeros(len(keys), bool)
    again = np.flatnonzero(seen_twice(keys))
    if len(again):
        _, first = np.unique(keys[again], return_index=True)
        out[again] = True
        out[again[first]] = False
    return out
