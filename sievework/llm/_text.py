"""Vectorised hashing of whole Arrow string columns.

A batch of texts is one byte buffer with offsets, exactly as Arrow keeps it, so words, shingles and
windows of thousands of documents are hashed by a few numpy passes with no loop over rows. A hash
depends on the bytes it covers and on the run's key alone: never on their place, their document or the
machine.

Spans are hashed by a polynomial modulo the prime 2**61 - 1 at a point drawn from the key of the run
(`_spark.hash_key`). Two different spans of n values agree at no more than n of the 2**61 points, so no
text that was written without knowing the key can make them agree but by luck of n / 2**61.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK64 = (1 << 64) - 1
#: The prime modulus of the span hash, and the halves that keep its products inside 64 bits.
PRIME = (1 << 61) - 1
P61, M31, M30 = U64(PRIME), U64((1 << 31) - 1), U64((1 << 30) - 1)
U30, U31, U61 = U64(30), U64(31), U64(61)
#: ASCII white space, the separators of the word pattern [^\x20\x09-\x0D]+.
WHITE_SPACE = np.zeros(256, dtype=bool)
WHITE_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one numpy pass handles.
SLICE_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(29))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) from 64-bit hashes."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


#: Small values of bytes: their products with halves of powers need no reduction.
BYTE_VALUES = np.arange(1, 257, dtype=np.uint16)
#: Values of one numpy pass: its temporaries stay in the cache.
BLOCK = 1 << 14
#: Values up to here may be summed unreduced.
SMALL_SUMS = 1 << 23


def point_of(key: int) -> int:
    """The polynomial's point for a key, spread over the field and never near its ends."""
    return int(mix64(np.array([key & MASK64], dtype=U64))[0]) % (PRIME - (1 << 32)) + (1 << 31)


def _reduced(x: np.ndarray) -> np.ndarray:
    return (x & P61) + (x >> U61)


def _times(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """The product modulo 2**61 - 1 of numbers given in halves of 31 and 30 bits; below the prime plus 8."""
    middle = low * high2 + high * low2
    return _reduced(((high * high2) << U64(1)) + (middle >> U30) + ((middle & M30) << U31) + low * low2)


def _powers(point: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    done, step = 1, point
    while done < n:
        more = min(done, n - done)
        head, by = out[:more], U64(step)
        x = _times(head & M31, head >> U31, by & M31, by >> U31)
        out[done : done + more] = x - P61 * (x >= P61)
        done, step = done + more, step * step % PRIME
    return out


class Powers:
    """Powers of the point and of its inverse, in halves, grown as longer inputs ask for them."""

    def __init__(self, point: int) -> None:
        self.point, self.n = point, 0

    def get(self, n: int) -> tuple[np.ndarray, ...]:
        if self.n < n + 1:
            self.n = max(n + 1, 2 * SLICE_BYTES)
            up, down = _powers(self.point, self.n), _powers(pow(self.point, -1, PRIME), self.n)
            self.halves = up & M31, up >> U31, down & M31, down >> U31
        return self.halves


#: Powers by point: that of the run in use, and any that a caller fixes.
_KNOWN: dict[int, Powers] = {}
_IN_USE = [0]


def use_key(key: int) -> None:
    """Hash by this key from now on in this process; all tasks of a run use one key."""
    _IN_USE[0] = key


class Spans:
    """Hashes of any spans of a sequence of values, from prefix sums. key: a fixed one, instead of the run's."""

    def __init__(self, values: np.ndarray, key: int | None = None) -> None:
        point = point_of(_IN_USE[0] if key is None else key)
        if point not in _KNOWN:
            if len(_KNOWN) > 3:
                _KNOWN.clear()
            _KNOWN[point] = Powers(point)
        low, high, self.low, self.high = _KNOWN[point].get(len(values))
        n = len(values)
        self.sums, self.tops = np.zeros(n + 1, dtype=U64), np.zeros(n + 1, dtype=U64)
        small = values.dtype == np.uint16 and n <= SMALL_SUMS
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            part = values[a:b].astype(U64, copy=False)
            if small:
                part, tops = part * low[a:b], part * high[a:b]
            else:
                part = _reduced(part)
                part = _times(part & M31, part >> U31, low[a:b], high[a:b])
                part, tops = part & M31, part >> U31
            part[0] += self.sums[a]
            tops[0] += self.tops[a]
            np.cumsum(part, out=self.sums[a + 1 : b + 1])
            np.cumsum(tops, out=self.tops[a + 1 : b + 1])

    def _between(self, sums: np.ndarray, tops: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        tops = _reduced(tops)
        x = _reduced(((tops & M30) << U31) + (tops >> U30) + _reduced(sums))
        x = _times(x & M31, x >> U31, low, high)
        x = x - P61 * (x >= P61)
        return mix64(x + np.asarray(length).astype(U64) * U64(0x9E3779B97F4A7C15))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), dtype=U64)
        for at in range(0, len(start), BLOCK):
            s, e = start[at : at + BLOCK], end[at : at + BLOCK]
            out[at : at + BLOCK] = self._between(self.sums[e] - self.sums[s], self.tops[e] - self.tops[s], self.low[s], self.high[s], e - s)
        return out

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of one length; [] if the sequence is shorter."""
        n = max(0, len(self.sums) - length)
        out = np.empty(n, dtype=U64)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            out[a:b] = self._between(self.sums[a + length : b + length] - self.sums[a:b], self.tops[a + length : b + length] - self.tops[a:b], self.low[a:b], self.high[a:b], length)
        return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return (whole[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (whole[:0], np.zeros(1, dtype=np.int64))


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `most` bytes of the named column, or one row if that is longer."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(name))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte places of all words; words of row i are first[i]:first[i + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~gaps[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0] = after[-1] = False
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before[edge] = False
    after[edge - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int | None = None) -> np.ndarray:
    return Spans(BYTE_VALUES[data], key).hash(starts, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, first): runs of `width` words inside each row; a row of fewer words has one, of all its words."""
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    row = np.repeat(np.arange(len(n)), counts)
    start = first[:-1][row] + np.arange(len(row)) - out_first[:-1][row]
    return Spans(hashes).hash(start, np.minimum(start + width, first[1:][row])), out_first
