"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on one flat byte buffer that holds several documents back to
back, so that the cost of a document does not depend on Python-level loops. Words are
maximal runs of bytes other than 0x20 and 0x09-0x0D, which is the same as splitting the
decoded text on those characters, since UTF-8 continuation bytes never take their values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_UP_TO = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Elements that are worked on at a time where an array is long.
_PART = 1 << 14
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit. Long arrays go through the cache in parts."""
    if len(x) <= _PART:
        return _mixed(x.copy())
    out = np.empty(len(x), U64)
    for i in range(0, len(x), _PART):
        out[i : i + _PART] = _mixed(x[i : i + _PART].copy())
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of any substring of a sequence of 64-bit symbols, in constant time each."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(symbols * powers(_BASE, n), out=self.prefix[1:])
        self.inverse = powers(_BASE_INV, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of symbols[start:end], which also depends on the length."""
        return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def every(self, width: int) -> np.ndarray:
        """Mixed hashes of all windows of this width, by start."""
        n = len(self.prefix) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = np.empty(n, U64)
        for i in range(0, n, _PART):
            part = slice(i, min(i + _PART, n))
            x = self.prefix[i + width : part.stop + width] - self.prefix[part]
            x *= self.inverse[part]
            x += U64(width * 0xD6E8FEB86659FD93 % (1 << 64))
            out[part] = _mixed(x)
        return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    base = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return base[offsets[0] : offsets[-1]], offsets - offsets[0]


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every document the number of its first word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = LONG_WORD) -> np.ndarray:
    """A hash of each word: eight bytes at a time through the finaliser, so that no run of letters cancels out."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, U64)
    eights = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))
    h = mix((eights[starts] & _UP_TO[np.minimum(n, 8)]) ^ (n.astype(U64) * U64(0xD6E8FEB86659FD93)))
    done, rest = 8, np.flatnonzero(n > 8)
    while len(rest) and done < long:
        left = np.minimum(n[rest] - done, 8)
        h[rest] = mix((h[rest] * U64(0x9FB21C651E98DF25)) ^ (eights[starts[rest] + done] & _UP_TO[left]))
        done += 8
        rest = rest[n[rest] > done]
    for i in rest.tolist():
        h[i] ^= U64(xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]]))
    return h


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


def owners(offsets: np.ndarray) -> np.ndarray:
    """For every element of the ranges between offsets, the number of its range."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each document, in text order, and their offsets.

    A document of fewer words than width has one shingle, its whole sequence; without words it has none.
    """
    starts, ends, first = words(buf, offsets)
    seq = Rolling(word_hashes(buf, starts, ends))
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1], count) + np.repeat(first[:-1], count)
    end = np.minimum(at + width, np.repeat(first[1:], count))
    return seq.of(at, end), out


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each range, and their offsets."""
    v = values.copy()
    bounds = offsets.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[offsets[:-1][offsets[:-1] < len(v)]] = True
    before = np.zeros(len(v) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return v[keep], before[offsets]


def slices(lengths: np.ndarray, most: int):
    """Ranges of rows that hold about this many bytes each; a longer row stands alone."""
    begin, total = 0, 0
    for i, x in enumerate(lengths.tolist()):
        if total and total + x > most:
            yield begin, i
            begin, total = i, 0
        total += x
    if begin < len(lengths):
        yield begin, len(lengths)
