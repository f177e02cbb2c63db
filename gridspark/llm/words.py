"""Words and k-word hashes of whole text columns, in numpy over the Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. The hash of a word is a sum of random numbers,
one for each byte at its place in the word. Runs of words are hashed by polynomials over the word hashes modulo
the prime 2^61 - 1, taken as differences of prefix sums, so that one pass serves runs of any length. Sums and
polynomials of two seeds share nothing, so together they are hashes of about 122 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
#: Modulus of the polynomials, and their bases.
PRIME = (1 << 61) - 1
_BASES = (0x1E3779B97F4A7C15 % PRIME, 0x0761D6478BD642F1 % PRIME)
#: Places in a word whose numbers are tabulated; later ones are computed.
_PLACES = 64
#: Bytes whose words are hashed at a time.
_HASHED = 1 << 16
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_numbers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below 2^61, from halves that never overflow 64 bits."""
    a1, a0, b1, b0 = a >> _U(31), a & _U(0x7FFFFFFF), b >> _U(31), b & _U(0x7FFFFFFF)
    middle = a1 * b0 + a0 * b1
    # 2^62 is 2 and 2^61 is 1 in this modulus
    total = ((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _U(0x3FFFFFFF)) << _U(31)) + a0 * b0
    total = (total & _U(PRIME)) + (total >> _U(61))
    return np.where(total >= PRIME, total - _U(PRIME), total)


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of `base` and of its inverse modulo the prime, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size, both = 1 << max(16, (n - 1).bit_length()), []
        for b in (base, pow(base, -1, PRIME)):
            power = np.ones(1, np.uint64)
            while len(power) < size:
                power = np.concatenate([power, times(power, np.full(len(power), pow(b, len(power), PRIME), np.uint64))])
            both.append(power)
        have = _powers[base] = (both[0], both[1])
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """out[i]: the polynomial of the first i values, which are below 2^61."""
    terms = times(values, _power(base, len(values) + 1)[0][: len(values)])
    out = np.zeros(len(values) + 1, np.uint64)
    # sums of the upper and lower halves stay below 2^64 for 2^32 terms
    low, high = np.cumsum(terms & _U(0xFFFFFFFF), dtype=np.uint64), np.cumsum(terms >> _U(32), dtype=np.uint64)
    out[1:] = (_shift32(high) + low % _U(PRIME)) % _U(PRIME)
    return out


def _shift32(x: np.ndarray) -> np.ndarray:
    """x * 2^32 modulo the prime."""
    return ((x >> _U(29)) % _U(PRIME) + ((x & _U(0x1FFFFFFF)) << _U(32))) % _U(PRIME)


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomials of values[start:end]."""
    gap = sums[end] + (_U(PRIME) - sums[start])
    return times(np.where(gap >= PRIME, gap - _U(PRIME), gap), _power(base, len(sums))[1][start])


def _number(byte: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The random number of a byte at a place."""
    return mix(mix(byte.astype(np.uint64) + (place.astype(np.uint64) << _U(8)), 11 + seed), 13 + seed)


#: Kinds of bytes: 0 is white space; a word is a run of one kind. PLAIN knows one kind, FINE tells
#: letters (and every byte of a character beyond ASCII), digits and other characters apart.
PLAIN = np.ones(256, np.uint8)
PLAIN[[9, 10, 11, 12, 13, 32]] = 0
FINE = np.where(PLAIN > 0, 3, 0).astype(np.uint8)
FINE[48:58] = 2
FINE[65:91] = FINE[97:123] = FINE[128:] = 1


class Words:
    """The words of a run of texts: `doc` (row), `start`, `end` (bytes in `data`), `first` (word offsets by row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = PLAIN):
        self.data, self.offsets, n = data, offsets, len(data)
        kind = kinds[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:] = after[:-1] = kind[1:] != kind[:-1]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner], after[inner - 1] = True, True
        self.start = np.flatnonzero((kind > 0) & before)
        self.end = np.flatnonzero((kind > 0) & after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash per word; the hashes of different seeds share nothing."""
        if seed not in _numbers:
            _numbers[seed] = _number(np.tile(np.arange(256), _PLACES), np.repeat(np.arange(_PLACES), 256), seed)
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            # a run of words whose numbers stay in a core's cache, one word at least
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _HASHED, "right")))
            out[a:b] = self._sums(a, b, seed)
            a = b
        return mix(out + (self.end - self.start).astype(np.uint64), seed)

    def _sums(self, a: int, b: int, seed: int) -> np.ndarray:
        """Sums of the random numbers of the bytes of words a to b."""
        start, end = self.start[a:b] - self.start[a], self.end[a:b] - self.start[a]
        data = self.data[self.start[a]:self.end[b - 1]]
        begin = np.zeros(len(data), np.int32)
        begin[start] = start
        place = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(begin, out=begin)
        number = _numbers[seed].take(np.minimum(place, _PLACES - 1) * 256 + data)
        if (end - start).max() > _PLACES:
            late = np.flatnonzero(place >= _PLACES)
            number[late] = _number(data[late], place[late], seed)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(number, out=sums[1:])
        return sums[end] - sums[start]

    def left(self) -> np.ndarray:
        """For every word, how many words of its text begin here or later."""
        return self.first[self.doc + 1] - np.arange(len(self.start))


def _reduced(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Word hashes as values of a polynomial."""
    return mix(hashes, seed) >> _U(3)


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of k consecutive word hashes at each position that has k of them; texts are not told apart."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    at = np.arange(len(hashes) - k + 1)
    return mix(between(prefix(_reduced(hashes, seed), _BASES[seed]), at, at + k, _BASES[seed]), seed)


def spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the word hashes in each start:end, and of their number."""
    return mix(between(prefix(_reduced(hashes, seed), _BASES[seed]), start, end, _BASES[seed]) + ((end - start).astype(np.uint64) << _U(61)), seed)


def cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` in all, one row at least."""
    sums, row = np.concatenate([[0], np.cumsum(sizes)]), 0
    while row < len(sizes):
        end = max(row + 1, int(np.searchsorted(sums, sums[row] + limit, "right")) - 1)
        yield row, end
        row = end


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end
