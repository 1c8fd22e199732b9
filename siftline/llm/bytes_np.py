"""Batch string work on Arrow columns with numpy: no loop over characters, words or shingles.

A batch is laid out as one byte array with document offsets. Words are the runs between the six
ASCII white-space bytes (0x20, 0x09-0x0D); every hash is a polynomial over the bytes, modulo the prime
2**61 - 1, taken from running sums, so its cost doesn't depend on how long words, lines or texts are. Two
different strings of n bytes have one value for n of the 2**61 points at most (modulo a power of two, regular
strings would cancel for any point).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PRIME = (1 << 61) - 1
#: The points of the polynomials over bytes, and of the two over words; drawn once.
BYTE_POINT = 0x1E3779B97F4A7C15 % PRIME
WORD_POINTS = (0x12B2AE3D27D4EB4F, 0x0D6E8FEB86659FD9)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.arange(1, 257, dtype=U)
_LOWER_CODE = _CODE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def modulo(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo PRIME."""
    x = (x & U(PRIME)) + (x >> U(61))
    x -= (x >= U(PRIME)) * U(PRIME)
    return x


_LOW31, _LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME; both up to about 2**61."""
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    mid = a1 * b0
    mid += a0 * b1
    a1 *= b1
    a1 <<= U(1)
    a0 *= b0
    a1 += a0
    a1 += mid >> U(30)
    mid &= _LOW30
    mid <<= U(31)
    a1 += mid
    return modulo(a1)


_KEPT = 1 << 21
_powers: dict[int, np.ndarray] = {}
_halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(point: int, n: int) -> np.ndarray:
    """point**0 .. point**(n-1) modulo PRIME; kept up to a size, as batches are about the same size."""
    got = _powers.get(point)
    if got is None or len(got) < n:
        got = np.ones(1, U) if got is None else got
        while len(got) < n:
            got = np.concatenate([got, times(got, np.full(1, pow(point, len(got), PRIME), U))])
        if len(got) <= _KEPT:
            _powers[point] = got
    return got[:n]


def halves(point: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The lower 31 bits of the powers, and the others."""
    got = _halves.get(point)
    if got is None or len(got[0]) < n:
        whole = powers(point, max(n, 1 << 20))
        got = whole & _LOW31, whole >> U(31)
        if len(whole) <= _KEPT:
            _halves[point] = got
    return got[0][:n], got[1][:n]


def _shift(point: int, by: np.ndarray) -> np.ndarray:
    """point**-by modulo PRIME of each `by`, from three small tables."""
    inverse = pow(point, -1, PRIME)
    out = powers(inverse, 1 << 12)[by & 4095]
    for bits in (12, 24, 36):
        digit = (by >> bits) & 4095
        if digit.any():
            out = times(out, powers(pow(inverse, 1 << bits, PRIME), 1 << 12)[digit])
    return out


#: A run whose sums could pass 64 bits is summed in parts.
_LONGEST = 1 << 23


class Polynomial:
    """Values of the polynomials whose coefficients are runs of an array."""

    def __init__(self, values: np.ndarray, point: int, small: bool):
        """values: below 2**9 if small, else below PRIME."""
        self.point, n = point, len(values)
        if small:
            low, high = (values * half for half in halves(point, n))
        else:
            part = times(values, powers(point, n))
            low, high = part & _LOW31, part >> U(31)
        self.low, self.high = np.zeros(n + 1, U), np.zeros(n + 1, U)
        np.cumsum(low, out=self.low[1:])
        np.cumsum(high, out=self.high[1:])

    def _sums(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            low, high = self.low[e] - self.low[s], self.high[e] - self.high[s]
        high = (high & U(PRIME)) + (high >> U(61))
        low = (low & U(PRIME)) + (low >> U(61)) + (high >> U(30)) + ((high & _LOW30) << U(31))
        return (low & U(PRIME)) + (low >> U(61))

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Of each run values[s:e], whatever stands before it."""
        total, at = self._sums(s, np.minimum(e, s + _LONGEST)), s + _LONGEST
        while (at < e).any():
            start = np.minimum(at, e)
            total = modulo(total + self._sums(start, np.minimum(e, start + _LONGEST)))
            at = at + _LONGEST
        return times(total, _shift(self.point, s))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its document offsets; a null is an empty text."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


#: ASCII letters and digits, and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def runs(raw: np.ndarray, off: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes in the set `of`, and the index of the first run of each document (and one past the last).

    A document's edge ends a run: texts that meet in the byte array don't run together.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = of[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = off[:-1][off[1:] > off[:-1]]
    start[edges] = inside[edges]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of anything but the six ASCII white-space bytes."""
    return runs(raw, off, ~_IS_SPACE)


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each raw[s:e]; A-Z count as a-z if lower."""
    if not len(s):
        return np.zeros(0, U)
    value = Polynomial((_LOWER_CODE if lower else _CODE)[raw], BYTE_POINT, True).of(s, e)
    with np.errstate(over="ignore"):
        return mix(value + mix((e - s).astype(U)))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values of h (empty if there are fewer)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = mix(h[:m])
        for i in range(1, k):
            out = mix(out + h[i : i + m])
        return out


#: Bits of a shingle hash in a set; the rest of a word sorts by document. A piece has fewer than 2**12 documents.
SET_BITS = 52
MOST_DOCS = 1 << (64 - SET_BITS)


def doc_windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie within one document, their first words, and their documents."""
    many = np.maximum(np.diff(first) - (k - 1), 0)
    doc = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1], many)
    return window_hashes(h, k)[at] if len(at) else np.zeros(0, U), at, doc


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes (of SET_BITS) of each document, end to end, and their offsets.

    A document with fewer than k words has its whole word sequence as one shingle; one without words has none.
    """
    s, e, first = words(raw, off)
    h = span_hashes(raw, s, e)
    docs, count = len(off) - 1, np.diff(first)
    if docs > MOST_DOCS:
        raise ValueError(f"a piece has {MOST_DOCS} documents at most")
    hashes, _, doc = doc_windows(h, first, k)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = [window_hashes(h[first[d] : first[d + 1]], int(count[d]))[0] ^ U(int(count[d])) for d in short]
        hashes, doc = np.concatenate([hashes, np.array(own, U)]), np.concatenate([doc, short])
    both = np.sort((doc.astype(U) << U(SET_BITS)) | (hashes >> U(64 - SET_BITS)))
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    sizes = np.bincount((both >> U(SET_BITS)).astype(np.int64), minlength=docs)
    return both & U((1 << SET_BITS) - 1), np.concatenate(([0], np.cumsum(sizes)))


def repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of the hashes occur twice or more in their document."""
    with np.errstate(over="ignore"):
        own = hashes ^ mix(doc.astype(U) + U(1))
    order = np.argsort(own)
    v = own[order]
    same = v[1:] == v[:-1]
    out = np.zeros(len(own), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def code_points(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Characters in each raw[start:end] of UTF-8."""
    total = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
    return total[ends] - total[starts]
