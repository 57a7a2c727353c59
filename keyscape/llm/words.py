"""Words of many texts at once: boundaries and 64-bit hashes from the UTF-8 bytes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []

#: Bytes of words between white space (all but 0x20 and 0x09-0x0D).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits: 0-9, a-z and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case for A-Z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[U(1)], np.cumprod(np.full(size, b, U))]) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray, lower: bool = True):
    """(start, stop, first) of the words of all rows: byte positions, and each row's first word.

    `data` holds the rows' bytes, `ends` the rows' offsets (one more than rows).
    Words don't reach over rows; row r has the words first[r]..first[r + 1].
    """
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    inner = ends[(ends < len(data))]
    before[inner] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[inner[inner > 0] - 1] = False
    stop = np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, ends)


#: Words of more bytes are hashed by BLAKE2: long texts can be built whose polynomials modulo 2**64 are equal.
LONG_WORD = 512


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes in all batches."""
    if not len(start):
        return np.zeros(0, U)
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((_VALUES[LOWER] if lower else _VALUES)[data] * power[: len(data)], out=sums[1:])
        out = mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(U))
    for k in np.flatnonzero(stop - start > LONG_WORD):
        word = data[start[k] : stop[k]]
        out[k] = int.from_bytes(hashlib.blake2b((LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    return out


def hashed_words(data: np.ndarray, ends: np.ndarray, is_word: np.ndarray, lower: bool = True, strip: int = 1 << 22):
    """(start, stop, first, hash) of the words of all rows, as `words` and `hashes` give them.

    A text of any length is gone through in strips of about `strip` bytes that end between words, so that
    only numbers of its words are held whole.
    """
    found, lo = [], 0
    while lo < len(data):
        hi = min(lo + strip, len(data))
        while hi < len(data):  # on to the end of a word
            more = is_word[LOWER[data[hi : hi + 4096]] if lower else data[hi : hi + 4096]]
            hi += len(more) if more.all() else int(np.argmin(more))
            if not more.all():
                break
        part = data[lo:hi]
        inner = ends[(ends > lo) & (ends < hi)] - lo
        start, stop, _ = words(part, np.concatenate([[0], inner, [len(part)]]), is_word, lower)
        found.append((start + lo, stop + lo, hashes(part, start, stop, lower)))
        lo = hi
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(ends), np.int64), np.zeros(0, U)
    start, stop, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return start, stop, np.searchsorted(start, ends), value


def strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The words at these places of UTF-8 bytes, as an Arrow string column."""
    size = stop - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at])))


def rolling(word: np.ndarray, first: np.ndarray, width: int, seed: int = 0x2545F4914F6CDD1D):
    """(place, hash) of all runs of `width` words within a row; place is the number of the first word."""
    size = max(len(word) - width + 1, 0)
    with np.errstate(over="ignore"):
        acc = np.zeros(size, U)
        for k in range(width):
            acc = acc * U(seed) + word[k : k + size]
        acc = mix(acc)
    left = np.repeat(first[1:], np.diff(first))[:size] - np.arange(size)
    place = np.flatnonzero(left >= width)
    return place, acc[place]


def shingles(word: np.ndarray, first: np.ndarray, width: int):
    """(row, hash) of each row's distinct shingles of `width` words, by row, then hash.

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    count = np.diff(first)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(word), U)
        for k in range(min(width, len(word))):  # those that would reach over the end are dropped below
            acc[: len(word) - k] = acc[: len(word) - k] * U(0x2545F4914F6CDD1D) + word[k:]
        acc = mix(acc)
        row_of = np.repeat(np.arange(len(count)), count)
        left = first[1:][row_of] - np.arange(len(word))
        full = left >= width
        rows, values = row_of[full], acc[full]
        short = np.flatnonzero((count > 0) & (count < width))
        whole = np.zeros(len(short), U)
        for k in range(width - 1):  # word k of those that have one
            more = count[short] > k
            whole[more] = whole[more] * U(0x2545F4914F6CDD1D) + word[first[short[more]] + k]
        rows, values = np.append(rows, short), np.append(values, mix(whole + count[short].astype(U)))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    rows, values = rows[order], values[order]
    if len(rows):
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[keep], values[keep]
    return rows, values
