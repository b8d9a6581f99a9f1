"""Word hashes of whole Arrow batches of texts, without a Python object per word.

A word is a maximal run of bytes that a table maps to non-zero. Words get 64-bit hashes: a polynomial over random
byte values, then a finaliser. Everything here runs inside one task on one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is a chunk by itself.
CHUNK_BYTES = 1 << 20
#: Powers kept in a table.
STRIDE = 1 << 16

_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def blank_table() -> np.ndarray:
    """Bytes 0x20 and 0x09-0x0D separate words; A-Z become a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[32, *range(9, 14), 0]] = [0] * 6 + [1]
    return t


def letter_table() -> np.ndarray:
    """Only ASCII letters and digits and bytes from 0x80 make words; A-Z become a-z."""
    t = np.zeros(256, np.uint8)
    for lo, hi in ((48, 58), (97, 123), (128, 256)):
        t[lo:hi] = np.arange(lo, hi)
    t[65:91] = np.arange(97, 123)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(pos: np.ndarray, longest: int) -> np.ndarray:
    """Powers of the base; beyond ``STRIDE`` as a product of two, so the tables stay small whatever a word's length."""
    global _power
    if len(_power) < min(longest, STRIDE):
        size = min(STRIDE, max(4096, 1 << int(longest - 1).bit_length()))
        _power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
    if longest <= STRIDE:
        return _power[pos]
    step = np.uint64(pow(int(_BASE), STRIDE, 1 << 64))
    far = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest // STRIDE, step, np.uint64)]))
    return _power[pos % STRIDE] * far[pos // STRIDE]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def hash_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes in order, and for each text the index of its first word (one more at the end)."""
    base = int(offsets[0])
    m = table[data[base : int(offsets[-1])]]
    at = offsets - base
    inside = m != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(m)]
    begins[heads] = inside[heads]
    idx = np.flatnonzero(inside)
    first = np.flatnonzero(begins[idx])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(first, append=len(idx))
    pos = np.arange(len(idx)) - np.repeat(first, lengths)
    values = _BYTE[m[idx]] * _powers(pos, int(lengths.max()))
    hashes = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(idx[first], at)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals from U+00C0 to U+00DE made small (U+00D7 is no letter)."""
    after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    if not len(after):
        return data
    out = data.copy()
    out[after] += 0x20
    return out


def hashed(column: pa.Array, table: np.ndarray, latin: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk of a column: number of its first text, word hashes, first word of each text."""
    data, off = texts_of(column)
    if latin:
        data = lower_latin(data)
    for lo, hi in chunks(off):
        words, bounds = hash_words(data, off[lo : hi + 1], table)
        yield lo, words, bounds
