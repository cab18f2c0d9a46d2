"""Vectorised text kernels shared by the operators: slicing of Arrow text columns, word finding, rolling hashes.

Every function works on bounded slices, so the memory of a Python worker does not grow with a document or a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one round of numpy work covers; a longer document is a slice of its own.
SLICE_BYTES = 1 << 19

_R = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits. Works on a copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: A random 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", _R), ("q", pow(_R, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"], _powers["q"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with S[j] - S[i] = sum of values[k] * R**k for i <= k < j, modulo 2**64."""
    p, _ = _power_table(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans, equal for spans of equal values and lengths, wherever they stand."""
    _, q = _power_table(len(sums))
    return mix64((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def rolling_hashes(values: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of m values; empty if there are fewer."""
    if len(values) < m:
        return np.empty(0, np.uint64)
    sums = prefix_sums(values)
    _, q = _power_table(len(sums))
    return mix64((sums[m:] - sums[:-m]) * q[: len(values) - m + 1])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by prefix and suffix minima of blocks of w."""
    n = len(a)
    if n < w:
        return a[:0]
    if w == 1:
        return a
    padded = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its len+1 offsets, without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf, off


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows holding about `limit` bytes, one row at least."""
    buf, off = text_buffer(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


#: Bytes of a word once A-Z are lower-cased: digits, a-z and every byte of a non-ASCII character; others become 0.
ALNUM_WORDS = np.zeros(256, np.uint8)
ALNUM_WORDS[48:58] = np.arange(48, 58)
ALNUM_WORDS[97:123] = np.arange(97, 123)
ALNUM_WORDS[65:91] = np.arange(97, 123)
ALNUM_WORDS[128:] = np.arange(128, 256)
#: Everything but space and the bytes 9 to 13, unchanged.
SPACED_WORDS = np.arange(256, dtype=np.uint8)
SPACED_WORDS[[9, 10, 11, 12, 13, 32]] = 0
#: A byte 0 in a text is a character of a word, too; it takes the value of a byte that UTF-8 never uses.
SPACED_WORDS[0] = 255
#: The same with A-Z lower-cased.
SPACED_LOWER_WORDS = SPACED_WORDS.copy()
SPACED_LOWER_WORDS[65:91] = np.arange(97, 123)


def words_of(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice: mapped bytes, starts, ends, and the index of the first word of each row (len rows+1)."""
    mapped = table[buf]
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = mapped != 0
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside[:-1]
    cut = off[(off > 0) & (off < len(buf))]
    before[cut] = False  # a row's first byte never continues a word
    starts = np.flatnonzero(inside & ~before)
    after = np.ones(len(buf) + 1, bool)
    after[:-1] = ~inside[1:]
    after[cut - 1] = True
    ends = np.flatnonzero(inside & after) + 1
    return mapped, starts, ends, np.searchsorted(starts, off, "left")


def word_hashes(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(BYTE_VALUES[mapped]), starts, ends)


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the words at which k words of one row stand."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    lo, hi = first[:-1], np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.flatnonzero(np.cumsum(ok)[:n] > 0)


def list_array(values: np.ndarray, counts: np.ndarray, type_: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, type_))


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
