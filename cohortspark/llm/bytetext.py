"""Vectorised word, line and shingle hashing over UTF-8 Arrow buffers.

All separators of the word pattern ``[^\\x20\\x09-\\x0D]+`` are single bytes, so
words are found on the raw bytes and no text is decoded.  Hashes are 64-bit
polynomials over the bytes modulo 2**64, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) | U64(1)

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_TABLE_LOWER = _TABLE[_LOWER]

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i <= n."""
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n, BLOCK) + 1
        up = np.full(size, U64(_BASE), U64)
        down = np.full(size, U64(pow(_BASE, -1, 2**64)), U64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def avalanche(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; the input array is overwritten."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them, null flags) of an Arrow string column, in pieces of about ``limit`` bytes.

    A null row has no bytes.  A row longer than ``limit`` is a piece of its own.
    """
    for arr in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if pa.types.is_null(arr.type):
            arr = arr.cast(pa.string())
        n = len(arr)
        if not n:
            continue
        wide = pa.types.is_large_string(arr.type)
        null = arr.is_null().to_numpy(zero_copy_only=False)
        if arr.null_count:
            arr = arr.fill_null("")
        _, off, data = arr.buffers()
        off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            hi = min(hi, n)
            yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], null[lo:hi]
            lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which never cross a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (one more entry at the end)."""
    starts, ends = spans(~_IS_SEP[buf], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are sorted and don't overlap."""
    out = np.empty(len(starts), U64)
    table = _TABLE_LOWER if lower else _TABLE
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        s, e = starts[i:j] - base, ends[i:j] - base
        n = int(e[-1])
        up, down = _power_tables(n)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum(table[buf[base : base + n]] * up[:n], out=total[1:])
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(U64) * _MIX[63]
        i = j
    return avalanche(out)


def window_hashes(words: np.ndarray, first_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` words within a row, and the index of its first word."""
    counts = np.maximum(np.diff(first_word) - (size - 1), 0)
    at = ragged(first_word[:-1], counts)
    h = np.zeros(len(at), U64)
    for k in range(size):
        h += words[at + k] * _MIX[k]
    return avalanche(h), at


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def prefix_count(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each position, with one more entry at the end."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def combine(h: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair."""
    return avalanche(h * _MIX[40] + tag.astype(U64) * _MIX[41])
