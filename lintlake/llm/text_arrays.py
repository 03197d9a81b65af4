"""Words of many texts at once as numpy arrays over one buffer of UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
BASE, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

_bytes = np.arange(256)
#: Word bytes: all but white space, and all but ASCII signs (letters, digits, bytes of longer characters).
NOT_SPACE = ~((_bytes == 0x20) | ((_bytes >= 9) & (_bytes <= 0x0D)))
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes | 0x20) >= 0x61) & ((_bytes | 0x20) <= 0x7A) & (_bytes < 0x80) | (_bytes >= 0x80)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit sum."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _table(base: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) | np.uint64(1)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(pair)
        if size > 4 * CHUNK_BYTES:  # of a very long text: not to be held for good
            del _powers[base]
    return have


class Sums:
    """Polynomial hashes of any slices of a sequence in constant time each."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        power, self.inverse = powers(base, n + 1)
        terms = _table(base)[values] if values.dtype == np.uint8 else values
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(terms * power[:n], out=self.total[1:])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.total[hi] - self.total[lo]) * self.inverse[lo])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the words of a long buffer, some of it at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = Sums(data[lo:hi], base).hash(starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return out


def ngrams(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Hashes of all ``n`` consecutive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return Sums(h, base).hash(at, at + n)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    if len(a) < width:
        return a[:0]
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[:-rest], a[rest:]) if rest else a


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0]+1, ...`` for ``lengths[0]`` values, then the next ones."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def split(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one more than there are texts).

    ``inside`` tells for every byte value whether it belongs to words; a word never crosses texts.
    """
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    lo, hi = offsets[:-1][full], offsets[1:][full] - 1
    first[lo], last[hi] = word[lo], word[hi]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, without a copy; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Free memory that allocators keep: the worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        _, at = texts_of(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def values(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of numbers; a null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
