"""Vectorised text work on Arrow buffers, used inside tasks.

All functions take the UTF-8 bytes of a batch of texts laid end to end and the
offsets of the texts. Hashes are polynomial prefix sums modulo 2**64 over random
64-bit values of the bytes, so the hash of any stretch costs two subtractions; the
result is mixed so that its high bits are fit for partitioning. Such sums can cancel in
stretches of 1,024 elements or more that are made for it, so they serve short stretches
(windows of words or bytes) and features; words are told apart by ``Words.digests``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: What separates words: space, tab, line feed, vertical tab, form feed, return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True

_RNG = np.random.default_rng(20240607)
BYTE_VALUES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[ord("A") : ord("Z") + 1] += 32
BASE = int(_RNG.integers(2**60, 2**64, dtype=np.uint64)) | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; as many as 2**22 are kept for the life of the worker."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        known = np.empty(size, np.uint64)
        known[0] = 1
        known[1:] = base
        np.cumprod(known, out=known)
        if size <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class Prefix:
    """Prefix sums of a sequence of 64-bit values, for hashes of its stretches."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.undo = powers(pow(BASE, -1, 1 << 64), n + 1)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.undo[starts]
        return h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))

    def sliding(self, length: int) -> np.ndarray:
        """Hashes of all stretches of ``length``, in order of their start."""
        n = len(self.sums) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.undo[:n])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Words:
    """Where the words of a batch of texts start and end, and which belong to a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~IS_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens = inside & edge[:-1]
        closes = inside & edge[1:]
        if len(data):
            opens[1:] |= inside[1:] & ~inside[:-1]
            closes[:-1] |= inside[:-1] & ~inside[1:]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        #: Words of text i are firsts[i] .. firsts[i + 1].
        self.firsts = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.firsts)

    def values(self, data: np.ndarray, table: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """A 64-bit value per word, for tables and features; very long words can be made to share one."""
        return Prefix(table[data]).hashes(self.starts, self.ends)

    def digests(self, data: np.ndarray, lower: bool = False, which: np.ndarray | None = None) -> np.ndarray:
        """Two 64-bit values per word (or per word of ``which``) from a 128-bit hash of the whole word, A-Z in lower case on request.

        Distinct words are hashed once per batch. Unlike sums over bytes, whose differences cancel in
        words that are built for it, they tell words of any length apart.
        """
        if which is None:
            sizes, letters = self.ends - self.starts, data[~IS_SEPARATOR[data]]
        else:
            sizes = self.ends[which] - self.starts[which]
            letters = data[ranges(self.starts[which], sizes)]
        letters = LOWER_BYTES[letters] if lower else letters
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        hashed = b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist()))
        return np.frombuffer(hashed, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]


def window_starts(firsts: np.ndarray, length: int) -> np.ndarray:
    """True at each element from which ``length`` elements lie in one text."""
    counts = np.diff(firsts)
    left = np.repeat(firsts[1:], counts) - np.arange(firsts[0], firsts[-1])
    return left >= length


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """True at each of ``size`` elements that a stretch from one of the distinct ``starts`` covers."""
    change = np.zeros(size + 1, np.int32)
    change[starts] += 1
    change[starts + length] -= 1
    return np.cumsum(change[:-1]) > 0


def sliding_minimum(values: np.ndarray, length: int) -> np.ndarray:
    """The least of each ``length`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= length:
        values = np.minimum(values[:-reach], values[reach:]) if len(values) > reach else values[:0]
        reach *= 2
    step = length - reach
    if step:
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
    return values


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending (sorts; faster here than hashing them)."""
    values = np.sort(values)
    if len(values):
        opens = np.ones(len(values), bool)
        opens[1:] = values[1:] != values[:-1]
        values = values[opens]
    return values
