"""Vectorised kernels on Arrow string columns: word and line boundaries, rolling hashes, grouped gathers.

A text is its UTF-8 bytes. Words are runs of bytes other than 0x20 and 0x09-0x0D; a null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C13)
_P_INV = U64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))


class Words(NamedTuple):
    start: np.ndarray  #: byte where each word starts
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: index of each row's first word, and the number of words


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and each row's offset in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose texts hold about size bytes, each with its bytes and offsets; a row is never cut."""
    for batch in batches:
        buf, offs = utf8(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def split_words(buf: np.ndarray, offs: np.ndarray) -> Words:
    space = SPACE[buf]
    head = ~space
    tail = head.copy()
    solid = head.copy()
    head[1:] &= space[:-1]
    tail[:-1] &= space[1:]
    rows = offs[:-1][offs[:-1] < len(buf)]
    head[rows] = solid[rows]
    ends = offs[1:][offs[1:] > 0] - 1
    tail[ends] = solid[ends]
    start = np.flatnonzero(head)
    return Words(start, np.flatnonzero(tail) + 1, np.searchsorted(start, offs))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (xor-shifts and odd multipliers)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


class Rolling:
    """Hashes of byte ranges: a polynomial over random byte values, summed once, cut anywhere."""

    def __init__(self, seed: int, fold_case: bool = False):
        values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self.values = values[LOWER] if fold_case else values
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, len(self.up) + len(self.up) // 4)
            self.up, self.down = np.full(n, _P), np.full(n, _P_INV)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def sums(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.values[buf] * self.up[: len(buf)], out=total[1:])
        return total

    def ranges(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self.sums(buf)
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


class Prints:
    """Hashes of byte ranges that stand for them: two polynomials modulo primes, so that no two ranges collide whatever the base, as some
    do modulo a power of two. Two given ranges of n bytes share a hash with a chance of about (n / 2**31)**2."""

    PRIMES = (2147483647, 2147483629)

    def __init__(self, seed: int, fold_case: bool = False) -> None:
        rng = np.random.default_rng(seed)
        self.bases = [int(rng.integers(1 << 20, p - 1)) for p in self.PRIMES]
        values = [rng.integers(1, p, 256).astype(U64) for p in self.PRIMES]
        self.values = [v[LOWER] if fold_case else v for v in values]
        self.up = self.down = [np.ones(1, U64)] * 2

    def _grow(self, n: int) -> None:
        if n > len(self.up[0]):
            n = max(n, len(self.up[0]) + len(self.up[0]) // 4)
            self.up = [_powers(b, n, p) for b, p in zip(self.bases, self.PRIMES, strict=True)]
            self.down = [_powers(pow(b, -1, p), n, p) for b, p in zip(self.bases, self.PRIMES, strict=True)]

    def ranges(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        halves = []
        for k, p in enumerate(map(U64, self.PRIMES)):
            # terms are below 2**31, so the sum of 2**32 of them fits
            total = np.zeros(len(buf) + 1, U64)
            np.cumsum(self.values[k][buf] * self.up[k][: len(buf)] % p, out=total[1:])
            halves.append((total[end] - total[start]) % p * self.down[k][start] % p)
        return mix(mix((halves[0] << U64(32)) | halves[1]) + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out, have = np.ones(n, U64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, prime)) % U64(prime)
        have += more
    return out


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values of h, in order; len(h) - n + 1 values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out += h[k : k + m] * (U64((0x9FB21C651E98DF25 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF) | U64(1))
        out ^= out >> U64(37)
        out *= U64(0xBF58476D1CE4E5B9)
    return mix(out)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] values, then those of the next start: indices that gather ranges."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    at = np.cumsum(length)[:-1]
    out[0] = start[0]
    out[at] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(out)


def crc_remainder(ids: list, modulus: int) -> np.ndarray:
    """crc32 of each id as text, modulo; a null id counts as the text 'null'."""
    import zlib

    return np.array([zlib.crc32(str("null" if i is None else i).encode()) % modulus for i in ids], np.int64)
