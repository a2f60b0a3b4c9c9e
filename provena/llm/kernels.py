"""Numpy kernels over the bytes of many texts at once: words, word hashes, windows of word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
#: Texts are handled in blocks of about so many bytes and at most so many rows; a longer text is a block of its own.
BLOCK, ROWS = 256 << 10, 500
#: Bytes whose running sums are held at once.
CHUNK = 512 << 10


def class_table(pattern_bytes: bytes) -> np.ndarray:
    """A 256-entry table, true at the given bytes."""
    t = np.zeros(256, bool)
    t[np.frombuffer(pattern_bytes, np.uint8)] = True
    return t


#: Words of any characters but space, tab, newline, vertical tab, form feed and carriage return.
SPACED = ~class_table(b" \t\n\v\f\r")
#: Words of ASCII letters and digits and every non-ASCII character, of lower-cased text.
ALNUM = class_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first CHUNK powers of R and of its inverse, modulo 2^64."""
    if not _tables:
        with np.errstate(over="ignore"):
            up = np.full(CHUNK, _R, np.uint64)
            up[0] = 1
            down = np.full(CHUNK, _R_INV, np.uint64)
            down[0] = 1
            _tables.append((np.cumprod(up), np.cumprod(down)))
    return _tables[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Ranges of rows of a text column of at most ROWS rows, whose UTF-8 has about BLOCK bytes together, and that UTF-8; null stays null."""
    column = column.cast(pa.binary())
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        end = min(start + ROWS, max(start + 1, int(np.searchsorted(sizes, before + BLOCK, side="right"))))
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end


def windows(size: int, h: np.ndarray) -> np.ndarray:
    """A hash for the window of ``size`` words that begins at each word; windows across texts are the caller's to drop."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.full(n, size, np.uint64)
        for k in range(size):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : n + k]
        return mix(g)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker, which stays for other stages, gives unused memory back to the system."""

    def through(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return through


class Words:
    """The words of a block of texts: ``starts`` and ``ends`` in ``buf``, ``hash`` and, by text, ``first`` (a word index for each text, and the end)."""

    def __init__(self, texts: list[bytes | None], table: np.ndarray, lower: bool = True):
        joined = b" ".join(t or b"" for t in texts) + b" "
        self.raw = np.frombuffer(joined, np.uint8)
        self.buf = np.frombuffer(joined.lower(), np.uint8) if lower else self.raw
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        inside = table[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hash = self.hash_of(self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each of the stretches from ``starts`` to ``ends`` (ascending, disjoint, not empty) of ``buf``.

        A stretch's hash is the sum of its bytes times powers of R, from running sums over CHUNK bytes at a time.
        """
        up, down = _powers()
        left, right = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        inverse, total = np.ones(len(starts), np.uint64), np.uint64(0)
        with np.errstate(over="ignore"):
            for base in range(0, len(self.buf), CHUNK):
                part = self.buf[base : base + CHUNK]
                sums = np.empty(len(part) + 1, np.uint64)
                sums[0] = 0
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
                scale, back = np.uint64(pow(_R, base, 1 << 64)), np.uint64(pow(_R_INV, base, 1 << 64))
                a, b = np.searchsorted(starts, (base, base + len(part)))
                left[a:b] = total + scale * sums[starts[a:b] - base]
                inverse[a:b] = back * down[starts[a:b] - base]
                a, b = np.searchsorted(ends, (base + 1, base + len(part) + 1))
                right[a:b] = total + scale * sums[ends[a:b] - base]
                total = total + scale * sums[-1]
            return mix((right - left) * inverse + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        return windows(size, self.hash)

    def sets(self, size: int) -> Iterator[np.ndarray]:
        """For each text its sorted distinct windows; of fewer words, the whole sequence as one; of none, nothing."""
        grams = self.windows(size)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                yield windows(b - a, self.hash[a:b])
            else:
                yield np.zeros(0, np.uint64)
