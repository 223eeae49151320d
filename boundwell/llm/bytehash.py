"""Prefix polynomial hashes over the bytes of a batch of texts, in numpy.

A byte b at place i adds T[b] * BASE**i (mod 2**64), where T is a fixed table of random words; the hash of any slice is the
difference of two prefix sums, moved to place 0 with the inverse power, because BASE is odd.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # 5 mod 8: the highest multiplicative order of an odd base
#: Bytes of text that one batch holds, unless a single text is longer.
BATCH = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A finishing permutation of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept up to a batch's length."""
    if base in _POWERS and len(_POWERS[base][0]) >= n:
        return _POWERS[base]
    size = max(n, BATCH + (1 << 16))
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, U(b), U)
        p[0] = U(1)
        out.append(np.cumprod(p, dtype=U))
    if size <= 2 * BATCH:
        _POWERS[base] = (out[0], out[1])
    return out[0], out[1]


class PrefixHash:
    """Hashes of slices of buf (uint8)."""

    def __init__(self, buf: np.ndarray, seed: int = 1, base: int = BASE) -> None:
        up, self.down = powers(len(buf) + 1, base)
        terms = table(seed)[buf]
        terms *= up[: len(buf)]
        self.sums = np.zeros(len(buf) + 1, U)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of buf[start:end], elementwise; slices of different lengths may still be told apart by mix."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def mixed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.of(start, end) + (end - start).astype(U))


def slices(column: pa.Array, limit: int = BATCH) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a string column as UTF-8, null as empty, a few at a time: about limit bytes or one text; with the place of the first."""
    column = column.cast(pa.large_string())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    data = memoryview(data) if data is not None else memoryview(b"")
    texts: list[bytes] = []
    first = size = 0
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if size and size + b - a > limit:
            yield first, texts
            texts, first, size = [], i, 0
        texts.append(bytes(data[a:b]) if valid[i] else b"")
        size += b - a + 1
    if texts:
        yield first, texts
    pa.default_memory_pool().release_unused()


def packed(texts: Sequence[bytes], limit: int = BATCH) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts as (index of the first, buffer, starts, ends); a newline stands after each text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield _join(texts, first, i)
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield _join(texts, first, len(texts))


def _join(texts: Sequence[bytes], first: int, last: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    some = texts[first:last]
    ends = np.cumsum([len(t) + 1 for t in some]) - 1
    starts = ends - np.array([len(t) for t in some])
    return first, np.frombuffer(b"\n".join(some) + b"\n", np.uint8), starts, ends


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
