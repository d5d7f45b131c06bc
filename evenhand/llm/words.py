"""Words and 64-bit sequence hashes of many texts at once, as numpy arrays inside a task.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are handled as UTF-8 bytes: no byte of a longer character is below 128,
so the byte-wise split equals the character-wise one. Hashes are polynomials modulo 2^64 over bytes, mixed per
word, then polynomials over words, mixed again; two families with different bases give more bits where needed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the two hash families, for bytes and for words.
BASES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first powers of each base; a worker keeps so many for a base and no more.
KEPT = 1 << 16
_powers: dict[int, np.ndarray] = {}
#: The C library's own release of free memory, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which every input bit reaches every output bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(KEPT - 1), and base^0, base^KEPT, base^(2 KEPT) ... up to the n-th power."""
    if base not in _powers:
        low = np.full(KEPT, base, dtype=U64)
        low[0] = 1
        _powers[base] = np.cumprod(low, dtype=U64)
    high = np.full(n // KEPT + 1, pow(base, KEPT, 1 << 64), dtype=U64)
    high[0] = 1
    return _powers[base], np.cumprod(high, dtype=U64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    low, high = _tables(base, n)
    return np.multiply.outer(high, low[: n + 1]).ravel()[: n + 1]


def powers_at(base: int, which: np.ndarray) -> np.ndarray:
    """base to each of some exponents, modulo 2^64."""
    low, high = _tables(base, int(which.max(initial=0)))
    return low[which & (KEPT - 1)] * high[which // KEPT]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed polynomial hash of ``values[start:end]`` for each pair; equal spans hash alike wherever they stand."""
    if not len(start):
        return np.zeros(0, dtype=U64)
    n = len(values)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * powers(base, n)[:n], dtype=U64, out=sums[1:])
    return mix((sums[end] - sums[start]) * powers_at(pow(base, -1, 1 << 64), start))


@dataclass
class Words:
    """All words of some texts: byte ranges in ``buf``, and for text i the words ``first[i]:first[i + 1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, family: int = 0) -> np.ndarray:
        return span_hash(self.buf.astype(U64) + U64(1), self.start, self.end, BASES[family][0])

    def windows(self, k: int) -> np.ndarray:
        """Word indices at which ``k`` words of one text begin."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, dtype=np.int64)
        doc = self.doc
        return np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])

    def window_hashes(self, at: np.ndarray, k: int, family: int = 0) -> np.ndarray:
        return span_hash(self.hashes(family), at, at + k, BASES[family][1])


def split_words(texts: list[bytes | None], lower: bool = False) -> Words:
    """Words of each text, in order; a null text has none."""
    texts = [b"" if t is None else t for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)]) + 1
    return Words(buf, start, end, np.searchsorted(start, bounds))


def give_back() -> None:
    """Return memory that the allocators keep from the last group: workers outlive their tasks, and stages add up."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(f: Callable) -> Callable:
    """A function of one group that gives memory back when its own tables are gone."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return run


def tidy_both(f: Callable) -> Callable:
    """The same for two groups."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = f(a, b)
        give_back()
        return out

    return run


def tidy_map(f: Callable) -> Callable:
    """The same for a stream of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(batches):
            yield out
        give_back()

    return run
