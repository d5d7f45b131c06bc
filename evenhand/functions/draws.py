"""Hypergeometric draws from populations of any size."""

from __future__ import annotations

import math

import numpy as np

#: numpy draws up to here.
NUMPY_LIMIT = 10**9


def _stirling_rest(n: float) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        step = term / (2 * k + 1)
        if total + step == total:
            return total
        total, k = total + step, k + 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log probability of x in n by saddle points: relative errors stay small however large n is."""
    if x == 0:
        return n * math.log1p(-p) if p < 0.5 else n * math.log(q)
    if x == n:
        return n * math.log1p(-q) if q < 0.5 else n * math.log(p)
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return rest + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` taken from ``good + bad`` are good."""
    whole = good + bad
    if whole < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    p, q = n / whole, (whole - n) / whole

    def weight(x: int) -> float:
        return _log_binomial(x, good, p, q) + _log_binomial(n - x, bad, p, q)

    # ratio of uniforms around the mode, with the hat of Stadlober
    share = good / whole
    mean = n * share
    spread = math.sqrt((whole - n) / (whole - 1) * mean * (1 - share) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = weight(min(high, max(low, (n + 1) * (good + 1) // (whole + 2))))
    while True:
        u, v = rng.random(), rng.random()
        if u == 0.0:
            continue
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= weight(x) - top:
            return x


def multivariate_hypergeometric(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` items taken from kinds with these counts, one kind after the other."""
    out, rest = np.zeros(len(counts), dtype=np.int64), int(sum(int(c) for c in counts))
    for i, c in enumerate(counts):
        rest -= int(c)
        out[i] = hypergeometric(rng, int(c), rest, n) if n else 0
        n -= int(out[i])
    return out


# --- keyed draws of many rows at once ---------------------------------------------------------------

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_words(prefix: bytes, tails: np.ndarray) -> np.ndarray:
    """MD5 of ``prefix`` and each row of ``tails`` (bytes, ``[n, length]``) as four little-endian words, ``[4, n]``.

    All rows have one length, so a step of the digest is a handful of operations on whole columns.
    """
    n, start, size = len(tails), len(prefix), len(prefix) + tails.shape[1]
    blocks = (size + 8) // 64 + 1
    plain = prefix + bytes(size - start) + b"\x80" + bytes(blocks * 64 - size - 9) + (size * 8).to_bytes(8, "little")
    fixed = np.frombuffer(plain, dtype="<u4").tolist()  # words without a byte of a tail are the same for all rows
    low, high = start // 4, -(-size // 4)
    text = np.empty((n, (high - low) * 4), dtype=np.uint8)
    text[:] = np.frombuffer(plain[low * 4 : high * 4], dtype=np.uint8)
    text[:, start - low * 4 : size - low * 4] = tails
    rows = np.ascontiguousarray(text.view("<u4").T) if high > low else text
    state = [np.full(n, x, dtype=np.uint32) for x in _START]
    f, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for block in range(blocks):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            turn, at = divmod(i, 16)
            if turn == 0:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif turn == 1:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
                at = (5 * i + 1) % 16
            elif turn == 2:
                np.bitwise_xor(b, c, out=f)
                f ^= d
                at = (3 * i + 5) % 16
            else:
                np.bitwise_not(d, out=f)
                f |= b
                f ^= c
                at = (7 * i) % 16
            f += a
            at += block * 16
            if low <= at < high:
                f += _SINES[i]
                f += rows[at - low]
            else:
                f += np.uint32((int(_SINES[i]) + fixed[at]) & 0xFFFFFFFF)
            left = _SHIFTS[turn][i % 4]
            np.left_shift(f, np.uint32(left), out=t)
            f >>= np.uint32(32 - left)
            f |= t
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        state = [x + y for x, y in zip(state, (a, b, c, d))]
    return np.stack(state)


def draws60(words: np.ndarray) -> np.ndarray:
    """The first fifteen hex digits of each digest as numbers: what ``draw60`` is in an expression."""
    first, second = words[0].byteswap().astype(np.uint64), words[1].byteswap().astype(np.uint64)
    return (first << np.uint64(28)) | (second >> np.uint64(4))


def draw_end(index: int, size: int) -> int:
    """``uniform_index`` maps a draw below ``index`` if and only if the draw is below this number."""
    return min(-((-max(index, 0) << 60) // size), 1 << 60)


def decimal_tails(start: int, stop: int) -> list[tuple[int, np.ndarray]]:
    """The numbers from ``start`` to before ``stop`` in decimal digits, in runs of one length: first number, ``[n, length]``."""
    out = []
    while start < stop:
        width = len(str(start))
        end = min(stop, 10**width)
        numbers = np.arange(start, end)
        out.append((start, np.stack([numbers // 10**k % 10 + 48 for k in reversed(range(width))], axis=1).astype(np.uint8)))
        start = end
    return out


def text_tails(texts: list[str | None], at_once: int = 1 << 14) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts in runs of one length in bytes: places, ``[n, length]``. A null has no bytes."""
    raw = [b"" if x is None else x.encode() for x in texts]
    sizes = np.array([-1 if x is None else len(r) for x, r in zip(texts, raw)])
    out = []
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        for i in range(0, len(places), at_once):
            some = places[i : i + at_once]
            out.append((some, np.frombuffer(b"".join([raw[k] for k in some]), dtype=np.uint8).reshape(len(some), max(size, 0))))
    return out
