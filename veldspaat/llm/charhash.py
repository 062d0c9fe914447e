"""Rabin-Karp hashes of character windows, vectorised over many texts at once.

Texts are laid end to end as code points; prefix sums of ``char * base**position`` give the hash of every window by one
subtraction and one multiplication with the inverse power, in modular arithmetic on whole arrays.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The two largest primes below 2**31, so that products fit in 62 bits. Fixed values.
PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 998_244_353)
#: Base of the third hash, modulo 2**64: odd, hence invertible. A fixed value.
WORD_BASE = 0x9E3779B97F4A7C15
#: Code points hashed at once.
SLAB = 1 << 20


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    step = base % prime
    while len(out) < n:
        out = np.concatenate([out, out * step % prime])
        step = step * step % prime
    return out[:n]


@lru_cache(maxsize=8)
def _tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse up to n."""
    p = PRIMES[which]
    return _powers(BASES[which], n, p), _powers(pow(BASES[which], -1, p), n, p)


@lru_cache(maxsize=4)
def _word_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for step in (WORD_BASE, pow(WORD_BASE, -1, 1 << 64)):
        table = np.ones(n, np.uint64)
        table[1:] = np.uint64(step)
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def _room(n: int) -> int:
    return max(SLAB, 1 << (n - 1).bit_length())


def code_points(text: str) -> np.ndarray:
    """Code points of a text; lone surrogates are kept as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(points: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits, so that equal sums don't follow from similar letters."""
    x = points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prime_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """62-bit hash of every window of ``width`` code points: the hashes modulo both primes side by side."""
    n = len(points)
    if n < width:
        return np.empty(0, np.int64)
    parts = []
    for which, p in enumerate(PRIMES):
        power, inverse = (t[:n] for t in _tables(_room(n), which))
        sums = np.zeros(n + 1, np.int64)
        np.cumsum((points.astype(np.int64) + 1) * power % p, out=sums[1:])
        parts.append((sums[width:] - sums[:-width]) % p * inverse[: n - width + 1] % p)
    return (parts[0] << 31) | parts[1]


def word_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window, independent of the prime ones."""
    n = len(points)
    if n < width:
        return np.empty(0, np.int64)
    power, inverse = (t[:n] for t in _word_tables(_room(n)))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(points) * power, out=sums[1:])
    return ((sums[width:] - sums[:-width]) * inverse[: n - width + 1]).view(np.int64)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width`` values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out
