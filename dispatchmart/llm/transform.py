"""Exact sums of products over sliding windows by number-theoretic transforms, many rows at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Primes below 2^30 with p - 1 divisible by a high power of two, and a generator of each.
PRIMES = ((469_762_049, 3), (167_772_161, 3), (754_974_721, 11))
MAX_LENGTH = 1 << 24


@lru_cache(maxsize=64)
def _roots(length: int, prime: int, generator: int, inverse: bool) -> np.ndarray:
    """The powers of a root of unity of order ``length``, half of them."""
    root = pow(generator, (prime - 1) // length, prime)
    if inverse:
        root = pow(root, -1, prime)
    powers = np.ones(max(length // 2, 1), np.uint64)
    have = 1
    while have < len(powers):
        more = min(have, len(powers) - have)
        powers[have : have + more] = powers[:more] * np.uint64(pow(root, have, prime)) % np.uint64(prime)
        have += more
    return powers


def transform(rows: np.ndarray, prime: int, generator: int, inverse: bool = False) -> np.ndarray:
    """The transform of each row modulo ``prime``; the length is a power of two, the order natural.

    Each step joins the transforms of the even and the odd places into one of twice the size (autosort form).
    """
    count, length = rows.shape
    modulus = np.uint64(prime)
    roots = _roots(length, prime, generator, inverse)
    now = rows.reshape(count, length, 1)  # row, place, frequency
    while now.shape[1] > 1:
        half, size = now.shape[1] // 2, now.shape[2]
        even, odd = now[:, :half], now[:, half:] * roots[::half][:size] % modulus
        now = np.concatenate([even + odd, even + (modulus - odd)], axis=2) % modulus
    out = now.reshape(count, length)
    return out * np.uint64(pow(length, -1, prime)) % modulus if inverse else out


def zero_differences(blocks: np.ndarray, windows: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lags at which a row's block equals the window from that lag on.

    Whole numbers from 0 to ``largest``. The sum of the squared differences of block and window is made from two sums
    of squares and one convolution, modulo so many primes that their product exceeds any such sum; it is zero
    exactly where it is zero modulo each.
    """
    width, length = blocks.shape[1], 1 << (windows.shape[1] - 1).bit_length()
    lags = windows.shape[1] - width + 1
    primes, reach = [], 1
    for prime, generator in PRIMES:
        if reach <= width * largest * largest:
            primes.append((prime, generator))
            reach *= prime
    if reach <= width * largest * largest or length > MAX_LENGTH:
        raise ValueError("the blocks are too long for exact sums")
    padded_blocks = np.zeros((len(blocks), length), np.uint64)
    padded_blocks[:, :width] = blocks[:, ::-1]
    padded_windows = np.zeros((len(blocks), length), np.uint64)
    padded_windows[:, : windows.shape[1]] = windows
    zero = None
    for prime, generator in primes:
        modulus = np.uint64(prime)
        products = transform(padded_blocks % modulus, prime, generator)
        products = products * transform(padded_windows % modulus, prime, generator) % modulus
        products = transform(products, prime, generator, inverse=True)[:, width - 1 : width - 1 + lags]
        squares = padded_windows[:, : windows.shape[1]] % modulus
        squares = np.cumsum(squares * squares % modulus, axis=1)  # below 2^54
        upto = np.concatenate([np.zeros((len(blocks), 1), np.uint64), squares], axis=1)
        own = padded_blocks % modulus
        sums = (own * own % modulus).sum(axis=1, dtype=np.uint64)[:, None] + upto[:, width:] - upto[:, :lags]
        equal = sums % modulus == 2 * products % modulus
        zero = equal if zero is None else zero & equal
    return np.nonzero(zero)
