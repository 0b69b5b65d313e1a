"""Counter random numbers: a draw depends on (seed, walker, step) alone, so a retried task draws the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys) -> Column:
    """A number in [0, 1) for each key tuple; the same in any engine that has md5."""
    text = F.concat_ws(":", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def places(draw: Column, limits: Column) -> Column:
    """Number of ``limits`` (ascending array) at or below ``draw``: the chosen letter."""
    return F.size(F.filter(limits, lambda x: x <= draw))


def bits(seed: int, walker: np.ndarray | int, step: np.ndarray | int) -> np.ndarray:
    """64 mixed bits for each (seed, walker, step): two rounds of a splitmix finaliser."""
    with np.errstate(over="ignore"):
        x = np.asarray(walker, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1))
        for salt in (np.asarray(step, np.uint64) * np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)):
            x = x + salt
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return x


def uniform_array(seed: int, walker, step) -> np.ndarray:
    """Doubles in [0, 1) for numpy loops."""
    return (bits(seed, walker, step) >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: Rotations of Threefry with two 64-bit words and twenty rounds, and the constant of its key schedule (fixed values of the published generator).
ROTATIONS = (16, 42, 12, 31, 16, 32, 24, 21)
PARITY = 0x1BD11BDAA9FC1A22


def threefry(key: tuple, counter: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 bits for each key and counter, of two words each: twenty rounds of additions, rotations and exclusive or."""
    with np.errstate(over="ignore"):
        k = [np.asarray(x, np.uint64) for x in key]
        k.append(np.uint64(PARITY) ^ k[0] ^ k[1])
        x, y = (np.asarray(c, np.uint64) + k[n] for n, c in enumerate(counter))
        for n in range(20):
            r = np.uint64(ROTATIONS[n % 8])
            x = x + y
            y = ((y << r) | (y >> (np.uint64(64) - r))) ^ x
            if n % 4 == 3:
                m = n // 4 + 1
                x, y = x + k[m % 3], y + k[(m + 1) % 3] + np.uint64(m)
    return x, y


def even(n: int, seed: int, walker: np.ndarray, step: np.ndarray | int, lane: int = 0, bits_: int = 64) -> np.ndarray:
    """Numbers below ``n``, all alike for each (seed, walker, step, lane): draws beyond the last whole multiple of ``n`` are drawn again under the next counter."""
    walker = np.atleast_1d(np.asarray(walker, np.uint64))
    step = np.broadcast_to(np.asarray(step, np.uint64), walker.shape)
    limit = (1 << bits_) // n * n
    if limit < 1:
        raise ValueError(f"{bits_} bits don't tell {n} numbers")
    out, left, attempt = np.zeros(len(walker), np.int64), np.arange(len(walker)), 0
    while len(left):
        draw = threefry((seed & (2**64 - 1), walker[left]), (step[left], lane + (attempt << 8)))[0] >> np.uint64(64 - bits_)
        fits = np.ones(len(left), bool) if limit == 1 << 64 else draw < np.uint64(limit)
        out[left[fits]] = (draw[fits] % np.uint64(n)).astype(np.int64)
        left, attempt = left[~fits], attempt + 1
    return out
