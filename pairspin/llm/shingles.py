"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, after A-Z
are lower-cased.  A text's set holds its distinct runs of ``k`` words; a text of fewer words has
its whole sequence as the one element; a text without words has an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import numpy as np

BLOCK = 700_000
#: Bytes of a word that are hashed by array operations, eight at a time; longer words go to BLAKE2b one by one.
CHUNKED = 32


@lru_cache(maxsize=1)
def _gaps() -> np.ndarray:
    apart = np.zeros(256, bool)
    apart[[32, 9, 10, 11, 12, 13]] = True
    return apart


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(lower: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash (uint64) of each byte range: every eight bytes are mixed in by a bijection, so no family of words clashes by construction."""
    padded = np.frombuffer(lower + bytes(8), np.uint8)
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = end - begin
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    kept = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    at = np.flatnonzero(size <= CHUNKED)
    step = 0
    while len(at := at[size[at] > step]):
        h[at] = _mixed(h[at] ^ (eight[begin[at] + step] & kept[np.minimum(size[at] - step, 8)])) * np.uint64(0xD6E8FEB86659FD93)
        step += 8
    for k in np.flatnonzero(size > CHUNKED).tolist():
        h[k] = int.from_bytes(blake2b(lower[begin[k] : end[k]], digest_size=8).digest(), "little")
    return h


def _block(texts: Sequence[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes (int64) of each text."""
    lower = (b"\n".join(texts) + b"\n").lower()  # bytes.lower() changes A-Z only
    inside = np.concatenate([[False], ~_gaps()[np.frombuffer(lower, np.uint8)], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    words = word_hashes(lower, begin, end)
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    bound = np.concatenate([[0], np.searchsorted(begin, last)])
    runs = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        runs = runs * np.uint64(0xD1342543DE82EF95) + words[i : i + len(runs)]
    runs = _mixed(runs).view(np.int64)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            h = np.uint64(0x5851F42D4C957F2D)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(0xD1342543DE82EF95) + w
            out.append(_mixed(np.array([h])).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[np.ndarray]:
    """The set of each text, in order; null counts as empty."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        run.append((text or "").encode())
        size += len(run[-1])
        if size >= BLOCK:
            yield from _block(run, k)
            run, size = [], 0
    if run:
        yield from _block(run, k)
