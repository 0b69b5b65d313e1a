"""Alphabets and the numbering of positions, letters and pairs."""

from __future__ import annotations

from math import isqrt

# fixed values: preset alphabets
PRESETS = {
    "protein": "ACDEFGHIKLMNPQRSTVWY",
    "protgap": "-ACDEFGHIKLMNPQRSTVWY",
    "charge": "0+-",
    "nuc": "ACGT",
}


def letters(name: str) -> str:
    """A preset's letters, or the string itself."""
    return PRESETS.get(name, name)


def n_pairs(length: int) -> int:
    return length * (length - 1) // 2


def length_of(pairs: int) -> int:
    """Positions of a table with that many pairs."""
    length = (1 + isqrt(1 + 8 * pairs)) // 2
    if n_pairs(length) != pairs:
        raise ValueError(f"{pairs} is no number of pairs")
    return length


def pair_number(i: int, j: int, length: int) -> int:
    """Row of pair i < j in lexicographic order."""
    return i * length - i * (i + 1) // 2 + (j - i - 1)
