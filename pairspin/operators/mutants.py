"""Sums over the double mutants of a pair, by ranks of differences.

A double mutant's energy is J_ab - J_gb - J_ad + J_gd = d_b - d_d with d = J_a. - J_g.: for two letters a and g it is a difference of two entries of one list.
Sums over all d of a function that is made of lines in that difference (its size, its sign, a SCAD slope) follow from how many entries are on either
side of each bend, and from their running sums, so the lists are sorted and no row or number is made for a single mutant: q^3 log q a pair, not q^4.

Plan: one grouping brings a pair's q^2 couplings to one row; the work is done in batches of pairs, and what comes back is as long as what came.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .pairs import per_pair


def _sides(lists: np.ndarray, shift: float, below: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each entry x of lists (n, q): number and sum of the entries up to x + shift; ``below``: strictly below it."""
    n, q = lists.shape
    both = np.concatenate([lists, lists + shift] if not below else [lists + shift, lists], 1)
    order = np.argsort(both, 1, kind="stable")
    value = order < q if not below else order >= q  # which of the sorted ones are entries
    count = np.cumsum(value, 1)
    total = np.cumsum(np.where(value, np.take_along_axis(both, order, 1), 0.0), 1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(2 * q), order.shape), 1)
    bends = place[:, q:] if not below else place[:, :q]
    return np.take_along_axis(count, bends, 1), np.take_along_axis(total, bends, 1)


def sizes_and_signs(j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over (g, d) of the size and of the sign of J_ab - J_gb - J_ad + J_gd, for each (a, b) of couplings (pairs, q, q)."""
    q = j.shape[1]
    lists = (j[:, :, None, :] - j[:, None, :, :]).reshape(-1, q)
    order = np.argsort(lists, 1)
    s = np.take_along_axis(lists, order, 1)
    before = np.cumsum(s, 1)
    k = np.arange(q)
    size = s * (2 * k + 1 - q) - 2 * before + s + before[:, -1:]
    # equal entries make no sign: those before the first of them, less those behind the last
    new = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], 1)
    first = np.maximum.accumulate(np.where(new, k, 0), 1)
    end = np.concatenate([new[:, 1:], np.ones((len(s), 1), bool)], 1)
    last = np.minimum.accumulate(np.where(end, k, q)[:, ::-1], 1)[:, ::-1]
    out = []
    for v in (size, (first + last + 1 - q).astype(float)):
        back = np.empty_like(v)
        np.put_along_axis(back, order, v, 1)
        out.append(back.reshape(-1, q, q, q).sum(2))
    return out[0], out[1]


def slopes(j: np.ndarray, r: float, a: float) -> np.ndarray:
    """Sums over (g, d) of sign(x) s(x), x = J_ab - J_gb - J_ad + J_gd, for each (a, b): s is 1 below r in size, falls to 0 at a r, and is 0 beyond."""
    q = j.shape[1]
    lists = (j[:, :, None, :] - j[:, None, :, :]).reshape(-1, q)
    fall = 1 / (a * r - r)
    # entries d by x = b - d: far below (x >= ar), falling, near below, equal, near above, falling, far above
    edges = [_sides(lists, *e) for e in ((-a * r, False), (-r, False), (0.0, True), (0.0, False), (r, True), (a * r, True))]
    (n0, t0), (n1, t1), (n2, _), (n3, _), (n4, t4), (n5, t5) = edges
    inner = (n2 - n1) - (n4 - n3)
    left = (a * r - lists) * (n1 - n0) + (t1 - t0)  # ar - (x) over the falling side below
    right = (a * r + lists) * (n5 - n4) - (t5 - t4)
    return (inner + fall * (left - right)).reshape(-1, q, q, q).sum(2)


def mutant_sums(couplings: DataFrame, q: int) -> DataFrame:
    """(i, j, a, b, size, sign) over all g, d other than a, b; q letters on either side, every bin there."""
    return per_pair(couplings, ["cpl"], ["size", "sign"], sizes_and_signs, 8 * q)


def mutant_slopes(couplings: DataFrame, q: int, r: float, a: float) -> DataFrame:
    """(i, j, a, b, slope): sums of the SCAD slopes of all double mutants of each bin."""
    return per_pair(couplings, ["cpl"], ["slope"], lambda j: [slopes(j, r, a)], 30 * q)
