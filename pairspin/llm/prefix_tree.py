"""Prefix-tree (trie) join of sets: all links between sets, or just enough of them to connect what is linked.

Sets are sequences in one global order.  Sets that begin alike share a path, and so does the
count of what a probe shares with it.  A subtree is left where that count and all that can follow fall short of
the overlap which its smallest set needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


class Forest:
    """Disjoint sets of numbers 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class _Node:
    __slots__ = ("edge", "kids", "sets", "least", "most", "one", "depth")

    def __init__(self, edge: np.ndarray, depth: int):
        self.edge, self.depth = edge, depth  # depth: elements up to the edge's end
        self.kids: dict[int, _Node] = {}
        self.sets: list[int] = []
        self.least, self.most, self.one = 1 << 60, 0, -1  # sizes below; a set below if all below are connected, else -2


def needed(x: int, y: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes x and y whose Jaccard similarity is num/den or more."""
    return -(-num * (x + y) // (num + den))


class PrefixTree:
    """Trie of integer sequences, each ascending, with compressed paths."""

    def __init__(self, num: int, den: int, width: int, forest: Forest):
        self.num, self.den, self.forest = num, den, forest
        self.root = _Node(np.zeros(0, np.int64), 0)
        self.mark = np.zeros(width, bool)
        self.count = 0

    def insert(self, k: int, s: np.ndarray) -> None:
        node, n, at = self.root, len(s), 0
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.one == -1:
                node.one = k
            elif node.one >= 0 and self.forest.find(node.one) != self.forest.find(k):
                node.one = -2
            if at == n:
                node.sets.append(k)
                break
            kid = node.kids.get(int(s[at]))
            if kid is None:
                kid = node.kids[int(s[at])] = _Node(s[at:], n)
                kid.least = kid.most = n
                kid.one = k
                kid.sets.append(k)
                break
            m = min(len(kid.edge), n - at)
            differ = np.flatnonzero(kid.edge[:m] != s[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(kid.edge):  # split the path
                upper = _Node(kid.edge[:same], at + same)
                upper.least, upper.most, upper.one = kid.least, kid.most, kid.one
                kid.edge = kid.edge[same:]
                upper.kids[int(kid.edge[0])] = kid
                node.kids[int(s[at])] = upper
                kid = upper
            node, at = kid, at + same
        self.count += 1
        if self.count & (self.count - 1) == 0:
            self._refresh()

    def _refresh(self) -> None:
        """See anew which subtrees are connected, as later links may have joined them."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.kids.values()
        for node in reversed(order):
            found = {self.forest.find(k) for k in node.sets}
            for kid in node.kids.values():
                found.add(self.forest.find(kid.one) if kid.one >= 0 else -2)
            node.one = next(iter(found)) if len(found) == 1 else -2

    def links(self, k: int, s: np.ndarray, connect: bool) -> Iterator[int]:
        """Sets linked with ``s``, which is set k; with ``connect`` none that is connected with k already."""
        n, num, den, mark, find = len(s), self.num, self.den, self.mark, self.forest.find
        mark[s] = True
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if node.least * den < num * n and node.most * den < num * n or n * den < num * node.least:
                continue
            if connect and node.one >= 0 and find(node.one) == find(k):
                continue
            if len(node.edge):
                shared += int(np.count_nonzero(mark[node.edge]))
                left = min(n - int(np.searchsorted(s, node.edge[-1], "right")), node.most - node.depth)
                if shared + left < needed(n, max(node.least, -(-num * n // den)), num, den):
                    continue
            for other in node.sets:
                if node.depth and shared >= needed(n, node.depth, num, den) and not (connect and find(other) == find(k)):
                    self.forest.join(other, k)
                    yield other
            stack += [(kid, shared) for kid in node.kids.values()]
        mark[s] = False


def join_sets(sets: list[np.ndarray], num: int, den: int, connect: bool = True, linked: list[int] | None = None, order: Callable[[np.ndarray], np.ndarray] = np.argsort) -> Iterator[tuple[int, int]]:
    """Links (x, y), y before x, of non-empty sets with Jaccard similarity num/den or more.

    ``connect``: leave out links between sets that earlier links connect; the components stay
    the same.  ``linked``: a number for each set; equal ones count as connected beforehand (implies ``connect``).
    ``order`` sorts distinct elements by the global order, the same for all calls: frequent ones first lets like sets share long paths.
    """
    if not sets:
        return
    flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.empty(len(flat), np.int64)
    place[order(flat)] = np.arange(len(flat))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(x) for x in np.split(place[inverse.ravel()], cuts)]
    forest = Forest(len(sets))
    if linked is not None:
        seen: dict[int, int] = {}
        for k, c in enumerate(linked):
            forest.join(seen.setdefault(c, k), k)
    tree = PrefixTree(num, den, len(flat), forest)
    for k in np.argsort([len(s) for s in sets], kind="stable").tolist():
        for other in tree.links(k, ordered[k], connect):
            yield k, other
        tree.insert(k, ordered[k])
