"""Signature trees: nodes hold the OR of token bitmaps and a size range; a dual traversal finds similar pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FANOUT = 8
CHUNK = 4096


def width(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set: a power of two with at least two bits for each member."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(1, sizes) / 32)).astype(np.int64))


def bitmap(hashes: np.ndarray) -> bytes:
    """The bitmap of a set of 64-bit hashes."""
    words = int(width(np.array([len(hashes)]))[0])
    bits = np.zeros(words * 64, np.uint8)
    bits[(hashes & np.uint64(words * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps made narrower; a bit of the result is set if any of the bits it stands for is."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


class Tree:
    """Levels of nodes over items in the given order; level 0 is the items themselves."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, items: np.ndarray):
        self.items = items
        self.levels = [(bits, sizes, sizes, sizes - ones(bits))]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def labels(self, level: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = labels[self.items]
        if not level:
            return own, own
        at = np.arange(0, len(own), FANOUT**level)
        return np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)


def _children(nodes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Child numbers of each node, and which node of the list they belong to."""
    child = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    owner = np.repeat(np.arange(len(nodes)), FANOUT)
    return child[child < count], owner[child < count]


class Links:
    """Pairs that are linked, found by dual traversals; pairs of items already connected are not looked at.

    ``percent``: pairs link when 100 * overlap >= percent * union. ``accept(i, j)`` decides a pair that the
    bitmaps leave open; without it such a pair counts as linked.
    """

    def __init__(self, count: int, percent: int, accept: Callable[[int, int], bool] | None = None, labels: np.ndarray | None = None):
        self.labels = np.arange(count) if labels is None else labels.copy()
        self.parent = self.labels.tolist()
        self.percent, self.accept = percent, accept
        self.edges: list[tuple[int, int]] = []
        self.changes = self.seen = self.work = 0

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def _refresh(self) -> None:
        """Bring ``labels`` up to date; while they are not, connected items may be looked at, and none is left out."""
        if self.seen == self.changes:
            return
        labels = np.array(self.parent, np.int64)
        while (labels != (further := labels[labels])).any():
            labels = further
        self.labels, self.parent = labels, labels.tolist()
        self.seen, self.work = self.changes, 0

    def traverse(self, left: Tree, right: Tree) -> None:
        """Compare all items of both trees (of one, if it is the same), pruning by the largest possible overlap."""
        same, p = left is right, self.percent
        top = max(len(left.levels), len(right.levels)) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        known: dict[int, tuple] = {}
        while stack:
            level, i, j = stack.pop()
            if len(i) > CHUNK:
                cuts = range(0, len(i), CHUNK)
                stack += [(level, i[k : k + CHUNK], j[k : k + CHUNK]) for k in reversed(cuts)]
                continue
            # Labels are written anew once as many pairs as there are items have been looked at.
            self.work += len(i)
            if self.work >= len(self.labels):
                self._refresh()
            a_level, b_level = min(level, len(left.levels) - 1), min(level, len(right.levels) - 1)
            if known.get(level, (-1,))[0] != self.seen:
                known[level] = (self.seen, left.labels(a_level, self.labels), right.labels(b_level, self.labels))
            _, (a_min, a_max), (b_min, b_max) = known[level]
            keep = ~((a_min[i] == a_max[i]) & (b_min[j] == b_max[j]) & (a_min[i] == b_min[j]))
            if same and level:
                keep |= (i == j) & (a_min[i] != a_max[i])
            i, j = i[keep], j[keep]
            a_bits, a_low, a_high, a_slack = left.levels[a_level]
            b_bits, b_low, b_high, b_slack = right.levels[b_level]
            keep = (100 * a_high[i] >= p * b_low[j]) & (100 * b_high[j] >= p * a_low[i])
            i, j = i[keep], j[keep]
            bound = np.minimum(np.minimum(a_high[i], b_high[j]), ones(a_bits[i] & b_bits[j]) + np.minimum(a_slack[i], b_slack[j]))
            keep = (100 + p) * bound >= p * (a_low[i] + b_low[j])
            i, j = i[keep], j[keep]
            if not level:
                self._settle(left.items[i], right.items[j])
                continue
            if not len(i):
                continue
            a_child, b_child = (_children(x, len(t.levels[level - 1][0])) if len(t.levels) > level else (x, np.arange(len(x))) for x, t in ((i, left), (j, right)))
            # All pairs of children of one pair of nodes: the children of j are listed for each child of i.
            counts = np.bincount(b_child[1], minlength=len(i))
            begins = np.cumsum(counts) - counts
            own = counts[a_child[1]]
            offset = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            ci = np.repeat(a_child[0], own)
            cj = b_child[0][np.repeat(begins[a_child[1]], own) + offset]
            if same:
                once = ci < cj if level == 1 else ci <= cj
                ci, cj = ci[once], cj[once]
                near = np.argsort(cj - ci, kind="stable")
                ci, cj = ci[near], cj[near]
            stack.append((level - 1, ci, cj))
        self._refresh()

    def _settle(self, left: np.ndarray, right: np.ndarray) -> None:
        for x, y in zip(left.tolist(), right.tolist()):
            a, b = self._root(x), self._root(y)
            if a != b and (self.accept is None or self.accept(x, y)):
                self.parent[max(a, b)] = min(a, b)
                self.edges.append((x, y))
                self.changes += 1


def linked(bitmaps: list[bytes], sizes: np.ndarray, percent: int, accept=None, parts: np.ndarray | None = None, labels: np.ndarray | None = None) -> Links:
    """Link sets by their bitmaps. Sets of one bitmap width share a tree; widths are compared where their sizes are close enough.

    With ``parts`` (0 or 1 for each set) only pairs of different parts are compared.
    """
    links = Links(len(sizes), percent, accept, labels)
    words = np.array([len(b) // 8 for b in bitmaps])
    kinds = np.unique(words)
    sides = [None] if parts is None else [0, 1]

    def tree(word: int, side, narrow: int) -> Tree | None:
        own = np.flatnonzero((words == word) & (True if side is None else parts == side))
        if not len(own):
            return None
        bits = np.frombuffer(b"".join(bitmaps[k] for k in own), np.uint64).reshape(len(own), word)
        order = np.lexsort((sizes[own], bits[:, -1], bits[:, 0]))
        return Tree(folded(bits[order], narrow), sizes[own][order], own[order])

    for word in kinds.tolist():
        trees = [tree(word, side, word) for side in sides]
        if trees[0] and trees[-1]:
            links.traverse(trees[0], trees[-1])
        most = int(sizes[words == word].max())
        for other in kinds[kinds > word].tolist():
            # The larger set of a similar pair has at most 100 / percent times the size of the smaller one.
            if percent * int(sizes[words == other].min()) > 100 * most:
                continue
            wide = [tree(other, side, word) for side in sides]
            for a, b in [(trees[0], wide[0])] if parts is None else [(trees[0], wide[1]), (trees[1], wide[0])]:
                if a and b:
                    links.traverse(a, b)
    return links
