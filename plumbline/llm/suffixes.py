"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many short strings.

All strings grow from their last symbol to their first, one symbol of every string each round. The collection
is the sorted list of all suffixes inserted so far. A suffix ``cS`` is placed among those that begin with ``c``
by the place of ``S`` in the collection: it is the number of symbols ``c`` before that place in the transform.
The transform is kept as the places of each symbol in turn, which is also the order of the suffixes, and its
common prefixes beside it. Both lie in files of a folder; a round reads the old ones from front to back and
writes new ones. Memory holds a few numbers for each string, and for each suffix only how far it moves.

A symbol is eight bytes. A string takes part eight times, without 0 to 7 of its last bytes, so that a suffix
starts at every byte.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

SYMBOL = 8
PART = 1 << 18
#: The part of an entry that says where the rest of the suffix stands.
REST = np.uint64(0xFFFFFFFF)
BLOCK = 16


class RangeMinimum:
    """Least value of ranges of a file of small numbers: blocks are read once, their minima kept in levels."""

    def __init__(self, values: np.ndarray):
        self.values = values
        level = np.empty(-(-len(values) // BLOCK), np.uint8)
        for begin in range(0, len(level), PART // BLOCK):
            part = values[begin * BLOCK : begin * BLOCK + PART]
            level[begin : begin + PART // BLOCK] = np.minimum.reduceat(part, np.arange(0, len(part), BLOCK))
        self.levels = [level]
        step = 1
        while 2 * step <= len(level):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of ``values[first..last]``, both ends included."""
        out = np.empty(len(first), np.uint8)
        for k in range(0, len(first), 1 << 16):
            out[k : k + (1 << 16)] = self._some(first[k : k + (1 << 16)], last[k : k + (1 << 16)])
        return out

    def _some(self, first, last):
        offsets = np.arange(BLOCK)
        a, b = first // BLOCK, last // BLOCK
        found = self.values[np.minimum(first[:, None] + offsets, np.minimum(last, a * BLOCK + BLOCK - 1)[:, None])].min(1)
        found = np.minimum(found, self.values[np.maximum(last[:, None] - offsets, np.maximum(first, b * BLOCK)[:, None])].min(1))
        between = np.flatnonzero(b - a > 1)
        if len(between):
            low, high = a[between] + 1, b[between]
            level = np.floor(np.log2(high - low)).astype(np.int64)
            for k in np.unique(level):
                own = between[level == k]
                found[own] = np.minimum(found[own], np.minimum(self.levels[k][a[own] + 1], self.levels[k][b[own] - (1 << k)]))
        return found


class Collection:
    """The suffixes inserted so far: ``order`` (symbol and place of the rest) and ``common`` in files of ``folder``."""

    def __init__(self, strings: int, most: int, suffixes: int, folder: str):
        self.strings, self.most, self.round = strings, most, 0
        self.order = np.zeros(0, np.uint64)
        self.common = np.zeros(strings, np.uint8)
        file = lambda name, kind, size: np.memmap(os.path.join(folder, name), dtype=kind, mode="w+", shape=(size,))
        self.files = [(file(f"order-{k}", np.uint64, suffixes), file(f"common-{k}", np.uint8, strings + suffixes)) for k in range(2)]

    def insert(self, symbols: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put one symbol before each suffix at ``places``; returns the new places, and by how much each old one has moved."""
        self.round += 1
        n, old = self.strings, self.order
        keys = symbols.astype(np.uint64) << np.uint64(32) | places.astype(np.uint64)
        rank = np.argsort(keys)
        keys = keys[rank]
        before = np.searchsorted(old, keys)
        at = before + np.arange(len(keys))
        minimum = RangeMinimum(self.common)
        # Neighbours in the new order, with the places of their rests in the old collection.
        previous_new = np.r_[False, at[1:] == at[:-1] + 1]
        left = np.where(previous_new, np.r_[keys[:1], keys[:-1]], old[np.maximum(before - 1, 0)] if len(old) else keys)
        own = self._shared(minimum, left, keys, previous_new | (before > 0))
        has_right = ~np.r_[previous_new[1:], False] & (before < len(old))
        right = old[np.minimum(before, max(len(old) - 1, 0))] if len(old) else keys
        following = self._shared(minimum, keys, right, has_right)
        size = len(old) + len(keys)
        order, common = (f[:most] for f, most in zip(self.files[self.round % 2], (size, n + size)))
        shift = np.zeros(n + len(old), np.uint32)
        np.cumsum(np.bincount(before, minlength=len(old) + 1)[: len(old)], out=shift[n:])
        common[:n] = 0
        # One pass over the old files: entries move behind what is inserted before them, rests follow their suffixes.
        for begin in range(0, len(old), PART):
            part = old[begin : begin + PART]
            moved = np.arange(begin, begin + len(part)) + shift[n + begin : n + begin + len(part)]
            order[moved] = part + shift[part & REST]
            common[n + moved] = self.common[n + begin : n + begin + len(part)]
        order[at] = keys + shift[keys & REST]
        common[n + at] = own
        common[n + at[has_right] + 1] = following[has_right]
        self.order, self.common = order, common
        new = np.empty(len(keys), np.int64)
        new[rank] = n + at
        return new, shift

    def _shared(self, minimum: RangeMinimum, low: np.ndarray, high: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Common prefix of neighbours: none if their first symbols differ, else one more than their rests'."""
        out = np.zeros(len(low), np.uint8)
        same = np.flatnonzero(known & (low >> np.uint64(32) == high >> np.uint64(32)))
        first = (low[same] & REST).astype(np.int64) + 1
        last = (high[same] & REST).astype(np.int64)
        out[same] = np.minimum(minimum.least(first, last), self.most - 1) + 1
        return out


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string a mask of the byte places where a run of ``length`` bytes starts that also starts elsewhere in the strings."""
    if length % SYMBOL:
        raise ValueError(f"the length must be a multiple of {SYMBOL}")
    if not strings:
        return []
    most = length // SYMBOL
    sizes = np.array([len(s) for s in strings], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(strings) + b"\0" * SYMBOL, np.uint8).astype(np.uint64)
    words = np.zeros(len(data) - SYMBOL, np.uint64)
    for k in range(SYMBOL):
        words = words << np.uint64(8) | data[k : k + len(words)]
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64)
    del data, words
    # Each string once for each number of bytes left out at its end.
    text = np.repeat(np.arange(len(strings)), SYMBOL)
    end = sizes[text] - np.tile(np.arange(SYMBOL), len(strings))
    count = np.maximum(end, 0) // SYMBOL
    places = np.arange(len(text))
    repeated = np.zeros(int(sizes.sum()), bool)
    if not count.any():
        return np.split(repeated, begins[1:])
    with tempfile.TemporaryDirectory() as folder:
        collection = Collection(len(text), most, int(count.sum()), folder)
        for k in range(1, int(count.max()) + 1):
            active = np.flatnonzero(count >= k)
            new, shift = collection.insert(symbols[begins[text[active]] + end[active] - SYMBOL * k], places[active])
            places = places + shift[places]
            places[active] = new
        common = np.r_[np.array(collection.common), np.uint8(0)]
        # From each whole string the rests lead through all its suffixes.
        left = count.copy()
        while (own := np.flatnonzero(left)).size:
            at = places[own]
            repeated[begins[text[own]] + end[own] - SYMBOL * left[own]] = (common[at] >= most) | (common[at + 1] >= most)
            places[own] = (collection.order[at - collection.strings] & REST).astype(np.int64)
            left[own] -= 1
        del collection
    return np.split(repeated, begins[1:])
