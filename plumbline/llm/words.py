"""Words of many texts at once: NumPy finds their bounds and hashes in the joined UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_MIX = np.random.Generator(np.random.PCG64(20250101))
_BYTE = _MIX.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEPS = _MIX.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space, and of words made of letters, digits and all beyond ASCII.
VISIBLE = np.ones(256, bool)
VISIBLE[[32, *range(9, 14)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, text after text, and the number of words of each text; null has none."""
    coded = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    data = LOWER[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
    word = inside[data]
    edge = np.diff(word, prepend=False)
    begins = np.flatnonzero(edge & word)
    ends = np.flatnonzero(edge & ~word)
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    counts = np.diff(np.searchsorted(begins, text_ends), prepend=0)
    if not len(begins):
        return np.zeros(0, np.uint64), counts
    length = ends - begins
    starts = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(starts, length)
    powers = np.cumprod(np.full(int(length.max()), _BASE), dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE[data[word]] * powers[place], starts, dtype=np.uint64)), counts


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; the caller leaves out runs that cross texts."""
    size = max(0, len(hashes) - n + 1)
    total = np.full(size, np.uint64(n))
    for k in range(n):
        total = mixed(total * _STEPS[0]) + hashes[k : k + size]
    return mixed(total)


def byte_gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` bytes: differences of running sums of powers, brought to one power."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    up = np.r_[np.uint64(1), np.cumprod(np.full(len(data), _BASE), dtype=np.uint64)]
    down = np.r_[np.uint64(1), np.cumprod(np.full(len(data), _BASE_INVERSE), dtype=np.uint64)]
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)]
    return mixed((sums[n:] - sums[:-n]) * down[: len(data) - n + 1])
