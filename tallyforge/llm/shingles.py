"""Hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD
    h ^= h >> np.uint64(29)
    h *= _STEP
    return h ^ (h >> np.uint64(32))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, cut at white space), and where each text's words start in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= _SPACE[data[:-1]]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = inside[cuts]  # texts follow one another without a gap
    where = np.flatnonzero(inside)
    starts_at = np.flatnonzero(first)
    if not len(starts_at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.searchsorted(where, starts_at)
    lengths = np.diff(np.append(starts, len(where)))
    place = np.arange(len(where)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _STEP, np.uint64))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[_LOWER[data[where]]] * powers[place], starts)
        words = mix(sums + lengths.astype(np.uint64))
    return words, np.searchsorted(starts_at, offsets)


def sets(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words; of a shorter text its whole sequence; none without words."""
    words, at = word_hashes(offsets, data)
    with np.errstate(over="ignore"):
        runs = words[: max(0, len(words) - size + 1)].copy()
        for k in range(1, size):
            runs = mix(runs * _STEP + words[k : k + len(runs)])
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                h = words[a : a + 1].copy()
                for w in words[a + 1 : b]:
                    h = mix(h * _STEP + w)
                yield mix(h + np.uint64(b - a))
            else:
                yield words[:0]
