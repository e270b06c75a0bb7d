"""Suffix sorting by induction, with common-prefix lengths, in numpy.

The suffixes of each kind are induced from those of the other by queues, one for each first character: a monotone
priority queue, filled in order and emptied in order. Entries are (position, common prefix with the entry before);
queues beyond SPILL bytes go to a file and are read back whole. Sample suffixes are sorted by prefix doubling of their
names in memory, and their common prefixes are computed from the text. So text, order and prefixes stay in memory: this
is no external recursive induction, and callers bound the text (repeats: about 2.3 MB).
"""

from __future__ import annotations

import tempfile

import numpy as np

# Bytes that the queues of one direction hold in memory.
SPILL = 256 << 20


class Queues:
    """For each character a queue of (positions, prefixes), kept in order; past SPILL bytes the largest goes to a file."""

    def __init__(self) -> None:
        self.parts: dict[int, list] = {}
        self.held: dict[int, int] = {}
        self.files: dict[int, list] = {}
        self.total = 0

    def put(self, char: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.parts.setdefault(char, []).append((positions, prefixes))
        size = positions.nbytes + prefixes.nbytes
        self.held[char] = self.held.get(char, 0) + size
        self.total += size
        if self.total > SPILL:
            self._spill(max(self.held, key=lambda c: self.held[c]))

    def _spill(self, char: int) -> None:
        p, x = self._joined(self.parts.pop(char))
        f = tempfile.TemporaryFile()
        p.tofile(f)
        x.tofile(f)
        self.files.setdefault(char, []).append((f, len(p), p.dtype))
        self.total -= self.held.pop(char)

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])

    def take(self, char: int) -> tuple[np.ndarray, np.ndarray]:
        back = []
        for f, n, kind in self.files.pop(char, []):
            f.seek(0)
            back.append((np.fromfile(f, kind, n), np.fromfile(f, np.uint8, n)))
            f.close()
        parts = back + self.parts.pop(char, [])
        self.total -= self.held.pop(char, 0)
        return self._joined(parts) if parts else (np.zeros(0, np.int32), np.zeros(0, np.uint8))


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi], ends included, for many ranges."""
    levels = [values]
    longest = int((hi - lo).max()) + 1 if len(lo) else 0
    step = 1
    while step * 2 <= longest:
        prev = levels[-1]
        levels.append(np.minimum(prev[:-step], prev[step:]))
        step *= 2
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k, table in enumerate(levels):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
    return out


def _hand_on(text: np.ndarray, source: np.ndarray, prefix: np.ndarray, wanted: np.ndarray, last: dict[int, int], queues: Queues, depth: int, base: int) -> None:
    """Queues the predecessors of the marked sources by their character. A prefix is one more than the least between two
    sources of one character; ``last`` has each character's last source in this bucket's sequence, of which ``prefix`` is all so far."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return
    pred = source[at] - 1
    chars = text[pred]
    order = np.argsort(chars, kind="stable")
    chars, pred, at = chars[order], pred[order], at[order] + base
    cuts = np.append(0, np.flatnonzero(chars[1:] != chars[:-1]) + 1)
    before = np.empty(len(at), np.int64)
    before[1:] = at[:-1]
    for c in cuts:
        before[c] = last.get(int(chars[c]), -1)
    known = before >= 0
    value = np.ones(len(at), np.uint8)
    if known.any():
        low = _range_min(prefix, before[known] + 1, at[known])
        value[known] = np.minimum(low.astype(np.int32) + 1, depth)
    for a, b in zip(cuts, np.append(cuts[1:], len(at))):
        char = int(chars[a])
        last[char] = int(at[b - 1])
        queues.put(char, pred[a:b].astype(np.int32), value[a:b])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of suffix pairs, at most ``depth``. ``text`` goes on for ``depth`` characters."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for at in range(0, depth, 8):
        n = min(8, depth - at)
        same = text[a[live][:, None] + np.arange(at, at + n)] == text[b[live][:, None] + np.arange(at, at + n)]
        run = np.where(same.all(axis=1), n, same.argmin(axis=1))
        out[live] += run.astype(np.uint8)
        live = live[run == n]
        if not len(live):
            break
    return out


def _induce(text: np.ndarray, n: int, small: np.ndarray, sample: np.ndarray, prefix: np.ndarray, depth: int, carry: bool) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, from the ordered sample suffixes; with ``carry`` their common prefixes too."""
    heads = text[sample]
    first = np.searchsorted(heads, np.arange(257)) if len(sample) else np.zeros(257, np.int64)
    up, large = Queues(), {}
    # the last suffix is larger than nothing: it starts its bucket's queue
    up.put(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
    for c in range(256):
        sequence, values, last, base = [], [], {}, 0
        positions, lcp = up.take(c)
        ordered = sample[first[c] : first[c + 1]]
        while len(positions):  # generation by generation: a run of one character induces itself
            sequence.append(positions)
            values.append(lcp)
            whole = np.concatenate(values) if carry else lcp
            if not base:
                whole[0] = 0
                values[0] = whole.copy() if carry else lcp
            pred = positions - 1
            ok = (positions > 0) & ~small[np.maximum(pred, 0)]
            _hand_on(text, positions, whole if carry else np.zeros(base + len(positions), np.uint8), ok, last, up, depth, base)
            base += len(positions)
            positions, lcp = up.take(c)
        if base:
            large[c] = (np.concatenate(sequence), np.concatenate(values))
        if len(ordered):
            p = prefix[first[c] : first[c + 1]].copy()
            if carry:
                p[0] = _common(text, large[c][0][-1:], ordered[:1], depth)[0] if base else 0
            whole = np.concatenate([large[c][1], p]) if base else p
            _hand_on(text, ordered, whole, (ordered > 0), last, up, depth, base)
    down, out, out_lcp = Queues(), [None] * 256, [None] * 256
    for c in range(255, -1, -1):
        sequence, values, last, base = [], [], {}, 0
        positions, lcp = down.take(c)
        while len(positions):
            sequence.append(positions)
            values.append(lcp)
            whole = np.concatenate(values) if carry else lcp
            if not base:
                whole[0] = 0
                values[0] = whole.copy() if carry else lcp
            ok = (positions > 0) & small[np.maximum(positions - 1, 0)]
            _hand_on(text, positions, whole if carry else np.zeros(base + len(positions), np.uint8), ok, last, down, depth, base)
            base += len(positions)
            positions, lcp = down.take(c)
        s_pos = np.concatenate(sequence) if base else np.zeros(0, np.int32)
        s_lcp = np.concatenate(values) if base else np.zeros(0, np.uint8)
        l_pos, l_lcp = large.pop(c, (np.zeros(0, np.int32), np.zeros(0, np.uint8)))
        border = np.zeros(1, np.uint8)
        if len(l_pos) and base and carry:
            border = _common(text, l_pos[-1:], s_pos[-1:], depth)
        if len(l_pos):
            # downwards, an entry's prefix is with the one above it: the large part's values move up by one
            falling = np.concatenate([border if base else np.zeros(1, np.uint8), l_lcp[1:][::-1]])
            whole = np.concatenate([s_lcp, falling]) if base else falling
            turned = l_pos[::-1]
            _hand_on(text, turned, whole, (turned > 0) & small[np.maximum(turned - 1, 0)], last, down, depth, base)
        out[c] = np.concatenate([l_pos, s_pos[::-1]])
        # upwards again: the small part's values are with the entry below
        rising = np.concatenate([border, s_lcp[1:][::-1]]) if base else np.zeros(0, np.uint8)
        out_lcp[c] = np.concatenate([l_lcp, rising])
        if len(out_lcp[c]):
            out_lcp[c][0] = 0
    return np.concatenate(out), np.concatenate(out_lcp)


def _ranks(names: np.ndarray, steps: int) -> np.ndarray:
    """Order of the suffixes of a string of names to a depth of ``steps`` names: names of pairs, recursively."""
    rank, reach = names.astype(np.int64), 1
    while reach < steps:
        ahead = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, len(rank)), np.int64)])[: len(rank)]
        pair = rank * (int(rank.max()) + 3) + ahead
        order = np.argsort(pair, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        rank = np.empty_like(rank)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == len(rank) - 1:
            break
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray, depth: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (bytes) ordered by their first ``depth`` characters at least, and common prefixes with the one before, at most ``depth``."""
    n = len(text)
    if depth > 250:
        raise ValueError("prefixes are kept in a byte")
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    # small: smaller than the suffix after it; a run of one character has the kind of its end
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rises = np.zeros(len(ends), bool)
    rises[:-1] = text[ends[:-1] + 1] > text[ends[:-1]]
    small = np.repeat(rises, np.diff(np.append(-1, ends)))
    sample = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if not len(sample):
        none = np.zeros(0, np.int32)
        return _induce(padded, n, small, none, np.zeros(0, np.uint8), depth, True)
    # pieces between sample positions, sorted by a first induction, get names; equal pieces the same one
    by_head = sample[np.argsort(text[sample], kind="stable")]
    order, _ = _induce(padded, n, small, by_head, np.zeros(len(by_head), np.uint8), depth, False)
    is_sample = np.zeros(n, bool)
    is_sample[sample] = True
    ordered = order[is_sample[order]]
    stops = np.append(sample[1:] + 1, n)
    length_at = np.zeros(n, np.int32)
    length_at[sample] = stops - sample
    with np.errstate(over="ignore"):
        weight = np.multiply.accumulate(np.full(n + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * weight[:n], dtype=np.uint64)])
        size = length_at[ordered]
        # equal pieces have equal sums once they are shifted to one place
        piece = (sums[ordered + size] - sums[ordered]) * weight[n - ordered]
        new = (piece[1:] != piece[:-1]) | (size[1:] != size[:-1])
    name_at = np.zeros(n, np.int64)
    name_at[ordered] = np.concatenate([[0], np.cumsum(new)])
    ranked = sample[_ranks(name_at[sample], depth // 2 + 2)]
    prefix = np.zeros(len(ranked), np.uint8)
    prefix[1:] = _common(padded, ranked[:-1], ranked[1:], depth)
    return _induce(padded, n, small, ranked, prefix, depth, True)
