"""Suffix arrays by induced sorting, and permuted common prefixes, with whole buckets handled at once.

Works on one shard: an array of small non-negative numbers. Suffixes are classified as larger or smaller than the next,
substrings between leftmost-smaller places are sorted by inducing, named, and the names' suffixes sorted by recursion;
these induce the order of all suffixes. A bucket's suffixes are moved by one array operation, so that the work is linear
with few steps; where names are too many for buckets, names of doubled length take the place of the recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes of ``t`` in order; a suffix that ends comes before a longer one.

    With ``depth``, suffixes equal in their first ``2 * depth`` places or more may stand in any order."""
    t = t.astype(np.int64)
    n = len(t)
    if n < 2:
        return np.arange(n)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    buckets = _Buckets(t, smaller)
    if len(lms) > 1:
        order = buckets.induce(lms[np.argsort(t[lms], kind="stable")])
        marked = np.zeros(n, bool)
        marked[lms] = True
        order = order[marked[order]]
        names = _names(t, lms, order)
        if names.max() + 1 < len(lms):
            if (names.max() + 1) * 64 < len(names):
                ranked = suffix_array(names, depth)
            else:
                ranked = _doubled(names, depth)
            order = lms[ranked]
        lms = order
    return buckets.induce(lms)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is not."""
    n = len(t)
    step = np.append(np.sign(t[1:] - t[:-1]), -1)
    after = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(after[::-1])[::-1]
    return step[np.minimum(decided, n - 1)] > 0


class _Buckets:
    """Places of a suffix array by first symbol: larger suffixes from the front of a bucket, smaller ones from its back."""

    def __init__(self, t: np.ndarray, smaller: np.ndarray):
        self.t, self.smaller = t, smaller
        count = np.bincount(t)
        self.end = np.cumsum(count)
        self.start = self.end - count
        self.symbols = np.flatnonzero(count)

    def _put(self, sa: np.ndarray, at: np.ndarray, side: np.ndarray, forward: bool) -> None:
        if not len(at):
            return
        symbol = self.t[at]
        if len(at) > 1:
            order = np.argsort(symbol.astype(np.int32) if symbol[0] > 32767 else symbol, kind="stable")
            at, symbol = at[order], symbol[order]
            first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            size = np.diff(np.append(first, len(at)))
            rank = np.arange(len(at)) - np.repeat(first, size)
            kinds = symbol[first]
        else:
            rank, kinds, size = np.zeros(1, np.int64), symbol, np.ones(1, np.int64)
        if forward:
            sa[side[symbol] + rank] = at
            side[kinds] += size
        else:
            sa[side[symbol] - 1 - rank] = at
            side[kinds] -= size

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the leftmost-smaller ones in order."""
        t, smaller, n = self.t, self.smaller, len(self.t)
        sa = np.zeros(n, np.int64)
        head = self.start.copy()
        seeds = t[lms]
        low, high = np.searchsorted(seeds, self.symbols), np.searchsorted(seeds, self.symbols, side="right")
        self._put(sa, np.array([n - 1]), head, True)
        for c, a, b in zip(self.symbols, low, high, strict=True):
            done = self.start[c]
            while done < head[c]:
                before = sa[done:head[c]] - 1
                done = head[c]
                before = before[before >= 0]
                self._put(sa, before[~smaller[before]], head, True)
            before = lms[a:b] - 1
            self._put(sa, before[before >= 0], head, True)
        tail = self.end.copy()
        for c in self.symbols[::-1]:
            done = self.end[c]
            while tail[c] < done:
                before = sa[tail[c]:done][::-1] - 1
                done = tail[c]
                before = before[before >= 0]
                self._put(sa, before[smaller[before]], tail, False)
            before = sa[self.start[c]:head[c]][::-1] - 1
            before = before[before >= 0]
            self._put(sa, before[smaller[before]], tail, False)
        return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the substrings between leftmost-smaller places, in text order; equal ones have one number."""
    place = np.searchsorted(lms, order)
    length = np.append(np.diff(lms), len(t) - lms[-1] + 1)[place]
    same = np.flatnonzero(length[1:] == length[:-1])
    same = same[order[same] + length[same] < len(t)]
    same = same[order[same + 1] + length[same] < len(t)]
    equal = np.zeros(len(order), bool)
    live, k = same, 0
    while len(live):
        live = live[t[order[live] + k] == t[order[live + 1] + k]]
        ended = length[live] == k
        equal[live[ended] + 1] = True
        live = live[~ended]
        k += 1
    names = np.empty(len(order), np.int64)
    names[place] = np.cumsum(~equal) - 1
    return names


def _doubled(names: np.ndarray, depth: int | None) -> np.ndarray:
    rank, k, n = names, 1, len(names)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, k = fresh, 2 * k
        if rank[order[-1]] == n - 1 or k >= n or (depth and k >= depth):
            return order


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every place of ``t`` (bytes) the length of the prefix its suffix shares with the suffix before it in order.

    Only where the pair of suffixes is not the next one of the previous place's pair are bytes compared, eight at a time."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (before[:-1] == before[1:] - 1)
    at = np.flatnonzero(carried)
    carried[at] = t[at - 1] == t[before[at] - 1]
    start = np.flatnonzero(~carried & (before >= 0))
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    length = np.zeros(n, np.int64)
    live, k = start, 0
    while len(live):
        differ = eight[np.minimum(live + k, n)] ^ eight[np.minimum(before[live] + k, n)]
        room = n - np.maximum(live, before[live]) - k
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3)
        length[live] += np.minimum(same, room)
        live = live[(same == 8) & (room > 8)]
        k += 8
    index = np.arange(n)
    last = np.maximum.accumulate(np.where(carried, 0, index))
    return np.where(before >= 0, np.maximum(length[last] - (index - last), 0), 0)


def repeats(bodies: list[bytes], length: int, depth: int | None = None) -> list[np.ndarray]:
    """For every body whether the string of ``length`` bytes from each of its places also starts anywhere else in ``bodies``.

    Bodies may not hold the byte 0xFF, which UTF-8 never does."""
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
    symbols = text.astype(np.int64) + 1
    symbols[text == 255] = 0
    sa = suffix_array(symbols, depth)
    shared = permuted_prefixes(text, sa)
    found = shared >= length
    follows = found[sa[1:]]
    found[sa[:-1][follows]] = True
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(size + 1)
    # A string of the length may not reach over the end of its body.
    room = np.repeat(ends - 1, size + 1) - np.arange(len(text))
    found &= room >= length
    return [found[e - s - 1:e - 1] for e, s in zip(ends, size, strict=True)]
