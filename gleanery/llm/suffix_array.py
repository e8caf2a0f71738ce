"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` is SA-IS: suffixes are classified as smaller or larger than their right neighbour, the substrings
between leftmost-smaller suffixes are sorted by inducing and named, the string of names is sorted recursively, and the
whole array is induced from that order in linear time. Over small alphabets (bytes) the scans run bucket by bucket on
numpy arrays: whatever a bucket induces into later buckets goes there at once, in order, and only runs of the bucket's own
character need another round. Strings of names have many small buckets; there the scans are plain loops, and the substrings
are sorted by their characters and types, a place at a time.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned bucket by bucket.
SMALL = 512


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a string of small numbers that ends with its unique smallest one."""
    return _vector(np.asarray(text, np.int64)) if len(text) > 1 else np.zeros(len(text), np.int64)


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one to its right; the last one is."""
    n = len(text)
    less = np.ones(n, bool)
    less[:-1] = text[:-1] < text[1:]
    same = np.zeros(n, bool)
    same[:-1] = text[:-1] == text[1:]
    decides = np.where(same, n, np.arange(n))
    return less[np.minimum.accumulate(decides[::-1])[::-1]]


class _Buckets:
    """For each character, positions in the order in which they came."""

    def __init__(self, size: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(size)]

    def put(self, at: np.ndarray, char: np.ndarray) -> None:
        order = np.argsort(char, kind="stable")
        at, char = at[order], char[order]
        edges = np.flatnonzero(char[1:] != char[:-1]) + 1
        for part, c in zip(np.split(at, edges), char[np.concatenate([[0], edges])]):
            self.parts[c].append(part)

    def take(self, c: int) -> np.ndarray:
        parts, self.parts[c] = self.parts[c], []
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.int64)


def _induced(text: np.ndarray, char: np.ndarray, smaller: np.ndarray, seeds: list[np.ndarray]) -> np.ndarray:
    """The order of all suffixes that leftmost-smaller ones, sorted by character in ``seeds``, induce."""
    size = len(seeds)
    large, out = _Buckets(size), [np.zeros(0, np.int64)] * (2 * size)
    for c in range(size):
        found = []
        now = large.take(c)
        while len(now):
            found.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            own = char[before] == c
            if len(rest := before[~own]):
                large.put(rest, char[rest])
            now = before[own]
        if found:
            out[2 * c] = np.concatenate(found)
        before = seeds[c][seeds[c] > 0] - 1
        if len(before):
            large.put(before, char[before])
    small = _Buckets(size)
    for c in range(size - 1, -1, -1):
        found = []
        now = small.take(c)
        while len(now):
            found.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            own = char[before] == c
            if len(rest := before[~own]):
                small.put(rest, char[rest])
            now = before[own]
        if c == 0 and not found:
            found = [seeds[0]]
        if found:
            out[2 * c + 1] = np.concatenate(found)[::-1]
        before = out[2 * c][::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        if len(before):
            small.put(before, char[before])
    return np.concatenate(out)


def _by_char(at: np.ndarray, char: np.ndarray, size: int) -> list[np.ndarray]:
    order = np.argsort(char[at], kind="stable")
    return np.split(at[order], np.searchsorted(char[at][order], np.arange(1, size)))


def _vector(text: np.ndarray) -> np.ndarray:
    n, size = len(text), int(text.max()) + 1
    char = text.astype(np.uint8 if size <= 256 else np.uint16)
    smaller = _types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _induced(text, char, smaller, _by_char(leftmost, char, size))
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = order[is_leftmost[order]]
    names, distinct = _names(char, leftmost, order)
    if distinct < len(leftmost):
        ranked = suffix_array(names) if distinct <= SMALL and len(names) > 4 * SMALL else _plain(names, distinct)
        order = leftmost[ranked]
    return _induced(text, char, smaller, _by_char(order, char, size))


def _names(char: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each leftmost-smaller substring, in text order: equal for equal ones, ascending in ``order``."""
    n = len(char)
    length = np.diff(np.append(leftmost, n - 1)) + 1
    of = np.searchsorted(leftmost, order)
    a, b, size = order[:-1], order[1:], length[of]
    same = size[:-1] == size[1:]
    active, k = np.flatnonzero(same), 0
    while len(active):
        left = np.minimum(size[:-1][active], k + 8) - k
        equal = np.ones(len(active), bool)
        for s in range(int(left.max())):
            step = np.minimum(k + s, size[:-1][active] - 1)
            equal &= char[a[active] + step] == char[b[active] + step]
        same[active[~equal]] = False
        k += 8
        active = active[equal & (size[:-1][active] > k)]
    number = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(order), np.int64)
    names[of] = number
    return names, int(number[-1]) + 1


def _plain(text: np.ndarray, size: int) -> np.ndarray:
    """SA-IS with scans in loops, for a string of names below ``size`` that ends with its unique smallest one."""
    n = len(text)
    if size == n:
        out = np.empty(n, np.int64)
        out[text] = np.arange(n)
        return out
    types = _types(text)
    leftmost = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=size)).tolist()
    heads, s = [0, *ends[:-1]], text.tolist()
    # For each suffix, the character that it induces a larger (a smaller) suffix with, or -1; the last one is for no suffix.
    left, kind = np.concatenate([[-1], text[:-1], [-1]]), np.concatenate([[False], types[:-1], [False]])
    larger, smaller = np.where(kind, -1, left).tolist(), np.where(kind, left, -1).tolist()

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        tail = ends[:]
        for i in reversed(seeds):
            c = s[i]
            tail[c] -= 1
            out[tail[c]] = i
        head = heads[:]
        for i in out:  # the list fills to the right of the place that is read
            c = larger[i]
            if c >= 0:
                h = head[c]
                out[h] = i - 1
                head[c] = h + 1
        tail = ends[:]
        for i in reversed(out):  # and here to the left of it, over the seeds
            c = smaller[i]
            if c >= 0:
                h = tail[c] - 1
                out[h] = i - 1
                tail[c] = h
        return out

    names, distinct = _ranked(2 * text + types, leftmost)
    order = leftmost[_plain(names, distinct) if distinct < len(leftmost) else np.argsort(names)]
    return np.array(induce(order.tolist()))


def _ranked(key: np.ndarray, leftmost: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of leftmost-smaller substrings like ``_names``, from their characters and types (``key``), one place a round.

    With types, a substring is never a proper beginning of another. A rank is the number of smaller substrings; only
    substrings that still share a rank, and have not ended, are compared at the next place.
    """
    n, top = len(key), int(key.max()) + 2
    length = np.diff(np.append(leftmost, n - 1)) + 1
    rank, active, k = np.zeros(len(leftmost), np.int64), np.arange(len(leftmost)), 0
    while len(active):
        here = np.where(k < length[active], key[np.minimum(leftmost[active] + k, n - 1)] + 1, 0)
        both = rank[active] * top + here
        order = np.argsort(both, kind="stable")
        active, both, here = active[order], both[order], here[order]
        old, at = rank[active], np.arange(len(active))
        opens = np.append(True, both[1:] != both[:-1])
        first = np.maximum.accumulate(np.where(opens, at, 0))
        base = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), at, 0))
        rank[active] = old + first - base
        alone = opens & np.append(opens[1:], True)
        active = active[~alone & (here > 0)]
        k += 1
    number, names = np.unique(rank, return_inverse=True)
    return names, len(number)


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each position, how long a prefix its suffix shares with the one before it in the array.

    Where the characters before both suffixes are equal, the prefix is that of the position before, less one; only the
    other, irreducible positions are compared, eight characters a round. Their lengths sum to n log n at most.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    at = np.arange(n)
    reducible = (at > 0) & (before > 0)
    reducible[reducible] = text[at[reducible] - 1] == text[before[reducible] - 1]
    first = np.flatnonzero(~reducible)
    shared = np.zeros(n, np.int64)
    active = first[before[first] >= 0]
    length = np.zeros(len(active), np.int64)
    rows = np.arange(len(active))
    while len(rows):
        i, j = active[rows] + length[rows], before[active[rows]] + length[rows]
        inside = (i < n) & (j < n)
        rows, i, j = rows[inside], i[inside], j[inside]
        differ = eight[i] ^ eight[j]
        same = differ == 0
        low = differ[~same] & (~differ[~same] + np.uint64(1))
        length[rows[~same]] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        length[rows[same]] += 8
        rows = rows[same]
    shared[active] = length
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(shared[source] - (at - source), 0)
