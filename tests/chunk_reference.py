"""Structural and semantic segmentation of one text in plain Python: what the DataFrame operators are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from gleanery.operators.segmentation import BLANK_LINE, LINE_END, SENTENCE_MARKS


class Words:
    """The words of a text: where they start and end, and how strongly the text breaks before each."""

    def __init__(self, text: str):
        spans = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]
        self.text = text
        self.start, self.end = np.array(spans, np.int64).reshape(-1, 2).T
        gaps = [text[a:b] for a, b in zip([0, *self.end[:-1]], self.start)]
        lines = np.array([LINE_END in g for g in gaps], bool)
        blank = np.array([line and re.search(BLANK_LINE, g) is not None for g, line in zip(gaps, lines)], bool)
        marks = np.array([False, *(text[e - 1] in SENTENCE_MARKS for e in self.end[:-1])][: len(spans)], bool)
        #: For each kind of break, coarsest first, whether it (or a coarser one) stands before each word.
        self.breaks = [blank, blank | lines, blank | lines | marks]

    def __len__(self) -> int:
        return len(self.start)

    def within(self, a: int, b: int) -> tuple[int, int]:
        """The range of words that start in the characters [a, b)."""
        return int(np.searchsorted(self.start, a)), int(np.searchsorted(self.start, b))

    def pieces(self, lo: int, hi: int, size: int) -> np.ndarray:
        """The first words of the pieces of words [lo, hi).

        A word belongs to the coarsest stretch around it that has at most ``size`` words: the whole range, a paragraph, a
        line, a sentence; in a longer sentence pieces are runs of ``size`` words.
        """
        n = hi - lo
        if n <= size:
            return np.array([lo] if n else [], np.int64)
        settled, begins = np.zeros(n, bool), np.zeros(n, bool)
        for breaks in self.breaks:
            opens = breaks[lo:hi].copy()
            opens[0] = True
            of = np.cumsum(opens) - 1
            short = (np.bincount(of) <= size)[of]
            begins |= opens & short & ~settled
            settled |= short
        run = np.arange(n) - np.flatnonzero(opens)[of]
        begins |= ~settled & (run % size == 0)
        return np.flatnonzero(begins) + lo


    def opens_at(self, at: int, lo: int, hi: int, size: int) -> bool:
        """Whether the first piece of words [lo, hi) begins at the character ``at`` before it, with no break in between."""
        gap = self.text[at : self.start[lo]]
        if hi - lo <= size or not gap:
            return True
        between = [re.search(BLANK_LINE, gap) is not None, LINE_END in gap, at > 0 and self.text[at - 1] in SENTENCE_MARKS]
        for k, breaks in enumerate(self.breaks):
            if np.append(np.flatnonzero(breaks[lo + 1 : hi]) + 1, hi - lo)[0] <= size:
                return not any(between[: k + 1])
        return False


def chunks_of(first: np.ndarray, past: np.ndarray, size: int, tail: int, forced: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Word ranges of chunks: neighbouring pieces [first, past) together, up to ``size`` words.

    Piece j opens the next chunk when it does not fit, or where ``forced`` says so. Then the chunk also repeats the last
    pieces before j that have at most ``tail`` words and leave room for j; a forced one repeats none. Ends and beginnings
    are looked up in the running number of words.
    """
    total = np.concatenate([[0], np.cumsum(past - first)])
    stops = np.append(np.flatnonzero(forced) if forced is not None else [], len(first)).astype(int)
    out, begin, newest = [], 0, 0
    while begin < len(first):
        full = int(np.searchsorted(total, total[begin] + size, "right")) - 1  # the first piece that does not fit
        stop = int(stops[np.searchsorted(stops, newest, "right")])
        close = min(max(full, newest + 1), stop)
        out.append((int(first[begin]), int(past[close - 1])))
        if close == len(first):
            break
        if close == stop:
            begin = close
        else:
            kept = int(np.searchsorted(total, total[close] - tail))
            begin = min(close, max(kept, int(np.searchsorted(total, total[close + 1] - size))))
        newest = close
    return out


def _spans(words: Words, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Characters from the first to the last word of each range, repeated ones once."""
    return list(dict.fromkeys((int(words.start[a]), int(words.end[b - 1])) for a, b in ranges))


def _cut(words: Words, lo: int, hi: int, size: int, tail: int) -> list[tuple[int, int]]:
    first = words.pieces(lo, hi, size)
    return chunks_of(first, np.append(first[1:], hi), size, tail) if len(first) else []


def structural(text: str, sections: list[tuple[int, int]] | None, size: int, overlap: float) -> list[tuple[int, int]]:
    """Chunks along sections, paragraphs, lines and sentences; overlap only within a section that had to be split.

    Sections are character ranges in order; one begins no earlier than the one before it ends. What lies between them is
    cut into pieces too. A section that fits is one piece. One that does not is cut into chunks of its own, each of
    which begins a chunk, and so does a piece that stands right behind it.
    """
    words, tail = Words(text), round(size * overlap)
    if not len(words):
        return []
    if not sections:
        return _spans(words, _cut(words, 0, len(words), size, tail))
    rows: list[tuple[int, int, bool]] = []  # pieces: first word, word behind, begins a chunk
    at, behind = 0, -1
    for a, b in [*sections, (len(text), len(text))]:
        a = max(a, at)
        lo, hi = words.within(at, a)
        first = words.pieces(lo, hi, size)
        rows += [(int(i), int(j), k == 0 and at == behind and words.opens_at(at, lo, hi, size)) for k, (i, j) in enumerate(zip(first, np.append(first[1:], hi)))]
        lo, hi = words.within(a, b)
        if hi - lo > size:
            rows += [(i, j, True) for i, j in _cut(words, lo, hi, size, tail)]
            behind = b
        elif hi > lo:
            rows.append((lo, hi, a == behind))
        at = max(at, b)
    first, past, forced = (np.array(x) for x in zip(*rows))
    return _spans(words, chunks_of(first, past, size, 0, forced))


def semantic(text: str, encode: Callable[[list[str]], np.ndarray], size: int, overlap: float, percentile: float = 95, least: int = 16, piece: int = 64) -> list[tuple[int, int]]:
    """Chunks cut where neighbouring sentences, each encoded with its neighbours, are further apart than ``percentile`` of them.

    A stretch of fewer than ``least`` words stays with the one before it; one of more than ``size`` is cut by structure.
    """
    words, tail = Words(text), round(size * overlap)
    first = words.pieces(0, len(words), piece)
    past = np.append(first[1:], len(words))
    if len(first) <= 2:
        return _spans(words, chunks_of(first, past, size, tail)) if len(first) else []
    lo, hi = words.start[np.append(first[0], first[:-1])], words.end[np.append(past[1:], past[-1]) - 1]
    v = encode([text[a:b] for a, b in zip(lo, hi)])
    apart = np.round(1 - (v[:-1] * v[1:]).sum(1), 9)
    opens = np.append(True, apart > np.round(np.percentile(apart, percentile), 9))
    heads = np.flatnonzero(opens)
    count = np.add.reduceat(past - first, heads)
    starts = first[heads[(count >= least) | (np.arange(len(heads)) == 0)]]
    ranges: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)]):
        ranges += [(a, b)] if b - a <= size else _cut(words, a, b, size, tail)
    return [(int(words.start[a]), int(words.end[b - 1])) for a, b in ranges]
