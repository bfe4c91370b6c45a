"""Anchored contexts: how equal windows of two documents find each other.

Every window's anchor is the least hash among the grams inside it, so equal
windows have equal anchors wherever they stand.  A context is a run of windows in
a row with one anchor, with the units they cover; there is about one context to
every half window, and equal passages give equal contexts but at their edges.
Windows never cross documents.
"""

from __future__ import annotations

import numpy as np

from . import _text
from ._text import U

#: Most windows of a context; longer runs are cut.
LONGEST = 256


class Contexts:
    """The contexts of a piece: document, first unit in it, windows, anchor, and (given two sequences of values) two hashes of the units."""

    def __init__(self, values: tuple[np.ndarray, ...], offsets: np.ndarray, width: int, gram: int):
        self.prefix = [_text.Prefix(v, k) for k, v in enumerate(values)]
        n = len(values[0]) - width + 1
        if n <= 0:
            self.at = self.doc = self.start = self.windows = np.empty(0, np.int64)
            self.anchor = self.c1 = self.c2 = self.grams = np.empty(0, U)
            self.reach = 0
            return
        self.grams, self.reach = _text.mix(self.prefix[0].windows(gram), 21), width - gram + 1
        anchor = _text.sliding_min(self.grams, self.reach)
        marks = np.zeros(n + 1, np.int8)
        long = np.flatnonzero(np.diff(offsets) >= width)
        marks[offsets[long]] += 1
        marks[offsets[long + 1] - width + 1] -= 1
        whole = np.cumsum(marks[:-1], dtype=np.int8) > 0
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
        at = np.flatnonzero(first)
        # a run ends before the next begins or where windows stop being whole
        stop = np.flatnonzero(~whole)
        following = np.append(at[1:], n)
        gap = np.searchsorted(stop, at)
        end = np.minimum(following, np.append(stop, n)[gap])
        size = end - at
        parts = -(-size // LONGEST)
        again = np.repeat(np.arange(len(at)), parts)
        turn = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        at, size = at[again] + turn * LONGEST, np.minimum(size[again] - turn * LONGEST, LONGEST)
        self.at, self.windows, self.anchor = at, size, anchor[at]
        self.doc = np.searchsorted(offsets, at, "right") - 1
        self.start = at - offsets[self.doc]
        if len(values) < 2:
            return
        units = (size + width - 1).astype(U)
        self.c1 = _text.mix(self.prefix[0].hash(at, at + size + width - 1) + units, 22)
        self.c2 = _text.mix(self.prefix[1].hash(at, at + size + width - 1) + units, 23)

    def inner(self) -> np.ndarray:
        """Which contexts hold their anchor more than once; only these can repeat a window of their own."""
        if not len(self.at):
            return np.zeros(0, bool)
        known = np.zeros(1 << 20, bool)
        known[(self.anchor >> U(44)).astype(np.int64)] = True
        near = np.flatnonzero(known[(self.grams >> U(44)).astype(np.int64)])
        names, which = np.unique(self.anchor, return_inverse=True)
        found = np.searchsorted(names, self.grams[near])
        true = names[np.minimum(found, len(names) - 1)] == self.grams[near]
        n = len(self.grams) + 1
        places = np.sort(found[true] * n + near[true])
        ends = np.minimum(self.at + self.windows - 1 + self.reach, n)
        return np.searchsorted(places, which * n + ends) - np.searchsorted(places, which * n + self.at) > 1


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n units any of the ranges covers."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0
