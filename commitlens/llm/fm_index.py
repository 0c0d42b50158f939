"""An FM-index over integer symbols: suffix order, wavelet-tree ranks, backward search and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order, by prefix doubling over the suffixes still tied.

    Code 0 is a separator and no two are equal: the k-th has rank k and every other code is larger. So no suffix is compared
    past the next separator, and the number of doublings is the logarithm of the longest run between separators.
    """
    n = len(codes)
    zero = codes == 0
    k = int(zero.sum())
    key = codes.astype(np.int64) + k
    key[zero] = np.arange(k)
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n, np.int64)

    def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
        return np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))

    first = np.flatnonzero(starts_of(key[order]))
    ranks[order] = np.repeat(first, np.diff(np.append(first, n)))
    h = 1
    while True:
        # places in the order whose suffix still shares its rank with another
        r = ranks[order]
        same = r[1:] == r[:-1]
        open_ = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(open_):
            return order
        suffix = order[open_]
        nxt = np.where(suffix + h < n, ranks[np.minimum(suffix + h, n - 1)], -1)
        by = np.lexsort((nxt, ranks[suffix]))
        suffix, nxt, old = suffix[by], nxt[by], ranks[suffix][by]
        order[open_] = suffix
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])))
        ranks[suffix] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        h *= 2


class Wavelet:
    """Ranks in a sequence of codes below 2**levels, as one bit row per level, from the highest bit down."""

    def __init__(self, codes: np.ndarray, levels: int):
        self.rows, self.zeros, self.levels = [], [], levels
        s = codes
        for level in range(levels - 1, -1, -1):
            bit = (s >> level) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.rows.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    def rank(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first at[i] symbols equal codes[i]."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for row, zeros, level in zip(self.rows, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            one = ((codes >> level) & 1).astype(bool)
            a, b = row[lo], row[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes at the places, and their ranks there."""
        code, lo, p = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.astype(np.int64)
        for row, zeros, level in zip(self.rows, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            one = row[p + 1] > row[p]
            code |= one.astype(np.int64) << level
            a, b = row[lo], row[p]
            lo, p = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, p - b)
        return code, p - lo


class FMIndex:
    """Finds all places of code sequences without 0 in ``codes``, which starts with a 0."""

    def __init__(self, codes: np.ndarray, levels: int, sample: int = 8):
        order = suffix_order(codes)
        last = codes[order - 1]  # of the suffix at 0 this is the text's last code; no search goes there, as the text starts with 0
        last[order == 0] = 0
        self.tree = Wavelet(last, levels)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=1 << levels))))
        # kept positions: every sample-th, and those behind a separator, so that no walk crosses one
        keep = (order % sample == 0) | (last == 0)
        self.kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=self.kept[1:])
        self.positions = order[keep]
        self.n = len(codes)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges [lo, hi) in suffix order of each row of ``patterns`` (right-aligned in its row), all rows at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1] - 1, -1, -1):
            act = np.flatnonzero((patterns.shape[1] - step <= lengths) & (lo < hi))
            if len(act):
                c = patterns[act, step]
                lo[act], hi[act] = self.first[c] + self.tree.rank(c, lo[act]), self.first[c] + self.tree.rank(c, hi[act])
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these places, by walking back to a kept position."""
        out, steps, p, left = np.empty(len(places), np.int64), 0, places.astype(np.int64), np.arange(len(places))
        while len(left):
            done = self.kept[p + 1] > self.kept[p]
            out[left[done]] = self.positions[self.kept[p[done]]] + steps
            p, left = p[~done], left[~done]
            if len(left):
                code, rank = self.tree.access(p)
                p = self.first[code] + rank
            steps += 1
        return out
