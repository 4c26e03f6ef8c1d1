"""A compressed FM-index over integer symbols, searched for many patterns at once.

The Burrows-Wheeler transform is of suffixes ordered by their first 2^k symbols,
which serves patterns shorter than that. Ranks come from a wavelet matrix whose
levels are bit vectors of 64-bit words with running counts.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, bool)), bitorder="little").view(np.uint64)
        self.words = words
        count = np.bitwise_count(words).astype(np.int32)
        self.before = np.cumsum(count) - count
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before place i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    """Rank of a symbol in a prefix of a sequence, level by level of its bits."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[Bits] = []
        for k in range(self.depth - 1, -1, -1):
            bits = (symbols >> k) & 1 == 1
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        # where the run of each symbol starts on the last level
        values, first = np.unique(symbols, return_index=True)
        self.start = np.zeros(int(values.max(initial=0)) + 1, np.int64)
        self.start[values] = first

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of the symbols c before the places i."""
        i = i.astype(np.int64)
        for k, level in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = level.ones(i)
            i = np.where((c >> k) & 1 == 1, level.zeros + ones, i - ones)
        return i - self.start[c]


class FMIndex:
    """The Burrows-Wheeler transform in a wavelet matrix, symbol counts, and the
    document (a 32-bit rank) of each suffix; neither text nor suffix array is kept."""

    def __init__(self, text: np.ndarray, depth: int, document: np.ndarray):
        """``text``: symbols from 0; patterns of up to ``depth`` symbols are exact.
        ``document``: the document of each place, by rank."""
        n = len(text)
        order = text.astype(np.int64)
        k = 1
        while k <= depth:  # by 2k symbols
            nxt = np.concatenate([order[k:] + 1, np.zeros(min(k, n), np.int64)])
            order = np.unique(order * (int(order.max()) + 2) + nxt, return_inverse=True)[1]
            k *= 2
        suffixes = np.argsort(order, kind="stable")
        self.document = document[suffixes]
        self.wavelet = WaveletMatrix(text[suffixes - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])

    def matching_statistics(self, pattern: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``ends``, the length, up to ``most``, of the longest part of
        ``pattern`` that ends there and occurs in the text, and the least document
        rank among the occurrences of that part. Symbol 0 matches nothing."""
        length, lo, hi = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), len(self.document))
        on = np.arange(len(ends))
        for j in range(most):
            at = ends[on] - j
            on, at = on[at >= 0], at[at >= 0]
            c = pattern[at].astype(np.int64)
            known = (c > 0) & (c < len(self.first) - 1)
            on, c = on[known], c[known]
            if not len(on):
                break
            if j:
                both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[on], hi[on]]))
                a, b = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            else:
                a, b = self.first[c], self.first[c + 1]
            found = b > a
            on = on[found]
            lo[on], hi[on], length[on] = a[found], b[found], j + 1
        whole = np.flatnonzero(length == most)  # equal ranges repeat, others don't overlap
        least = np.zeros(len(ends), np.uint32)
        least[whole] = least_in(lo[whole], hi[whole], self.document)
        for x in np.flatnonzero((length > 0) & (length < most)).tolist():
            least[x] = self.document[lo[x] : hi[x]].min()
        return length, least


def least_in(ranges_lo: np.ndarray, ranges_hi: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Least value in each range; equal ranges repeat, others don't overlap."""
    if not len(ranges_lo):
        return values[:0]
    lo, first, back = np.unique(ranges_lo, return_index=True, return_inverse=True)
    edges = np.stack([lo, ranges_hi[first]], 1).ravel()
    padded = np.append(values, values[-1:])
    return np.minimum.reduceat(padded, edges)[::2][back]
