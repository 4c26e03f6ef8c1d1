"""Elias-Fano sequences and an n-gram trie over them, queried in bulk."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

from .fmindex import Bits


EACH = np.uint64(0x0101010101010101)
TOPS = np.uint64(0x8080808080808080)
#: Place of the k-th set bit of a byte, at 256 * k + byte.
IN_BYTE = np.array([([p for p in range(8) if b >> p & 1] + [8] * 8)[k] for k in range(8) for b in range(256)], np.uint8)


def select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each 64-bit word, which has it."""
    u = np.uint64
    n = word - ((word >> u(1)) & u(0x5555555555555555))
    n = (n & u(0x3333333333333333)) + ((n >> u(2)) & u(0x3333333333333333))
    n = ((n + (n >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * EACH  # set bits up to each byte
    place = np.bitwise_count(((k * EACH | TOPS) - n) & TOPS).astype(u) << u(3)
    rest = k - (((n << u(8)) >> place) & u(255))
    return place + IN_BYTE[((rest << u(8)) | ((word >> place) & u(255))).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of whole numbers: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        b = np.uint64(self.bits)
        low = values & ((np.uint64(1) << b) - np.uint64(1))
        places = np.arange(self.n, dtype=np.uint64) * b
        self.low = np.zeros(self.n * self.bits // 64 + 2, np.uint64)
        w, s = (places >> np.uint64(6)).astype(np.int64), places & np.uint64(63)
        np.bitwise_or.at(self.low, w, low << s)
        over = s + b > np.uint64(64)
        np.bitwise_or.at(self.low, w[over] + 1, low[over] >> (np.uint64(64) - s[over]))
        unary = np.zeros((top >> self.bits) + self.n + 1, bool)
        unary[(values >> b).astype(np.int64) + np.arange(self.n)] = True
        self.high = Bits(unary)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        i = i.astype(np.int64)
        w = np.searchsorted(self.high.before, i, "right") - 1
        left = (i - self.high.before[w]).astype(np.uint64)
        at = select(self.high.words[w], left)
        high = w.astype(np.uint64) * np.uint64(64) + at - i.astype(np.uint64)
        b = np.uint64(self.bits)
        place = i.astype(np.uint64) * b
        k, s = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        low = self.low[k] >> s
        over = s + b > np.uint64(64)
        low[over] |= self.low[k[over] + 1] << (np.uint64(64) - s[over])
        return (high << b) | (low & ((np.uint64(1) << b) - np.uint64(1)))

    def below(self, high: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``high``: select of the zeros."""
        k = np.minimum(high.astype(np.int64), len(self.high.words) * 64 - self.n) - 1
        zeros = np.arange(len(self.high.words)) * 64 - self.high.before
        w = np.searchsorted(zeros, np.maximum(k, 0), "right") - 1
        left = (np.maximum(k, 0) - zeros[w]).astype(np.uint64)
        at = select(~self.high.words[w], left)
        return np.where(k < 0, 0, w * 64 + at.astype(np.int64) - k)

    def successor(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) with at least ``value``, else hi: the values with the
        same high bits are found by select, the place among them by halving."""
        value = value.astype(np.uint64)
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        high = value >> np.uint64(self.bits)
        lo, hi = np.minimum(np.maximum(lo, self.below(high)), hi), np.maximum(np.minimum(hi, self.below(high + np.uint64(1))), lo)
        lo, hi = lo.copy(), np.maximum(lo, hi)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self[mid] < value[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high.words, self.high.before]

    def mapped(self, arrays: list[np.ndarray]) -> None:
        self.low, self.high.words, self.high.before = arrays


class TrieLevel:
    """One level of an n-gram trie: contexts (nodes of the level above, by number),
    pointers and successors, each a monotone sequence.

    The successors of a context are stored on top of the last value of the one
    before, so all of them rise; a query adds the same base and searches within
    its context's range. Each has a quantised log-probability.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, code: np.ndarray):
        """Sorted by (context, word), distinct."""
        head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        self.contexts = EliasFano(context[head])
        self.pointers = EliasFano(np.append(head, len(context)))
        last = np.append(head[1:], len(context))[: len(head)] - 1
        base = np.concatenate([[0], np.cumsum(word[last].astype(np.uint64))])[: len(head)].astype(np.uint64)
        self.successors = EliasFano(word.astype(np.uint64) + np.repeat(base, np.diff(np.append(head, len(context)))))
        self.code = code.astype(np.uint16)

    def memory_mapped(self) -> TrieLevel:
        """Move the levels into one mapped file that has no name left."""
        parts = [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(), self.code]
        sizes = [-(-max(p.nbytes, 1) // 8) * 8 for p in parts]
        with tempfile.TemporaryFile() as f:
            f.truncate(sum(sizes))
            m = mmap.mmap(f.fileno(), sum(sizes))
        at, views = 0, []
        for p, s in zip(parts, sizes, strict=True):
            view = np.frombuffer(m, p.dtype, len(p), at)
            view[:] = p
            views.append(view)
            at += s
        self.contexts.mapped(views[0:3])
        self.pointers.mapped(views[3:6])
        self.successors.mapped(views[6:9])
        self.code = views[9]
        return self

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the n-grams; -1 where there is none."""
        out = np.full(len(context), -1, np.int64)
        n = self.contexts.n
        if not n or not len(context):
            return out
        if (context[1:] >= context[:-1]).all():
            rise = context[1:] != context[:-1]
            heads, back = context[np.append(True, rise)], np.append(0, np.cumsum(rise))
        else:
            heads, back = np.unique(context, return_inverse=True)
        c = self.contexts.successor(heads, np.zeros(len(heads)), np.full(len(heads), n))
        known = c < n
        known[known] = self.contexts[c[known]] == heads[known].astype(np.uint64)
        c = np.where(known, c, 0)
        lo, hi = self.pointers[c].astype(np.int64), self.pointers[c + 1].astype(np.int64)
        base = np.where(lo > 0, self.successors[np.maximum(lo - 1, 0)], np.uint64(0))
        row = np.flatnonzero(known[back])
        k = back[row]
        value = word[row].astype(np.uint64) + base[k]
        at = self.successors.successor(value, lo[k], hi[k])
        hit = at < hi[k]
        hit[hit] = self.successors[at[hit]] == value[hit]
        out[row[hit]] = self.code[at[hit]]
        return out
