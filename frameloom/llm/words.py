"""Words and shingles as flat numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. A batch of
texts is one byte buffer; every function works on all its words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLD = np.uint64(0x9E3779B97F4A7C15)
M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """The first n odd 64-bit numbers of a fixed sequence."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * GOLD + np.uint64(seed) * M1
        return mix(x) | np.uint64(1)


BYTE = stream(256, 7)
_places = [stream(256, 11)]


def places(n: int) -> np.ndarray:
    if len(_places[0]) < n:
        _places[0] = stream(max(n, 2 * len(_places[0])), 11)
    return _places[0]


class Words:
    """Words of a batch: ``start``/``end`` in ``buf``; document i owns words
    ``first[i]:first[i + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n".join([*texts, b""])
        self.raw = raw
        buf = np.frombuffer(raw, np.uint8)
        self.buf = LOWER[buf] if lower else buf
        gap = SPACE[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(buf) and not gap[0]:
            edge = np.concatenate([[0], edge])
        if len(edge) % 2:
            edge = np.append(edge, len(buf))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        shift = np.repeat(self.start - begin, size)
        inner = np.arange(len(shift))
        inside = np.repeat(begin, size)
        value = BYTE[self.buf[inner + shift]] * places(int(size.max()))[inner - inside]
        return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * GOLD)


def grams(h: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Hash of the n consecutive hashes from each position: len(h) - n + 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    odd = stream(n, seed)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += mix(h[j : j + m] + odd[j]) * odd[j]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 3 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of Arrow batches with about ``limit`` bytes of text at most (one
    row at least), with the texts as bytes (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            upto = max(upto, at + 1)
            part = texts.slice(at, upto - at).cast(pa.binary())
            yield batch.slice(at, upto - at), [x or b"" for x in part.to_pylist()]
            at = upto
