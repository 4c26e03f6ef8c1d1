"""LM scoring: a smoothed n-gram model in an Elias-Fano trie, in shards of each level.

Texts become chunks of local word numbers. An exchange by word gives each chunk
global word numbers and training counts. Then each level of the trie has its own
exchange: a chunk sends its distinct n-grams once, with their training counts, and
the shard of their context counts them, builds its part of the level, and answers
with quantised probabilities, counts, and the numbers of the nodes, which are the
contexts of the next level. A context that no other chunk has is complete where it is, and its part of the level is built and asked there.
"""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import Numbers
from .eliasfano import TrieLevel
from .storage import discard, materialize, shard_count
from .words import Words, mix, slices

#: Text of a chunk, and codes per unit of log10.
CHUNK, STEPS = 6 << 20, 2048
#: N-grams of a shard whose part of the level is in memory at once.
PART = 1 << 18
#: Weight of the lower orders at each level: single words are seen often, pairs are not.
WEIGHTS = {2: 200.0}
WEIGHT = 8.0
END = np.uint64(1)


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of whole numbers, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def held_out(doc_id) -> bool:
    """crc32 of the id as text, mod 7, is 2 (a null id is an empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(schema: str, **other: pa.DataType) -> pa.Schema:
    """Arrow's form of a list of columns; ``other`` has the types of some."""
    names = [f.split()[:2] for f in schema.split(", ")]
    return pa.schema([(n, other.get(n) or KINDS[k]) for n, k in names])


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


CHUNKS = "chunk string, shard int, ids {ids}, held binary, sizes binary, tokens binary, order binary, edge binary, hashes binary, counts binary, others binary"


def _chunks(shards: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, tokens, sizes, words, size = [], [], [], Numbers(), 0

        def flush():
            nonlocal ids, tokens, sizes, words, size, number
            t = np.concatenate(tokens)
            n = np.array(sizes)
            held = np.array([held_out(i) for i in ids])
            apart = np.repeat(held, n)
            count, other = (np.bincount(t[x], minlength=len(words) + 1) for x in (~apart, apart))
            h = np.append(END, Words(list(words)).hashes() if words else np.zeros(0, np.uint64))
            name = f"{part}-{number}"
            shard = (mix(h) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            yield _rows(schema, [{"chunk": name, "shard": -1, "ids": ids, "held": held.tobytes(), "sizes": _pack(n.astype(np.uint32)), "tokens": _pack(t.astype(np.uint32)), "order": _pack(order.astype(np.uint32)), "edge": _pack(edge)}])
            own = [(s, order[edge[s] : edge[s + 1]]) for s in np.flatnonzero(np.diff(edge)).tolist()]
            yield _rows(schema, [{"chunk": name, "shard": s, "hashes": h[o].tobytes(), "counts": _pack(count[o].astype(np.uint32)), "others": _pack(other[o].astype(np.uint32))} for s, o in own])
            number += 1
            ids, tokens, sizes, words, size = [], [], [], Numbers(), 0
            _release()

        for b, texts in slices(batches, "text"):
            for i, t in zip(b.column(0).to_pylist(), texts, strict=True):
                own = t.lower().split()
                x = np.zeros(len(own) + 1, np.int64)  # the end is word 0
                x[:-1] = np.fromiter(map(words.__getitem__, own), np.int64, len(own)) + 1
                ids.append(i)
                tokens.append(x)
                sizes.append(len(x))
                size += len(t)
            if size > CHUNK:
                yield from flush()
        if ids:
            yield from flush()

    return run


VOCABULARY = "chunk string, shard int, name binary, total binary, other binary, types long, tokens long"


def _vocabulary(shards: int):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        shard = rows[0]["shard"]
        h = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        _, name, found = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        # words that many chunks have get low numbers, which take less room
        rank = np.empty(len(found), np.int64)
        rank[np.argsort(-found, kind="stable")] = np.arange(len(found))
        name = rank[name]
        total, other = (np.bincount(name, weights=np.concatenate([_unpack(r[c], np.uint32) for r in rows])).astype(np.int64) for c in ("counts", "others"))
        # numbers from 1; 0 stands for the start of a text
        wide = name * shards + shard + 1
        out, at = [], 0
        for r, x in zip(rows, h, strict=True):
            k = slice(at, at + len(x))
            out.append({"chunk": r["chunk"], "shard": shard, "name": _pack(wide[k]), "total": _pack(total[name[k]]), "other": _pack(other[name[k]]), "types": 0, "tokens": 0})
            at += len(x)
        out.append({"chunk": None, "types": int((total > 0).sum()), "tokens": int(total.sum())})
        return pa.Table.from_pylist(out, schema=_arrow(VOCABULARY))

    return run


STATE = "chunk string, held binary, sizes binary, tokens binary, name binary, total binary, other binary"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Global numbers and training counts of a chunk's words, by local number."""
    for b in batches:
        for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
            order, edge = _unpack(r["order"], np.uint32), _unpack(r["edge"], np.int64)
            name, total, other = np.zeros((3, len(order)), np.int64)
            for w in r["words"]:
                at = order[edge[w["shard"]] : edge[w["shard"] + 1]]
                name[at], total[at], other[at] = (_unpack(w[c], np.int64) for c in ("name", "total", "other"))
            yield _rows(_arrow(STATE), [{"chunk": r["chunk"], "held": r["held"], "sizes": r["sizes"], "tokens": r["tokens"], "name": _pack(name), "total": _pack(total), "other": _pack(other)}])


def codes(n, context_n, lower, weight: float) -> np.ndarray:
    """Quantised -log10 of (n + weight * lower) / (context + weight); ``lower`` is a code."""
    p = (n + weight * 10.0 ** (-np.asarray(lower, float) / STEPS)) / (context_n + weight)
    return np.minimum(65_535, np.rint(-STEPS * np.log10(p))).astype(np.uint16)


def _changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a pair of a sorted list differs from the one before."""
    return np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]


def _order(*keys: np.ndarray) -> np.ndarray:
    """Places in order of the keys, the first one above the others; ties in any order.
    The keys are sorted as one number, as they are or by their ranks."""
    for dense in (False, True):
        if dense:
            keys = tuple(np.unique(k, return_inverse=True)[1] for k in keys)
        wide = [int(k.max(initial=0)) + 1 for k in keys]
        if math.prod(wide) < 1 << 63:
            one = keys[0].astype(np.int64)
            for k, w in zip(keys[1:], wide[1:], strict=True):
                one = one * w + k
            return np.argsort(one)
    return np.lexsort(keys[::-1])


def _release() -> None:
    """Give free memory back: a worker outlives its tasks, and the heap keeps what they freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """Places by shard, in their order within it (numbers of 16 bits sort by radix)."""
    return np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")


class Level:
    """Distinct n-grams (context, word) with counts in training and in other texts,
    summed over chunks, and the trie level of those that occur in training."""

    def __init__(self, context, word, train, other, context_n, lower, weight: float):
        order = _order(context, word)
        new = _changes(context[order], word[order])
        head = order[np.flatnonzero(new)]
        self.node = np.empty(len(order), np.int64)  # of each given n-gram
        self.node[order] = np.cumsum(new) - 1
        self.n = np.bincount(self.node, weights=train, minlength=len(head)).astype(np.int64)
        self.other = np.bincount(self.node, weights=other, minlength=len(head)).astype(np.int64)
        seen = np.flatnonzero(self.n)
        at = head[seen]
        trie = TrieLevel(context[at], word[at], codes(self.n[seen], context_n[at], lower[at], weight)).memory_mapped()
        # every distinct n-gram is asked once; one that training lacks has the lower order's share
        code = trie.find(context[head], word[head])
        self.code = np.where(code >= 0, code, codes(0, context_n[head], lower[head], weight)).astype(np.uint16)


class Chunk:
    """Tokens of a chunk, and at ``order`` k the distinct n-grams that end in them:
    ``gram`` by token (-1 near a text's start), their counts, numbers and codes."""

    def __init__(self, r: dict, n: int, v: int):
        self.t = _unpack(r["tokens"], np.uint32).view(np.int32)
        self.sizes = _unpack(r["sizes"], np.uint32).astype(np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.place = (np.arange(len(self.t)) - np.repeat(self.start, self.sizes)).astype(np.int32)
        self.train = ~np.repeat(np.frombuffer(r["held"], bool), self.sizes)
        self.name, self.total = _unpack(r["name"], np.int64), _unpack(r["total"], np.int64)
        self.order = 1
        # a text's start is a context as often as its end is a word
        begin = len(self.name)
        self.gram = self.t
        self.own = np.bincount(self.t[self.train], minlength=begin)
        rest = np.bincount(self.t[~self.train], minlength=begin)
        self.own, self.own_other = np.append(self.own, self.own[0]), np.append(rest, rest[0])
        other = _unpack(r["other"], np.int64)
        self.other = np.append(other, other[0])
        self.n, self.number = np.append(self.total, self.total[0]), np.append(self.name, 0)
        self.code = codes(self.total[self.t] + 1.0, n + v + 1.0, 0, 0.0)
        self.begin = begin

    def step(self) -> None:
        """The distinct n-grams of the next order: context (an n-gram of this order) and word."""
        k = self.order = self.order + 1
        before = np.append(-1, self.gram[:-1]).astype(np.int64)
        if k == 2:
            before[self.start] = self.begin
        valid = np.flatnonzero(self.place >= k - 2)
        wide = len(self.name)
        pair = before[valid] * wide + self.t[valid]
        del before
        order = np.argsort(pair)
        pair = pair[order]
        new = np.append(True, pair[1:] != pair[:-1])[: len(pair)]
        # any token of an n-gram has its code
        values, first = pair[new], order[new]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        del pair, order, new
        self.context, self.word = (values // wide).astype(np.int32), (values % wide).astype(np.int32)
        self.gram = np.full(len(self.t), -1, np.int32)
        self.gram[valid] = inverse
        self.context_n = self.n[self.context]
        self.alone = ((self.n == self.own) & (self.other == self.own_other))[self.context]
        self.context_number = self.number[self.context]
        self.lower = self.code[valid[first]]
        self.own = np.bincount(inverse[self.train[valid]], minlength=len(values)).astype(np.int32)
        self.own_other = np.bincount(inverse, minlength=len(values)).astype(np.int32) - self.own

    def dealt(self, shards: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, places of the n-grams to send, by shard; edges of the shards). Pairs go
        in order of their numbers, which a chunk can tell again from its words."""
        sent = np.flatnonzero(~self.alone)
        # a context with a large share of all n-grams has parts, by its words
        parts = 1 + self.context_n[sent] * 2 * shards // max(n, 1)
        word = self.name[self.word[sent]]
        key = self.context_number[sent].astype(np.uint64) * np.uint64(1 << 20) + (word % parts).astype(np.uint64)
        shard = (mix(key) % np.uint64(shards)).astype(np.uint32)
        order = _order(shard, self.context_number[sent], word) if self.order == 2 else _by_shard(shard, shards)
        return shard, sent[order], np.searchsorted(shard[order], np.arange(shards + 1))

    def answered(self, code: np.ndarray, n: np.ndarray, other: np.ndarray, number: np.ndarray) -> None:
        self.n, self.other, self.number = n, other, number
        on = self.gram >= 0
        self.code = self.code.copy()
        self.code[on] = code[self.gram[on]]


SENT = "shard int, chunk string, kept binary, alone binary, own binary, new binary, context binary, context_n binary, word binary, train binary, other binary, lower binary"


def _send(k: int, shards: int, n: int, v: int):
    """Distinct k-grams of each chunk by shard, and what the chunk keeps of them."""
    schema = _arrow(SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(x, 1).to_pylist()[0] for x in range(b.num_rows)):
                c = Chunk(r, n, v)
                _replay(c, r.get("answers"), k - 1, shards, n)
                del r["answers" if k > 2 else "name"]
                c.step()
                c.n = c.number = c.train = c.place = None
                alone = np.flatnonzero(c.alone)
                name = c.name[c.word]
                kept = np.empty(len(alone), np.uint16)
                for x in _parts(c.context[alone], PART):
                    at = alone[x]
                    own = Level(c.context[at], name[at], c.own[at], c.own_other[at], c.context_n[at], c.lower[at], WEIGHTS.get(k, WEIGHT))
                    kept[x] = own.code[own.node]
                    del own
                shard, sent, edge = c.dealt(shards, n)
                short = c.code[c.gram < 0]  # tokens too near a text's start
                out = [{"shard": zlib.crc32(r["chunk"].encode()) % shards, "chunk": r["chunk"], "kept": _pack(np.append(short, kept)), "alone": b"" if k == 2 else np.packbits(c.alone).tobytes(), "own": b"" if k == 2 else _pack(shard)}]
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    x = sent[edge[s] : edge[s + 1]]
                    new = np.append(True, c.context[x][1:] != c.context[x][:-1])
                    out.append({"shard": s, "chunk": r["chunk"], "new": _pack(np.packbits(new)), "context": _pack(np.diff(c.context_number[x][new], prepend=0) if k == 2 else c.context_number[x][new]), "context_n": _pack(c.context_n[x][new]), "word": _pack(name[x]), "train": _pack(c.own[x].astype(np.uint32)), "other": _pack(c.own_other[x].astype(np.uint32)), "lower": _pack(c.lower[x])})
                del c, kept, sent, shard, short
                yield _rows(schema, out)
                del out
                _release()

    return run


ANSWERS = "chunk string, shard int, kept binary, alone binary, own binary, code binary, n binary, other binary, number binary"


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits, if all of them fit."""
    return a.astype(np.uint32) if int(a.max(initial=0)) < 1 << 32 and int(a.min(initial=0)) >= 0 else a


def _parts(context: np.ndarray, part: int) -> Iterator[np.ndarray]:
    """Places of the n-grams by rising ranges of contexts, about ``part`` in each; a context is in one range."""
    some = np.sort(context[:: max(1, part // 64)])
    bounds = np.unique(some[64::64]) if len(context) > part else some[:0]
    where = np.searchsorted(bounds, context, side="right").astype(np.uint32)
    for k in range(len(bounds) + 1):
        yield np.flatnonzero(where == k)


def _answer(k: int, last: bool, shards: int, part: int = PART):
    """Of one shard: its part of the level, asked for each chunk's k-grams. Only the
    columns are in memory whole; the level is built and asked by ranges of contexts."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        shard = rows[0]["shard"]
        out = [{"chunk": r["chunk"], "shard": -1, "kept": r["kept"], "alone": r["alone"], "own": r["own"]} for r in rows if r["kept"] is not None]
        rows = [r for r in rows if r["kept"] is None]
        if rows:
            word = [_narrow(_unpack(r.pop("word"), np.int64)) for r in rows]
            size = [len(w) for w in word]
            word = np.concatenate(word)
            at = [np.cumsum(np.unpackbits(_unpack(r.pop("new"), np.uint8), count=n), dtype=np.uint32) - np.uint32(1) for r, n in zip(rows, size, strict=True)]
            context = [_unpack(r.pop("context"), np.int64) for r in rows]
            context = np.concatenate([_narrow(np.cumsum(c) if k == 2 else c)[a] for c, a in zip(context, at, strict=True)])
            context_n = np.concatenate([_narrow(_unpack(r.pop("context_n"), np.int64))[a] for r, a in zip(rows, at, strict=True)])
            del at
            train, other = (np.concatenate([_unpack(r.pop(c), np.uint32) for r in rows]) for c in ("train", "other"))
            lower = np.concatenate([_unpack(r.pop("lower"), np.uint16) for r in rows])
            code = np.empty(len(word), np.uint16)
            if not last:
                most = max(int(x.sum(dtype=np.int64)) for x in (train, other))
                sums, number, nodes = np.empty((2, len(word)), np.uint32 if most < 1 << 32 else np.int64), np.empty(len(word), np.uint32), 0
            for x in _parts(context, part):
                level = Level(context[x], word[x], train[x], other[x], context_n[x], lower[x], WEIGHTS.get(k, WEIGHT))
                code[x] = level.code[level.node]
                if not last:
                    sums[0, x], sums[1, x], number[x] = level.n[level.node], level.other[level.node], level.node + nodes
                    nodes += len(level.code)
                del level
            del word, context, context_n, train, other, lower
            ends = np.cumsum(size)
            for r, n, end in zip(rows, size, ends.tolist(), strict=True):
                own = slice(end - n, end)
                row = {"chunk": r["chunk"], "shard": shard, "code": _pack(code[own])}
                if not last:
                    row |= {"n": _pack(sums[0, own].astype(np.int64)), "other": _pack(sums[1, own].astype(np.int64)), "number": _pack(np.diff(number[own].astype(np.int64), prepend=0))}
                out.append(row)
            if not last:
                del sums, number
            del code
        del rows
        _release()
        return pa.Table.from_pylist(out, schema=_arrow(ANSWERS))

    return run


def _replay(c: Chunk, answers: list | None, k: int, shards: int, total: int) -> None:
    """Bring a chunk from its words to order ``k`` with the shards' answers at k."""
    while c.order < k:
        # orders between need no answers but the last: its codes hold all below
        c.step()
        if c.order < k:
            c.n, c.other, c.number = c.own.astype(np.int64), c.own_other.astype(np.int64), np.zeros(len(c.own), np.int64)
    if k < 2:
        return
    top = next(a for a in answers if a["kept"] is not None)
    if k == 2:
        alone = c.alone
        _, sent, edge = c.dealt(shards, total)
    else:
        alone = np.unpackbits(np.frombuffer(top["alone"], np.uint8), count=len(c.own)).view(bool)
        own = _unpack(top["own"], np.uint32)
        order = _by_shard(own, shards)
        sent, edge = np.flatnonzero(~alone)[order], np.searchsorted(own[order], np.arange(shards + 1))
    kept = _unpack(top["kept"], np.uint16)
    short = np.flatnonzero(c.gram < 0)
    c.code = c.code.copy()
    c.code[short] = kept[: len(short)]
    code, n, other, number = np.zeros(len(c.own), np.uint16), c.own.astype(np.int64), c.own_other.astype(np.int64), np.zeros(len(c.own), np.int64)
    code[alone] = kept[len(short) :]
    for a in answers:
        if a["code"] is not None:
            x = sent[edge[a["shard"]] : edge[a["shard"] + 1]]
            code[x] = _unpack(a["code"], np.uint16)
            if a["n"] is not None:
                n[x], other[x] = _unpack(a["n"], np.int64), _unpack(a["other"], np.int64)
                number[x] = np.cumsum(_unpack(a["number"], np.int64)) * shards + a["shard"] + 1
    c.answered(code, n, other, number)


def _total(order: int, shards: int, n: int, v: int, schema: pa.Schema):
    """Sums over each document of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(x, 1).to_pylist()[0] for x in range(b.num_rows)):
                c = Chunk(r, n, v)
                seen = c.total[c.t]
                base = np.add.reduceat(np.log10(seen + 1.0), c.start) - c.sizes * np.log10(n + v + 1.0)
                known = np.add.reduceat((seen > 0).astype(np.int64), c.start)
                _replay(c, r["answers"], order, shards, n)
                score = -np.add.reduceat(c.code.astype(np.int64), c.start) / STEPS
                cols = [r["ids"], np.frombuffer(r["held"], bool), c.sizes, known, np.full(len(c.sizes), n), base, score]
                del c, seen
                _release()
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def score_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Base: add-one unigrams with one place for unknown words. Score: log10 of the model
    of ``order`` words (2 at least), where each order is (c(h, w) + weight * lower order)
    / (c(h) + weight) and the lowest is the base; a text begins after its start, which
    occurs as often as the end, and a word nearer to it than the order's context takes
    the order below. Each factor is rounded to 1 / STEPS at every order. A null text is
    the end alone; a null id counts as an empty one for the split; repeated rows are
    documents of their own; an empty table gives an empty result; ids may be of any
    type; other columns are not read. If no document trains, counts are 0 and both
    scores follow from that. Words are told apart by 64-bit hashes.
    """
    if order < 2:
        raise ValueError(f"order must be 2 at least, not {order}")
    few = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ids = few.schema["doc_id"].dataType.simpleString()
    shards = shard_count(few)
    id_type = to_arrow_type(few.schema["doc_id"].dataType)
    schema = _arrow(CHUNKS, ids=pa.list_(id_type))
    chunks = materialize(few.mapInArrow(_chunks(shards, schema), CHUNKS.format(ids=f"array<{ids}>")), "lm-chunks")
    words = chunks.filter("shard >= 0").select("chunk", "shard", "hashes", "counts", "others")
    vocabulary = materialize(words.groupBy("shard").applyInArrow(_vocabulary(shards), VOCABULARY), "lm-vocabulary")
    v, n = (int(x or 0) for x in vocabulary.agg(F.sum("types"), F.sum("tokens")).head())
    own = vocabulary.filter("chunk IS NOT NULL").repartition(shards, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("shard", "name", "total", "other")).alias("words"))
    whole = chunks.filter("shard < 0")
    # ids stay with the chunks; the rest moves with the numbers of the words
    listed = materialize(whole.select("chunk", "ids"), "lm-ids")
    state = whole.select("chunk", "held", "sizes", "tokens", "order", "edge").repartition(shards, "chunk").join(own, "chunk").mapInArrow(_named, STATE)
    # the chunks and the answers at each level lie in the same buckets, so they meet without an exchange
    state = materialize(state, "lm-state", "chunk", shards)
    discard(chunks, vocabulary)
    before, asked = None, state
    for k in range(2, order + 1):
        sent = asked.mapInArrow(_send(k, shards, n, v), SENT)
        answered = sent.groupBy("shard").applyInArrow(_answer(k, k == order, shards), ANSWERS)
        level = materialize(answered.repartition(shards, "chunk"), f"lm-level-{k}", "chunk", shards)
        if before is not None:
            discard(before)
        before = level
        answers = level.groupBy("chunk").agg(F.collect_list(F.struct("shard", "kept", "alone", "own", "code", "n", "other", "number")).alias("answers"))
        asked = state.join(answers, "chunk")
    out = "doc_id {ids}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return asked.join(listed, "chunk").mapInArrow(_total(order, shards, n, v, _arrow(out, doc_id=id_type)), out.format(ids=ids))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
