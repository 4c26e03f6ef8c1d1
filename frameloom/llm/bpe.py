"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into pieces by a vectorised form of the usual pattern. Distinct
pieces of similar length share a padded matrix of token ids; in each round every
row merges its leftmost pair of least rank, found through a hashed pair table,
and is compacted by one column.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import packed, unpacked, with_field
from .words import slices

NONE = np.int32(2**31 - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Pieces longer than this merge on a heap: a matrix as wide would cost its square.
WIDEST = 1024
#: Distinct pieces whose ids a worker remembers.
REMEMBERED = 500_000


class PairTable:
    """Open-addressing hash table (left, right) -> (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * max(len(left), 1) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        key = self._key(left, right)
        at = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            slot = at[todo]
            free = self.key[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            winner = np.zeros(len(todo), bool)
            winner[first] = True
            put = todo[free & winner]
            self.key[at[put]], self.rank[at[put]], self.merged[at[put]] = key[put], rank[put], merged[put]
            todo = todo[~(free & winner)]
            at[todo] = (at[todo] + 1) & self.mask

    def _key(self, left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return ((key * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs; rank NONE where a pair doesn't merge."""
        key = self._key(left, right)
        at = self._slot(key)
        seen = self.key[at]
        open_ = np.flatnonzero((seen != key) & (seen != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.key[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen != np.uint64(2**64 - 1))]
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.merged[at], -1)


class Vocabulary:
    """Tokens by id and the pairs that merge."""

    def __init__(self, tokens: list[bytes], pairs: PairTable, whole: bool):
        self.tokens, self.pairs = tokens, pairs
        self.id_of = {t: i for i, t in enumerate(tokens)}
        self.whole = whole  # a piece that is a token is that token
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], np.int32)
        self.bytes_ = Ragged(tokens)
        self.decimal = Ragged([b"%d," % i for i in range(len(tokens))])

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: any two tokens whose joined bytes are a token merge, at its rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        rows = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a = np.array(rows, np.int32).reshape(-1, 3)
        return cls(tokens, PairTable(a[:, 0], a[:, 1], a[:, 2], a[:, 2]), whole=True)

    @classmethod
    def from_merges(cls, path: str) -> Vocabulary:
        """A tokenizer JSON: only the listed pairs merge, in their order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # printable stand-ins of bytes: the printable ones themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        tokens = [b""] * (max(model["vocab"].values()) + 1)
        for t, i in model["vocab"].items():
            tokens[i] = bytes(byte[c] for c in t)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        v = model["vocab"]
        a = np.array([(v[x], v[y], v[x + y]) for x, y in pairs], np.int32).reshape(-1, 3)
        return cls(tokens, PairTable(a[:, 0], a[:, 1], np.arange(len(a), dtype=np.int32), a[:, 2]), whole=False)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of the pieces in order, and the number of each."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # numbers of pieces, counts, ids
        todo = np.ones(len(pieces), bool)
        if self.whole:
            ids = np.fromiter((self.id_of.get(p, -1) for p in pieces), np.int32, len(pieces))
            todo = ids < 0
            done.append((np.flatnonzero(~todo), np.ones((~todo).sum(), np.int64), ids[~todo]))
        for i in np.flatnonzero(todo & (size > WIDEST)).tolist():
            ids = self._on_heap(pieces[i])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        rows = np.flatnonzero(todo & (size <= WIDEST))
        rows = rows[np.argsort(size[rows], kind="stable")]
        bits = np.ceil(np.log2(np.maximum(size[rows], 4))).astype(np.int64)
        for k in np.unique(bits).tolist():
            own, block = rows[bits == k], max(1, (1 << 17) >> k)
            for at in range(0, len(own), block):
                self._merge([pieces[i] for i in own[at : at + block].tolist()], own[at : at + block], done)
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        name, count, flat = (np.concatenate([d[j] for d in done]) for j in range(3))
        at = np.cumsum(count) - count
        order = np.argsort(name)
        count, at = count[order], at[order]
        shift = np.repeat(at - (np.cumsum(count) - count), count)
        return flat[np.arange(len(shift)) + shift], count

    def _merge(self, pieces: list[bytes], name: np.ndarray, done: list) -> None:
        """Merge rounds over one padded matrix, flat: cell r * w + c is token c of
        row r. ``after``/``before`` link the cells still in use, so a merge costs
        the same wherever it happens; rows that are done are compacted away."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, w = len(pieces), int(size.max()) + 1  # a blank column ends each row
        ids = np.full((n, w), -1, np.int32)
        ids[np.arange(w) < size[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, w), NONE, np.int32)
        both = np.flatnonzero((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0))
        both += both // (w - 1)
        flat = ids.ravel()
        rank.ravel()[both] = self.pairs.find(flat[both], flat[both + 1])[0]
        after = np.tile(np.arange(1, w + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, w - 1, dtype=np.int16), (n, 1))
        while True:
            at = rank.argmin(1)
            cell = np.arange(len(name)) * w + at
            live = rank.ravel()[cell] != NONE
            if not live.all():
                over = ids[~live]
                used = over >= 0
                done.append((name[~live], used.sum(1), over[used]))
                ids, rank, after, before, name, at = ids[live], rank[live], after[live], before[live], name[live], at[live]
                if not len(name):
                    return
                cell = np.arange(len(name)) * w + at
            base = cell - at
            i, r, nx, pv = ids.ravel(), rank.ravel(), after.ravel(), before.ravel()
            gone = base + nx[cell]
            i[cell] = self.pairs.find(i[cell], i[gone])[1]
            i[gone] = -1
            r[gone] = NONE
            nx[cell] = nx[gone]
            end = base + nx[cell]
            pv[end] = at  # the blank column takes links past the end
            right = i[end]
            ok = right >= 0
            r[cell] = NONE
            r[cell[ok]] = self.pairs.find(i[cell[ok]], right[ok])[0]
            ok = pv[cell] >= 0
            c = base[ok] + pv[cell[ok]]
            r[c] = self.pairs.find(i[c], i[cell[ok]])[0]

    def _on_heap(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: linked list and heap of (rank, place)."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, new = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), new.tolist(), strict=True)) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if x >= 0 and y < n:
                    pair = (ids[x], ids[y])
                    if pair not in known:
                        r, q = self.pairs.find(np.array(pair[:1]), np.array(pair[1:]))
                        known[pair] = int(r[0]), int(q[0])
                    r, q = known[pair]
                    if r != NONE:
                        heapq.heappush(heap, (r, x, *pair, q))
        return np.array([x for x in ids if x >= 0], np.int32)


class Ragged:
    """Byte strings in one buffer, joined by index without a Python loop."""

    def __init__(self, items: list[bytes]):
        self.blob = np.frombuffer(b"".join(items) or b"\0", np.uint8)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.at = np.cumsum(self.size) - self.size

    def join(self, index: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The chosen items one after another, and where each ends."""
        size = self.size[index]
        ends = np.cumsum(size)
        shift = np.repeat(self.at[index] - (ends - size), size)
        return self.blob[np.arange(len(shift)) + shift].tobytes(), ends


@cache
def classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    table = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    code = lambda i: i if i < 0xD800 else i + 0x800
    for k, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[code(m.start()) : code(m.end() - 1) + 1] = k
    return table


def cut(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Pieces of UTF-8 texts by the GPT-2 pattern, and the number of each text."""
    text = [t.decode("utf-8") for t in texts]
    cp = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return [], np.zeros(len(texts), np.int64)
    size = np.fromiter(map(len, text), np.int64, len(text))
    begins = np.zeros(n + 1, bool)
    begins[np.cumsum(size) - size] = True
    begins[n] = True
    kind = classes()[cp]
    run = np.empty(n + 1, bool)
    run[0] = run[n] = True
    run[1:n] = kind[1:] != kind[:-1]
    run |= begins
    at = np.flatnonzero(run)
    lo, hi = at[:-1], at[1:]
    k = kind[lo]
    start = np.zeros(n + 1, bool)
    start[n] = True
    start[lo] = True
    # of blanks before something else in the same text, the last stands apart
    gap = (k == 0) & ~begins[hi]
    start[hi[gap] - 1] = True
    # and joins what follows if it is the space
    joined = np.zeros(len(lo), bool)
    joined[1:] = gap[:-1] & (cp[lo[1:] - 1] == 32)
    start[lo[joined]] = False
    # contractions: a lone apostrophe that nothing joins, then letters
    tick = np.flatnonzero((k[:-1] == 3) & (hi[:-1] - lo[:-1] == 1) & (cp[lo[:-1]] == 39) & ~joined[:-1] & (k[1:] == 1) & ~begins[hi[:-1]])
    if len(tick):
        b, e = lo[tick + 1], hi[tick + 1]
        one, two = cp[b], np.where(e - b > 1, cp[np.minimum(b + 1, n - 1)], 0)
        is_ = lambda s: (one == ord(s[0])) & (two == ord(s[1]))
        short = np.isin(one, [ord(c) for c in "stmd"])
        length = np.where(short, 1, np.where(is_("re") | is_("ve") | is_("ll"), 2, 0))
        b, length = b[length > 0], length[length > 0]
        start[b] = False
        start[b + length] = True
    wide = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(wide)])
    where = np.flatnonzero(start)
    raw = b"".join(texts)
    edges = byte_at[where].tolist()
    pieces = [raw[a:b] for a, b in zip(edges, edges[1:])]  # noqa: B905
    ends = np.concatenate([[0], np.cumsum(size)])
    return pieces, np.diff(np.searchsorted(where, ends))


class Numbers(dict):
    """Numbers keys in order of first use; ``fresh`` has the new ones."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Encoder:
    """Encodes texts, remembering the ids of distinct pieces up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.place = Numbers()
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of each text."""
        if len(self.place) > REMEMBERED:
            self._forget()
        pieces, count = cut(texts)
        index = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
        if self.place.fresh:
            flat, size = self.v.encode_pieces(self.place.fresh)
            self.place.fresh = []
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
            self.ids = np.concatenate([self.ids, flat])
            self.size = np.concatenate([self.size, size])
        size = self.size[index]
        ends = np.cumsum(size)
        shift = np.repeat(self.at[index] - (ends - size), size)
        ids = self.ids[np.arange(len(shift)) + shift]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        return ids, np.diff(upto)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per vocabulary file and Python worker."""
    return Encoder(Vocabulary.from_merges(path) if path.endswith(".json") else Vocabulary.from_ranks(path))


def decode(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Bytes of each run of ids; ``count`` has their lengths."""
    raw, ends = v.bytes_.join(ids)
    edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def encode_documents(documents: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``documents`` with the array column ``ids``, which replaces one of that name; a
    null text gives no tokens."""
    rows = documents.select(packed(documents))
    schema = T.StructType([*rows.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part, texts in slices(with_field(batches, text), "text"):
            flat, count = e.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=schema.names)

    return rows.mapInArrow(run, schema).select(*unpacked(documents.columns, ids))


def decode_documents(documents: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``documents`` with the bytes of the array column ``ids`` (null: empty) as ``out``,
    which replaces a column of that name."""
    rows = documents.select(packed(documents))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(path).v
        for b in with_field(batches, ids, "ids"):
            lists = b.column(1)
            count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            raw = decode(v, np.asarray(pc.list_flatten(lists), np.int64), count)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema).select(*unpacked(documents.columns, out))


def token_digests(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, digest of the ids, digest of the decoded ids.

    One pass without a shuffle, over parts of bounded size. A null text is empty
    (0 tokens); null ids and repeated rows pass through row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part, texts in slices(batches, "text"):
            flat, count = e.encode(texts)
            joined, ends = e.v.decimal.join(flat)
            edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
            ids = [sha(joined[a : max(a, b - 1)]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            back = [sha(x) for x in decode(e.v, flat, count)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    few = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
