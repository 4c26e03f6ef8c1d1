"""Substring dedup: word windows that also occur in an earlier document.

A window's anchor is the least of its word m-grams, so equal windows have equal
anchors. Consecutive windows with one anchor form a segment, and segments go to
shards by anchor. A chunk of documents sends each of its distinct segments once;
of those that share an anchor with another document, one copy each becomes the
text of the shard's compressed FM-index. All of them are then streamed against it:
backward search gives their matching statistics up to the window, and the least
document that holds each window. What it finds goes back to every occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .rows import packed, replaced, unpacked, with_field
from .storage import discard, materialize, shard_count
from .words import Words, grams, mix, slices, stream

ANCHOR = 5
#: Text whose segments a task holds before it hands them on.
HELD = 12 << 20

_pack = lambda a: zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())
_unpack = lambda b, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def segments(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, first word in it, words, anchor, digest) of every segment."""
    m = min(ANCHOR, window)
    g = grams(h, m, seed=5)
    span = window - m + 1
    total = len(g) - span + 1
    none = np.zeros(0, np.int64)
    if total <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    value = mix(g)
    best, off = value[:total].copy(), np.zeros(total, np.int32)
    for j in range(1, span):
        less = value[j : j + total] < best
        best[less] = value[j : j + total][less]
        off[less] = j
    doc = np.repeat(np.arange(len(w.count)), w.count)
    p = np.flatnonzero(doc[:total] == doc[window - 1 : window - 1 + total])
    if not len(p):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at, d = p + off[p], doc[p]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])))
    start, last = p[new], p[np.append(new[1:], len(p)) - 1]
    size = last - start + window
    anchor = g[at[new]]
    digest = (size + (at[new] - start) * 65_536).astype(np.uint64)
    odd = stream(window + span, 41)
    for j in range(int(size.max())):
        on = np.flatnonzero(size > j)
        digest[on] = mix(digest[on] * odd[j] + h[start[on] + j])
    return d[new], start - w.first[d[new]], size, anchor, digest


def _spread(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if edge[s] < edge[s + 1]:
            yield s, order[edge[s] : edge[s + 1]]


def _batch(fields: list[tuple[str, pa.DataType]], rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


CHUNKS = "chunk string, shard int, ids binary, keys binary, doc binary, start binary, size binary, new binary, edge binary, anchor binary, digest binary, lo binary, hi binary"


def _chunks(shards: int, window: int):
    """Chunks of documents: a row with all segments (shard -1), which stays with the
    chunk, and for each shard the distinct ones with their least and greatest id."""
    fields = _fields(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, docs, size = [], [], 0

        def flush():
            nonlocal held, docs, size, number
            doc, start, many, anchor, digest = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, keys = np.array([x[0] for x in docs], np.int64), np.array([x[1] for x in docs], np.int64)
            held, docs, size = [], [], 0
            shard = (anchor % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((ids[doc], digest, anchor, shard))
            doc, start, many, anchor, digest, shard = (x[order] for x in (doc, start, many, anchor, digest, shard))
            new = _changes(anchor, digest)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(new)) - 1
            edge = np.searchsorted(shard[first], np.arange(shards + 1))
            name = f"{part}-{number}"
            number += 1
            yield _batch(fields, [{"chunk": name, "shard": -1, "ids": _pack(ids), "keys": keys.tobytes(), "doc": _pack(doc.astype(np.uint32)), "start": _pack(start.astype(np.uint32)), "size": _pack(many.astype(np.uint16)), "new": _pack(np.packbits(new)), "edge": _pack(edge)}])
            lo, hi = ids[doc[first]], ids[doc[last]]
            rows = []
            for s in np.flatnonzero(np.diff(edge)).tolist():
                own = slice(edge[s], edge[s + 1])
                rows.append({"chunk": name, "shard": s, "anchor": anchor[first[own]].tobytes(), "digest": digest[first[own]].tobytes(), "lo": _pack(lo[own]), "hi": _pack(hi[own] - lo[own])})
            yield _batch(fields, rows)

        for batch, texts in slices(batches, "text"):
            w = Words(texts)
            d, *rest = segments(w, w.hashes(), window)
            if len(d):
                held.append((d + len(docs), *rest))
            docs += zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            size += sum(map(len, texts))
            if size > HELD and held:
                yield from flush()
        if held:
            yield from flush()

    return run


SHARED = "chunk string, shard int, place binary, kind binary, anchor binary, digest binary"
#: Kinds of shared segments: the copy that stands for all equal ones, and one in several documents.
STANDS, SEVERAL = 2, 4


def _shared(t: pa.Table) -> pa.Table:
    """Of one shard, for each chunk: its segments whose anchor is in several documents."""
    rows = t.to_pylist()
    anchor, digest = (np.concatenate([np.frombuffer(r[k], np.uint64) for r in rows]) for k in ("anchor", "digest"))
    lo = np.concatenate([_unpack(r["lo"], np.int64) for r in rows])
    hi = lo + np.concatenate([_unpack(r["hi"], np.int64) for r in rows])
    size = [len(r["anchor"]) // 8 for r in rows]
    order = np.lexsort((lo, digest, anchor))
    anchor, digest, lo, hi = (x[order] for x in (anchor, digest, lo, hi))
    newa, newd = _changes(anchor), _changes(anchor, digest)

    def several(new: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(new)
        return (np.minimum.reduceat(lo, at) < np.maximum.reduceat(hi, at))[np.cumsum(new) - 1]

    kind = np.zeros(len(order), np.uint8)
    kind[order] = np.where(several(newa), 1 + STANDS * newd + SEVERAL * several(newd), 0)
    out, at = [], 0
    for r, n in zip(rows, size, strict=True):
        own = kind[at : at + n]
        at += n
        place = np.flatnonzero(own)
        if len(place):
            pick = lambda c: np.frombuffer(r[c], np.uint64)[place].tobytes()  # noqa: E731, B023
            out.append({"chunk": r["chunk"], "shard": r["shard"], "place": _pack(place.astype(np.uint32)), "kind": _pack(own[place]), "anchor": pick("anchor"), "digest": pick("digest")})
    return pa.Table.from_pylist(out, schema=pa.schema(_fields(SHARED)))


OCCURRENCES = "doc_id long, key long, start int, size int, anchor long, digest long, stands boolean, several boolean"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for the shared segments of chunks with what the shards said of them."""
    names = [k for k, _ in _fields(OCCURRENCES)]
    for batch in batches:
        for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            doc = _unpack(r["doc"], np.uint32)
            new = np.unpackbits(_unpack(r["new"], np.uint8), count=len(doc)).view(bool)
            entry, edge = np.cumsum(new) - 1, _unpack(r["edge"], np.int64)
            kind = np.zeros(int(edge[-1]), np.uint8)
            anchor, digest = np.zeros((2, len(kind)), np.int64)
            for x in r["shared"]:
                at = edge[x["shard"]] + _unpack(x["place"], np.uint32)
                kind[at] = _unpack(x["kind"], np.uint8)
                anchor[at], digest[at] = np.frombuffer(x["anchor"], np.int64), np.frombuffer(x["digest"], np.int64)
            on = np.flatnonzero(kind[entry])
            doc, e = doc[on], entry[on]
            cols = [_unpack(r["ids"], np.int64)[doc], np.frombuffer(r["keys"], np.int64)[doc], _unpack(r["start"], np.uint32)[on].astype(np.int32), _unpack(r["size"], np.uint16)[on].astype(np.int32)]
            cols += [anchor[e], digest[e], new[on] & (kind[e] & STANDS > 0), kind[e] & SEVERAL > 0]
            for at in range(0, len(on), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in cols], names=names)


TEXTS = "shard int, ids binary, size binary, anchor binary, digest binary, several binary, vocabulary binary, symbols binary"


def _extract(shards: int):
    """Symbols of the segments that stand for all equal ones: (doc_id, text, asked)."""
    fields = _fields(TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            nonlocal held, size
            ids, many, anchor, digest, several, h = (np.concatenate([x[k] for x in held]) for k in range(6))
            held, size = [], 0
            at = np.cumsum(many) - many
            for s, rows in _spread((anchor.view(np.uint64) % np.uint64(shards)).astype(np.int64), shards):
                n = many[rows]
                shift = np.repeat(at[rows] - (np.cumsum(n) - n), n)
                vocabulary, symbols = np.unique(h[np.arange(len(shift)) + shift], return_inverse=True)
                yield _batch(fields, [{"shard": s, "ids": _pack(ids[rows]), "size": _pack(n.astype(np.uint16)), "anchor": anchor[rows].tobytes(), "digest": digest[rows].tobytes(), "several": _pack(several[rows]), "vocabulary": vocabulary.tobytes(), "symbols": _pack(symbols.astype(np.uint32))}])

        for part, texts in slices(batches, "text"):
            w = Words(texts)
            h = w.hashes()
            asked = part.column(2)
            n = np.asarray(pc.list_value_length(asked), np.int64)
            flat = pc.list_flatten(asked)
            start, many, anchor, digest = (np.asarray(pc.struct_field(flat, k), np.int64) for k in range(4))
            several = np.asarray(pc.struct_field(flat, 4).cast(pa.uint8()))
            doc = np.repeat(np.arange(len(n)), n)
            shift = np.repeat(w.first[doc] + start - (np.cumsum(many) - many), many)
            held.append((np.asarray(part.column(0), np.int64)[doc], many, anchor, digest, several, h[np.arange(len(shift)) + shift]))
            size += len(shift) * 8
            if size > HELD:
                yield from flush()
        if held:
            yield from flush()

    return run


RUNS = "anchor long, digest long, offset int, windows int, least long"


def _search(window: int):
    def run(t: pa.Table) -> pa.Table:
        """Of one shard: runs of windows of a segment with the least document of each."""
        rows = t.to_pylist()
        ids, size, several = (np.concatenate([_unpack(r[k], kind) for r in rows]) for k, kind in (("ids", np.int64), ("size", np.uint16), ("several", np.uint8)))
        anchor, digest = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("anchor", "digest"))
        h = np.concatenate([np.frombuffer(r["vocabulary"], np.uint64)[_unpack(r["symbols"], np.uint32)] for r in rows])
        # segments one after another, each with a 0 behind it
        size = size.astype(np.int64)
        symbol = (np.unique(h, return_inverse=True)[1] + 1).astype(np.uint32)
        n = size + 1
        at = np.cumsum(n) - n
        text = np.zeros(int(n.sum()), np.uint32)
        seg = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        text[np.arange(len(text)) != np.repeat(at + size, n)] = symbol
        ranks, rank = np.unique(ids, return_inverse=True)
        index = FMIndex(text, window, rank.astype(np.uint32)[seg])
        many = size - window + 1
        own = np.repeat(np.arange(len(n)), many)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        length, least = index.matching_statistics(text, at[own] + inner + window - 1, window)
        least = ranks[least]
        hit = np.flatnonzero((length >= window) & ((several[own] > 0) | (least < ids[own])))
        # windows that follow each other with one least document give one interval
        o, p, v = own[hit], inner[hit], least[hit]
        new = _changes(o, p - np.arange(len(p)), v)
        head = np.flatnonzero(new)
        run_ = np.diff(np.append(head, len(hit)))
        o = o[head]
        return pa.table({"anchor": anchor[o], "digest": digest[o], "offset": pa.array(p[head], pa.int32()), "windows": pa.array(run_, pa.int32()), "least": v[head]})

    return run


def repeated_intervals(documents: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, start, size) of the word intervals to remove; they overlap.
    ``documents``: doc_id long, text, key (a hash of the text)."""
    shards = shard_count(documents)
    chunks = materialize(documents.select("doc_id", "text", "key").mapInArrow(_chunks(shards, window), CHUNKS), "substring-chunks")
    distinct = chunks.filter("shard >= 0").select("chunk", "shard", "anchor", "digest", "lo", "hi")
    said = distinct.groupBy("shard").applyInArrow(_shared, SHARED)
    said = said.groupBy("chunk").agg(F.collect_list(F.struct("shard", "place", "kind", "anchor", "digest")).alias("shared"))
    whole = chunks.filter("shard < 0").select("chunk", "ids", "keys", "doc", "start", "size", "new", "edge").join(said, "chunk")
    shared = materialize(whole.mapInArrow(_occurrences, OCCURRENCES), "substring-shared")
    discard(chunks)
    asked = shared.filter("stands").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "size", "anchor", "digest", "several")).alias("asked"))
    texts = documents.join(asked, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "text", "asked")
    runs = materialize(texts.mapInArrow(_extract(shards), TEXTS).groupBy("shard").applyInArrow(_search(window), RUNS), "substring-runs")
    met = shared.select("doc_id", "key", "start", "anchor", "digest").join(runs, ["anchor", "digest"]).filter("least < doc_id")
    return met.select("doc_id", "key", (F.col("start") + F.col("offset")).alias("start"), (F.col("windows") + (window - 1)).alias("size"))


def _cut(documents: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    """(row, n_words, n_removed, kept_words, kept_text); the text moves in ``row`` alone."""
    base = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), packed(documents))
    read = base.select("doc_id", F.col("row").getField(text).alias("text"), "key").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    gone = repeated_intervals(read, window)
    gone = materialize(gone.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "size")).alias("gone")), "substring-gone")
    joined = base.join(gone, ["doc_id", "key"], "left").select("row", "gone")
    schema = joined.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept_words", "binary").add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(with_field(batches, text), "text"):
            w = Words(texts)
            words, removed, kept, cut = [], [], [], []
            for i, g in enumerate(part.column(2).to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                own = w.raw[w.start[a] : w.end[b - 1]].split() if b > a else []
                words.append(b - a)
                if not g:
                    removed.append(0)
                    kept.append(b" ".join(own))
                    cut.append(part.column(1)[i].as_py())
                    continue
                mark = np.zeros(b - a + 1, np.int64)
                for x in g:
                    mark[x["start"]] += 1
                    mark[x["start"] + x["size"]] -= 1
                out = np.cumsum(mark)[:-1] > 0
                removed.append(int(out.sum()))
                kept.append(b" ".join([x for x, o in zip(own, out.tolist(), strict=True) if not o]))
                # byte places in the text, each word with the blanks before it
                zero = int(w.start[a]) - (len(texts[i]) - len(texts[i].lstrip()))
                ends = (w.end[a:b] - zero).tolist()
                left = [texts[i][x:y] for x, y, o in zip([0, *ends], ends, out.tolist(), strict=False) if not o]
                cut.append((b"".join(left) + texts[i][ends[-1] :]).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(cut, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)


ADDED = ["n_words", "n_removed", "kept_words", "kept_text"]


def remove_repeats(documents: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with n_words, n_removed, kept_words and kept_text.

    A word goes if a window of ``window`` words (at least 2, at most 30000) covers it
    whose word sequence also starts in a document with a smaller id; windows are
    judged on the input. kept_words joins the kept words with single blanks; kept_text
    is the text without the removed words and the white space before each. Null texts
    have no words (kept_text null); rows with a null id neither lose nor cover
    anything; rows of one id don't affect each other. Ids are cast to long; other
    columns stay, but one with the name of an added column gives way to it. Words are
    compared by 64-bit hashes, segments by pairs of them.
    """
    if not 2 <= window <= 30_000:
        raise ValueError(f"window must be from 2 to 30000, not {window}")
    return _cut(documents, window, doc_id, text).select(*unpacked(documents.columns, *ADDED))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs, 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated passages; n_chars follows the text."""
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return _cut(docs, 13, "doc_id", "text").select(*replaced(docs.columns, **new))
