"""Best-fit packing of token pieces into sequences of bounded length.

Pieces of one length are alike, so best-fit decreasing runs on their counts: a
segment tree over remaining capacities finds the tightest open bin for a piece
in logarithmic time, and runs of equal pieces and bins are placed at once. The
placements tell each piece, by its rank among those of its length, its bin and
offset. What the driver holds is bounded by the capacity, not by the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import encoder
from .storage import materialize
from .words import slices

END = 2


class CapacityTree:
    """Segment tree over remaining capacities 0..top: how many bins are open at each."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.leaves
        while i:
            self.open[i] += bins
            i //= 2

    def tightest(self, size: int) -> int | None:
        """Least capacity of at least ``size`` with an open bin."""
        i = size + self.leaves
        if self.open[i]:
            return size
        while i > 1:  # up to the first right sibling with an open bin, then down to its left
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, end rank, first bin, pieces per bin, offset).

    Rank r of a length lies in bin first bin + (r - first rank) // per bin. The
    result is that of placing pieces one by one, longest first, each in the
    tightest bin that takes it: a bin that has taken a piece and still takes one
    of the same length is then the tightest itself.
    """
    tree, at = CapacityTree(capacity), {}  # at: capacity -> [(first bin, bins)]
    out, bins = [], 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            at.setdefault(free, []).append((first, n))
            tree.add(free, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            free = tree.tightest(length)
            if free is None:
                free = capacity
                each = free // length
                put(free, bins, -(-left // each))
                bins += -(-left // each)
            first, n = at[free].pop()
            tree.add(free, -n)
            each = free // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - free))
                put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:
                out.append((length, rank, rank + left, first + full, left, capacity - free))
                put(free - left * length, first + full, 1)
                rank, full, left = rank + left, full + 1, 0
            put(free, first + full, n - full)
            if not at[free]:
                del at[free]
    return out


@cache
def special_pattern(path: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """Added tokens of a tokenizer file, found in texts as the library finds them."""
    import json

    with open(path, encoding="utf-8") as f:
        added = {t["content"].encode(): t["id"] for t in json.load(f).get("added_tokens", [])}
    names = sorted(added, key=len, reverse=True)
    return (re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None), added


def token_ids(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Ids of each text, special strings as their tokens."""
    pattern, added = special_pattern(path)
    parts = [pattern.split(t) if pattern and pattern.search(t) else [t] for t in texts]
    flat, count = encoder(path).encode([x for p in parts for x in p[::2]])
    ends = np.cumsum(count).tolist()
    out, k, at = [], 0, 0
    for p in parts:
        own = []
        for j, x in enumerate(p):
            if j % 2:
                own.append(np.array([added[x]], np.int32))
            else:
                own.append(flat[at : ends[k]])
                at, k = ends[k], k + 1
        out.append(own[0] if len(own) == 1 else np.concatenate(own))
    return out


def pieces(documents: DataFrame, path: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece of ``documents`` (doc_id, text), with its rank among the
    pieces of its length in the same partition (part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part, texts in slices(batches, "text"):
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), token_ids(texts, path), strict=True):
                ids = np.append(ids, END).astype("<u4")
                n = len(ids)
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905
                    own = ids[a:b]
                    rows.append((doc, k, a, b - a, zlib.crc32(own.tobytes()), part_id, int(seen[b - a]), own.view(np.int32) if keep_ids else None))
                    seen[b - a] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    kind = documents.schema["doc_id"].dataType.simpleString()
    arrow = to_arrow_type(documents.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", arrow), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("token_ids", pa.list_(pa.int32()))])
    return documents.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long, token_ids array<int>")


def pack(documents: DataFrame, path: str, capacity: int = 1024, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all ``documents`` with sequence_id and offset (and token_ids).

    A document is its ids and then the end id; one longer than ``capacity`` is cut
    into pieces of ``capacity``, the first of which may be shorter. A null text
    is empty, so its piece is the end id alone; null ids and repeated rows are
    packed like any other; an empty table gives no sequences. sequence_ids run
    from 0 without gaps.
    """
    few = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    p = materialize(pieces(few, path, capacity, keep_ids), "pieces")
    counts = p.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    counts = counts.select("part", "length", before.alias("before"))
    total = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    placed = best_fit_decreasing(total, capacity)
    schema = "length long, lo long, hi long, first long, each long, base long"
    cols = list(zip(*placed, strict=True)) or [[]] * 6
    names = [c.split()[0] for c in schema.split(", ")]
    places = documents.sparkSession.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)}), schema)
    r = p.join(counts, ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    # the placements' number is bounded by the capacity alone
    r = r.join(F.broadcast(places), (r["length"] == places["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(places["length"])
    nth = F.col("rank") - F.col("lo")
    out = r.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.expr("(rank - lo) div each")).alias("sequence_id"), (F.col("base") + F.pmod(nth, F.col("each")) * F.col("length")).alias("offset"), "token_ids")
    return out if keep_ids else out.drop("token_ids")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, token_ids) from ``pack(..., keep_ids=True)``; a group has
    ``capacity`` tokens at most."""
    own = F.sort_array(F.collect_list(F.struct("offset", "token_ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda x: x["token_ids"])).alias("token_ids"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer())


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, _tokenizer())
