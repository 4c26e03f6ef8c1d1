"""Exact top-k inner products: norm order, rotated partial sums, residual bounds.

Vectors of whole numbers are processed by falling length. An SVD rotation moves
most of their mass into the first coordinates, so a partial sum and the product
of the remaining lengths (Cauchy-Schwarz) bound a score; only pairs whose bound
reaches the query's k-th best score are computed in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize

#: Components are floor(SCALE * x), whole numbers that a double holds exactly.
SCALE = 1024.0
#: Queries of a block, vectors of a range of lengths, and vectors compared at once.
BLOCK, RANGE, STEP = 4_096, 8_192, 2_048


def whole_vectors(batch: pa.RecordBatch, component: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimensions: (ids, integer components as doubles)} of the rows that take part."""
    ids, lists = batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index(component))
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    flat = np.asarray(pc.list_flatten(lists).cast(pa.float64()).fill_null(np.nan))
    ok = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    ids = np.asarray(ids.fill_null(0), np.int64)
    at = np.cumsum(size) - size
    out = {}
    for d in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == d))
        with np.errstate(over="ignore"):
            x = np.floor(SCALE * flat[at[rows][:, None] + np.arange(d)]).reshape(len(rows), d)
        good = np.isfinite(x).all(1)
        out[d] = ids[rows[good]], x[good]
    return out


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows; beyond a long they stop at its ends."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(x, y, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, e)) for e in exact], np.int64)


class Best:
    """The k best (score, id) of each query."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.filled = np.zeros(queries, np.int64)
        self.floor = floor  # a score that k vectors are known to reach

    def least(self) -> np.ndarray:
        own = np.where(self.filled >= self.k, self.score[:, -1].astype(float), -np.inf)
        return np.maximum(own, self.floor)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(q, kind="stable")
        q, score, ids = q[order], score[order], ids[order]
        edge = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        for a, b in zip(edge, np.append(edge[1:], len(q)), strict=True):
            i, n = q[a], min(self.k, self.filled[q[a]])
            s, v = np.concatenate([self.score[i, :n], score[a:b]]), np.concatenate([self.id[i, :n], ids[a:b]])
            top = np.lexsort((v, -s))[: self.k] if s.min() > np.iinfo(np.int64).min else np.array(sorted(range(len(s)), key=lambda j: (-int(s[j]), v[j]))[: self.k])
            self.score[i, : len(top)], self.id[i, : len(top)] = s[top], v[top]
            self.filled[i] = len(top)


def scan(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, best: Best) -> None:
    """Put the vectors ``x`` into ``best``, longest first. Bounds that overflow keep
    their pairs."""
    d = x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(1))
        order = np.lexsort((ids, -norm))
        ids, x, norm = ids[order], x[order], norm[order]
        q_norm = np.sqrt((q * q).sum(1))
        q_turned = q @ rotation
        cuts = sorted({max(1, d // 8), max(1, d // 3)})
        for at in range(0, len(x), STEP):
            part, n = slice(at, at + STEP), norm[at : at + STEP]
            slack = 1e-9 * n[0] * q_norm + 1e-6
            live = np.flatnonzero(~(n[0] * q_norm + slack < best.least()))
            if not len(live):
                return  # what follows is shorter still
            turned = x[part] @ rotation
            least = best.least()[live] - slack[live]
            ok = ~(n[:, None] * q_norm[live][None, :] < least[None, :])
            for c in cuts:
                rest = np.sqrt(np.maximum(0, (turned[:, c:] ** 2).sum(1)))[:, None] * np.sqrt(np.maximum(0, (q_turned[live, c:] ** 2).sum(1)))[None, :]
                ok &= ~(turned[:, :c] @ q_turned[live, :c].T + rest < least[None, :])
            i, j = np.nonzero(ok)
            own = ids[part][i] != q_ids[live[j]]
            i, j = i[own], live[j[own]]
            for k in range(0, len(i), 1 << 17):
                a, b = i[k : k + (1 << 17)], j[k : k + (1 << 17)]
                if len(a):
                    best.add(b, dots(x[part][a], q[b]), ids[part][a])


def _gram(component: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, (_, x) in whole_vectors(b, component).items():
                y = x / max(1.0, float(np.abs(x).max(initial=1)))  # only directions matter
                sums[d] = sums.get(d, 0) + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], names=["d", "gram"])

    return run


def rotations(vectors: DataFrame, component: str) -> dict[int, np.ndarray]:
    """Per number of dimensions, right singular vectors of all vectors by falling
    singular value, from d * d sums."""
    g = vectors.mapInArrow(_gram(component), "d int, gram array<double>").select("d", F.posexplode("gram").alias("i", "x"))
    out: dict[int, list] = {}
    for r in g.groupBy("d", "i").agg(F.sum("x").alias("x")).collect():  # d * d numbers
        out.setdefault(r["d"], []).append((r["i"], r["x"]))
    turned = {}
    for d, cells in out.items():
        m = np.zeros(d * d)
        m[[i for i, _ in cells]] = [x for _, x in cells]
        turned[d] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() if d else np.zeros((0, 0))
    return turned


RANGES = "g int, d int, ids binary, x binary"
BLOCKS = "block string, d int, ids binary, x binary, floor binary"
FOUND = "block string, d int, row int, query_id long, vec_id long, score long"
_doubles = lambda r, d: np.frombuffer(r, float).reshape(-1, d) if d else np.zeros((0, 0))


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, ids, vectors) of up to ``most`` rows that take part."""
    held: dict[int, list] = {}

    def take(d):
        pairs = held.pop(d)
        ids, x = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        for at in range(0, len(ids), most):
            yield d, ids[at : at + most], x[at : at + most]

    for b in batches:
        for d, pair in whole_vectors(b, "component").items():
            held.setdefault(d, []).append(pair)
            if sum(len(p[0]) for p in held[d]) >= most:
                yield from take(d)
    for d in sorted(held):
        yield from take(d)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g = TaskContext.get().partitionId()
    for d, ids, x in _parts(batches, STEP):
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([d], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["g", "d", "ids", "x"])


def _blocks(tops: list, turned: dict[int, np.ndarray], k: int):
    """Packed queries with a score that k of the longest vectors are known to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (d, ids, x) in enumerate(_parts(batches, BLOCK)):
            first = Best(len(ids), k, np.full(len(ids), -np.inf))
            for t in tops:
                if d in t and len(ids):
                    scan(*t[d], ids, x, turned[d], first)
            cells = [pa.array([f"{part}-{n}"]), pa.array([d], pa.int32()), *(pa.array([c.tobytes()]) for c in (ids, x, first.least()))]
            yield pa.RecordBatch.from_arrays(cells, names=["block", "d", "ids", "x", "floor"])

    return run


def _meet(turned: dict[int, np.ndarray], k: int):
    """The k best of a block's queries in one range of lengths."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for q in queries.to_pylist():
            d = q["d"]
            ids = np.frombuffer(q["ids"], np.int64)
            best = Best(len(ids), k, np.frombuffer(q["floor"], float))
            own = [r for r in vectors.to_pylist() if r["d"] == d]
            if own:
                v_ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in own])
                scan(v_ids, np.concatenate([_doubles(r["x"], d) for r in own]).reshape(len(v_ids), d), ids, _doubles(q["x"], d).reshape(len(ids), d), turned[d], best)
            r, c = np.nonzero(np.arange(k) < best.filled[:, None])
            n = len(r)
            out.append(pa.table({"block": pa.array([q["block"]] * n, pa.string()), "d": pa.array(np.full(n, d), pa.int32()), "row": pa.array(r, pa.int32()), "query_id": ids[r], "vec_id": best.id[r, c], "score": best.score[r, c]}))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], pa.schema([("block", pa.string()), ("d", pa.int32()), ("row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", component: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best inner products.

    Components count as floor(1024 * x), scores are exact integers (beyond a long they
    stop at its ends); equal scores go to the smaller id, a query's own id is no
    candidate. Rows with a null id, a null vector, or null or non-finite components
    (as scaled) take no part; vectors of other dimensions than the query's are no
    candidates. Repeated rows are candidates and queries once each.

    All vectors are dealt into ranges of falling length, the queries into blocks; a
    task compares one block with one range, so memory is bounded, and the driver holds
    no more than one rotation and ``STEP`` of the longest vectors.
    """
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{component}`").alias("component"))
    q = queries.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{component}`").alias("component")).filter("vec_id IS NOT NULL")
    turned = rotations(v, "component")
    size = F.aggregate("component", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("size")
    sized = v.select("vec_id", "component", size).filter("vec_id IS NOT NULL AND size IS NOT NULL")
    # k of the longest vectors of all give each query a first bound
    longest = sized.filter(F.col("size") < float("inf")).orderBy(F.col("size").desc(), "vec_id").limit(STEP).toArrow()
    tops = [whole_vectors(b, "component") for b in longest.combine_chunks().to_batches()]
    many = max(1, -(-sized.count() // RANGE))
    spread = sized.repartitionByRange(many, F.col("size").desc(), "vec_id").sortWithinPartitions(F.col("size").desc(), "vec_id")
    ranges = materialize(spread.select("vec_id", "component").mapInArrow(_ranges, RANGES), "topk-ranges")
    blocks = materialize(q.mapInArrow(_blocks(tops, turned, k), BLOCKS), "topk-blocks")
    # a block per scan task may be small: several share a cell up to BLOCK queries
    cells = max(1, -(-q.count() // BLOCK))
    last = ranges.agg(F.max("g")).head()[0] or 0
    left = ranges.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    right = blocks.withColumn("b", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(last))))
    met = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(_meet(turned, k), FOUND)
    w = W.partitionBy("block", "row", "query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(v, v.filter("vec_id % 100 = 0"), k=10)


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
