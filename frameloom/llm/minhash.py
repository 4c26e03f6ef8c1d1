"""MinHash near-duplicates: universal hash minima, bands, verification, components.

Texts with the same shingle set form one class. Classes meet in buckets of equal
signature bands; the signatures choose which pairs are confirmed on full sets,
and alternating large-star and small-star turns links into components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialize
from .words import Words, grams, mix, slices, stream


@dataclass(frozen=True)
class Near:
    """``share`` percent of the union must be common. A pair at that similarity
    misses all ``bands`` of ``rows`` minima with probability below 1e-6, and its
    signatures agree on fewer than ``margin`` percent of all minima as rarely."""

    shingle: int = 5
    share: int = 80
    rows: int = 6
    bands: int = 48
    margin: int = 68

    @property
    def minima(self) -> int:
        return self.rows * self.bands


#: Rows of one bucket that are compared in one task; larger ones go in blocks.
BLOCK = 1024


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text (A-Z lowered).
    A text with fewer words, but one at least, has its whole sequence as one."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = grams(h, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a, seed=100 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], minima: int) -> np.ndarray:
    """Minima of ``minima`` universal hash functions for sets that aren't empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    x = (mix(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum(size) - size
    a = (stream(minima, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (stream(minima, 22) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), minima), np.uint32)
    # about a cache's worth of shingles at a time; whole sets
    k = 0
    while k < len(sets):
        e = max(k + 1, int(np.searchsorted(at, at[k] + 65_536)))
        part, base = x[at[k] : at[e - 1] + size[e - 1]], at[k:e] - at[k]
        for j in range(minima):
            out[k:e, j] = np.minimum.reduceat(part * a[j] + b[j], base)
        k = e
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def band_keys(short: np.ndarray, p: Near) -> np.ndarray:
    """A hash for each band of 16-bit minima, which depends on the band's number."""
    odd = stream(p.rows, 31)
    wide = short.reshape(len(short), p.bands, p.rows).astype(np.uint64)
    band = np.zeros(wide.shape[:2], np.uint64)
    for j in range(p.rows):
        band += mix(wide[:, :, j] + odd[j]) * odd[j]
    return mix(band + stream(p.bands, 32)).view(np.int64)


def signed(documents: DataFrame, p: Near) -> DataFrame:
    """(doc_id, key, n_shingles, node, sig) of ``documents`` (doc_id, key, text): node
    is the digest of the shingle set, sig has 16 bits of each minimum; null where the
    set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            sets = shingle_sets(texts, p.shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            node, sig = ([None] * len(sets) for _ in range(2))
            if full:
                m = signatures([sets[i] for i in full], p.minima)
                short = m.astype(np.uint16)  # the low bits, which are all used
                for k, i in enumerate(full):
                    node[i], sig[i] = digest(sets[i]), short[k].tobytes()
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), size, pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "key", "n_shingles", "node", "sig"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(run, f"doc_id {kind}, key long, n_shingles long, node binary, sig binary")


def banded(classes: DataFrame, p: Near) -> DataFrame:
    """(key, node): one row per band of each class (node, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, -1), p)
                at = pa.array(np.repeat(np.arange(b.num_rows), p.bands))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(at)], names=["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node binary")


def _by_bucket(members: DataFrame, handle: Callable, schema: str) -> DataFrame:
    """Rows that ``handle(key, block, columns)`` lists for each (key, block), whose
    rows are together; one bucket is in memory at a time."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []

        def batch():
            cols = list(zip(*out, strict=True)) or [[]] * len(fields)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

        def flush():
            if len(group) > 1:
                out.extend(handle(*now, list(zip(*group, strict=True))))
            group.clear()

        for b in batches:
            key, block, *rest = (c.to_pylist() for c in b.columns)
            for k, *row in zip(zip(key, block, strict=True), *rest, strict=True):
                if k != now:
                    flush()
                    now = k
                    if len(out) > 20_000:
                        yield batch()
                group.append(row)
        flush()
        yield batch()

    return members.mapInArrow(run, schema)


def _agreeing(m: np.ndarray, first: np.ndarray, second: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of ``first``, row of ``second``, equal minima) where that many are equal."""
    for at in range(0, len(first), 64):
        rows = first[at : at + 64]
        same = np.zeros((len(rows), len(second)), np.int32)
        for c in range(0, m.shape[1], 64):
            same += (m[rows, None, c : c + 64] == m[None, second, c : c + 64]).sum(2, dtype=np.int32)
        i, j = np.nonzero((same >= least) & (rows[:, None] != second[None, :]))
        yield rows[i], second[j], same[i, j]


def _closest(members: DataFrame, p: Near) -> DataFrame:
    """(a, b, same, hub): each member's closest partner in its block and the one with
    the most partners, ``hub``. ``members``: key, block, node, sig."""
    least = -(-p.margin * p.minima // 100)

    def handle(key, block, columns):
        node, sig = columns
        every = np.arange(len(node))
        m = np.frombuffer(b"".join(sig), np.uint16).reshape(len(node), -1)
        found = list(_agreeing(m, every, every, least))
        i, j, s = (np.concatenate([f[k] for f in found]) for k in range(3))
        degree = np.bincount(i, minlength=len(node))
        for score in (s, degree[j]):
            order = np.lexsort((score, i))
            for x in order[np.append(i[order][1:] != i[order][:-1], True)] if len(i) else ():
                yield node[i[x]], node[j[x]], int(s[x]), int(degree[j[x]])

    return _by_bucket(members, handle, "a binary, b binary, same int, hub int")


def _contacts(members: DataFrame, p: Near) -> DataFrame:
    """(key, block, ord, node, comp, partners): members with pairs across components
    whose signatures agree on the margin; ``partners`` packs the ords of a member's
    partners. A pair counts in the first band that it shares.

    ``members``: key, block, side, node, sig, comp; side is 2 if both ends of a pair
    are of this block, else pairs have one end of side 0 and one of side 1.
    """
    least = -(-p.margin * p.minima // 100)

    def handle(key, block, columns):
        side, node, sig, comp = columns
        label = np.unique(np.array(comp, object), return_inverse=True)[1]
        if label.max() == 0:
            return
        side = np.array(side)
        m = np.frombuffer(b"".join(sig), np.uint16).reshape(len(node), -1)
        band = int((band_keys(m[:1], p)[0] == key).argmax())
        kept = []
        for i, j, _ in _agreeing(m, np.flatnonzero(side != 1), np.flatnonzero(side != 0), least):
            across = (label[i] != label[j]) & ((i < j) | (side[i] != side[j]))
            i, j = i[across], j[across]
            shared = (m[i] == m[j]).reshape(len(i), p.bands, p.rows).all(2)
            once = shared.argmax(1) == band
            kept.append((i[once], j[once]))
        i, j = (np.concatenate([k[x] for k in kept]) for x in (0, 1))
        used, order = np.unique(np.concatenate([i, j])), np.argsort(i, kind="stable")
        i, j = np.searchsorted(used, i[order]), np.searchsorted(used, j[order]).astype(np.int32)
        edge = np.searchsorted(i, np.arange(len(used) + 1))
        for n, x in enumerate(used.tolist()):
            yield key, block, n, node[x], comp[x], j[edge[n] : edge[n + 1]].tobytes()

    return _by_bucket(members, handle, "key long, block int, ord int, node binary, comp binary, partners binary")


def _forest(contacts: DataFrame, sets: DataFrame, p: Near) -> DataFrame:
    """Links (a, b) between components, confirmed on full sets: in each block every
    pair of contacts is compared unless links found before connect its ends, and
    those links form a spanning forest, fewer than the block's members."""

    def handle(key, block, columns):
        node, comp, partners, packed = columns
        sets = [np.frombuffer(x, np.uint64) for x in packed]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
        mark = np.zeros(int(size.sum()), bool)
        label = np.unique(np.array(comp, object), return_inverse=True)[1]
        for i, own in enumerate(partners):
            js = np.frombuffer(own, np.int32)
            js = js[label[js] != label[i]]
            mark[ids[i]] = True
            for at in range(0, len(js), 256):
                part = js[at : at + 256]
                begin = np.cumsum(size[part]) - size[part]
                both = np.add.reduceat(mark[np.concatenate([ids[j] for j in part])], begin, dtype=np.int64)
                for j in part[100 * both >= p.share * (size[i] + size[part] - both)].tolist():
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        yield node[i], node[j]
            mark[ids[i]] = False

    joined = contacts.join(sets, "node").select("key", "block", "ord", "node", "comp", "partners", "set")
    ordered = joined.repartition("key", "block").sortWithinPartitions("key", "block", "ord").drop("ord")
    return _by_bucket(ordered, handle, "a binary, b binary")


def _own_blocks(members: DataFrame) -> DataFrame:
    """Rows of (key, node, n, lo) in blocks of their bucket; the bucket's least
    member is in all of them, so that blocks meet."""
    n = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    m = members.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.when(F.col("node") == F.col("lo"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    return m.select("key", F.explode(every).alias("block"), "node")


def _block_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (key, node, comp) of large buckets once for each pair of blocks they belong to."""
    m = members.join(sizes, "key")
    n = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    m = m.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    low, high = F.least(F.col("own"), F.col("j")), F.greatest(F.col("own"), F.col("j"))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.select("key", (low * F.col("blocks") + high).alias("block"),
                    F.when(low == high, F.lit(2)).when(F.col("own") == low, F.lit(0)).otherwise(F.lit(1)).alias("side"), "node", "comp")


def _together(members: DataFrame) -> DataFrame:
    return members.repartition("key", "block").sortWithinPartitions("key", "block")


def _confirm(pairs: DataFrame, sets: DataFrame, p: Near) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(u) + len(v) - len(np.unique(np.concatenate([u, v])))
                keep.append(100 * both >= p.share * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a binary, b binary")


def _sets(documents: DataFrame, reps: DataFrame, p: Near) -> DataFrame:
    """(node, set) of the classes in ``reps`` (node, doc_id, key), from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            sets = shingle_sets(texts, p.shingle)
            ok = [n == digest(s) for n, s in zip(part.column(0).to_pylist(), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), pa.array([s.tobytes() for s, k in zip(sets, ok, strict=True) if k], pa.binary())], names=["node", "set"])

    wanted = reps.select("node", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    met = documents.join(wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return met.select("node", "text").mapInArrow(run, "node binary, set binary").dropDuplicates(["node"])


def near_duplicates(documents: DataFrame, p: Near = Near(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= share * union of their
    shingle sets, confirmed on full sets; component_id is the smallest doc_id
    reachable. A null or wordless text has an empty set, links with nothing and
    is its own component. A row with a null id counts in links but cannot name a
    component, and is kept only if its component has no id at all (then null).
    Repeated rows are equal texts: all have the same component; each is a row of
    the result, and kept is true for every row whose id is the component's.

    Every candidate pair is in one of two rounds. First, each class takes its
    closest partner and its best connected one in any bucket; the links confirmed
    give components. Then, in buckets that still hold several components, every
    pair across components whose signatures agree on the margin is compared on full
    sets by the task that holds the bucket, which reports the links that connect.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    s = materialize(signed(docs, p), "minhash-signed")
    # equal sets have equal signatures; the least id, if any, stands for its class
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    firsts = s.filter("node IS NOT NULL").groupBy("node").agg(rep, F.first("sig").alias("sig"))
    firsts = materialize(firsts.select("node", "rep.doc_id", "rep.key", "sig"), "minhash-classes")
    spread = banded(firsts, p)
    sizes = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo")).filter("n > 1")
    members = materialize(spread.join(sizes, "key"), "minhash-members")
    sig = firsts.select("node", "sig")

    found = _closest(_together(_own_blocks(members).join(sig, "node").select("key", "block", "node", "sig")), p)
    by = lambda c: F.max_by(F.struct("a", "b"), F.struct(F.col(c), "same", "b"))
    best = found.groupBy("a").agg(by("same").alias("x"), by("hub").alias("y"))
    best = best.select(F.explode(F.array("x", "y")).alias("p"))
    pairs = materialize(best.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct(), "minhash-pairs")
    reps = firsts.select("node", "doc_id", "key")
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = materialize(_confirm(pairs, _sets(docs, reps.join(need, "node", "left_semi"), p), p), "minhash-links")
    comp = materialize(connected_components(links), "minhash-components")

    labelled = members.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", "n")
    rest = _block_pairs(labelled, mixed).join(sig, "node").select("key", "block", "side", "node", "sig", "comp")
    contacts = materialize(_contacts(_together(rest), p), "minhash-contacts")
    need = contacts.select("node").distinct()
    extra = materialize(_forest(contacts, _sets(docs, reps.join(need, "node", "left_semi"), p), p), "minhash-links")
    discard(members, pairs, contacts)
    if not extra.isEmpty():
        comp = materialize(connected_components(links.unionByName(extra)), "minhash-components")

    of = reps.join(comp, "node", "left").select("node", F.col("doc_id").alias("rep"), F.coalesce("component", "node").alias("comp"))
    least = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = of.join(least, "comp").select("node", "component_id")
    out = s.select("doc_id", "n_shingles", "node").filter("node IS NOT NULL").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = s.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Limits of the query's contract: three words, similarity 0.85.
CONTRACT = Near(shingle=3, share=85, rows=8, bands=48, margin=76)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), CONTRACT)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates stays.

    Documents with a null id stay; of rows with one id and text, one stays."""
    verdict = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    stays = docs.select(row).join(verdict, F.col("row.doc_id").eqNullSafe(F.col("_id")), "left_semi").select("row.*")
    named = stays.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return named.unionByName(stays.filter("doc_id IS NULL"))
