"""Joins: as-of, overlap, similarity, clip mapping. Equality keys carry every
join, so none is a full cross product of its tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Vectors of a block, and of the part of it that is multiplied at once.
BLOCK, STEP = 4096, 512


def asof_forward(frames: DataFrame, notes: DataFrame, by: str = "stream_id", frame: str = "frame", note_frame: str = "note_frame") -> DataFrame:
    """Each frame with the first annotation at or after it (null if none).

    One union sorted by (stream, frame) and one window: linear in both sides
    whatever the number of annotations of a stream. Of annotations at one frame
    the least struct of their columns is taken. A column of ``notes`` that ``frames``
    has too comes as note_<name>.
    """
    extra = [c for c in notes.columns if c not in (by, note_frame)]
    out = {c: f"note_{c}" if c in frames.columns else c for c in extra}
    n = notes.groupBy(by, note_frame).agg(F.min(F.struct(*extra)).alias("_note") if extra else F.lit(1).alias("_note"))
    row = F.struct(*[F.col(c) for c in frames.columns])
    left = frames.select(by, F.col(frame).alias("_at"), F.lit(0).alias("_kind"), row.alias("_row"))
    right = n.select(by, F.col(note_frame).alias("_at"), F.lit(1).alias("_kind"), F.struct(F.col(note_frame).alias("note_frame"), "_note").alias("_n"))
    both = left.unionByName(right, allowMissingColumns=True)
    w = W.partitionBy(by).orderBy(F.col("_at").desc(), F.col("_kind").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    got = both.withColumn("_n", F.last("_n", ignorenulls=True).over(w)).filter("_kind = 0")
    return got.select("_row.*", F.col("_n.note_frame").alias(note_frame), *[F.col("_n._note").getField(c).alias(out[c]) for c in extra])


def clip_split(clips: DataFrame, size: int, key: str = "clip_id") -> DataFrame:
    """Clips [start, end] mapped onto fixed boundaries of ``size``: one row per
    boundary index with the common part (part_start, part_end)."""
    first, last = F.floor(F.col("start") / size), F.floor(F.col("end") / size)
    c = clips.withColumn("idx", F.explode(F.sequence(first, last)))
    return c.withColumn("part_start", F.greatest(F.col("start"), F.col("idx") * size)).withColumn("part_end", F.least(F.col("end"), F.col("idx") * size + size - 1))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], size: int) -> DataFrame:
    """Pairs whose [start, end] ranges share a frame, joined by bins of ``size``
    frames; a pair is reported in the bin where its common part starts."""
    bins = lambda d, p: d.select(*by, F.struct(*[F.col(c) for c in d.columns]).alias(p), F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("_bin"))
    j = bins(left, "l").join(bins(right, "r"), [*by, "_bin"])
    common = F.greatest(F.col("l.start"), F.col("r.start"))
    return j.filter((common <= F.least(F.col("l.end"), F.col("r.end"))) & (F.floor(common / size) == F.col("_bin"))).drop("_bin")


def frames_in(frames: DataFrame, spans: DataFrame, by: str, start: str, end: str, size: int = 64) -> DataFrame:
    """``frames`` with the columns of each span [start, end] that holds them, joined by
    bins of ``size`` frames, so that a frame meets the spans around it only."""
    bins = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(F.greatest(start, end) / size))))
    met = frames.withColumn("_bin", F.floor(F.col("frame") / size)).join(bins.filter(F.col(start) <= F.col(end)), [by, "_bin"])
    return met.filter((F.col("frame") >= F.col(start)) & (F.col("frame") <= F.col(end))).drop("_bin")


def cosine(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), zero, lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u.cast("double") - v.cast("double")) * (u.cast("double") - v.cast("double"))), F.lit(0.0), lambda s, t: s + t))


def _in_blocks(left: DataFrame, right: DataFrame, by: str, meet, schema: str) -> DataFrame:
    """``meet(left ids, left vectors, right ids, right vectors)`` of every pair of
    blocks under one key, of up to ``BLOCK`` rows each; columns: by, id, v.

    A hot key has many blocks and so many tasks. Rows without key or vector, or with
    a null component, meet nothing; vectors meet those of their own length."""
    kind = left.schema[by].dataType.simpleString()

    def side(d: DataFrame, own: str, other: str, counts: DataFrame) -> DataFrame:
        d = d.filter(F.col(by).isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).join(counts, by)
        d = d.withColumn(own, F.pmod(F.xxhash64("id"), own + "s")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)))
        # new attributes, as both sides may come from one table
        return d.select(*[F.col(c).alias(c) for c in (by, "id", "v")], F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))

    counts = None
    for d, n in ((left, "i"), (right, "j")):
        c = d.groupBy(by).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(n + "s"))
        counts = c if counts is None else counts.join(c, by)
    cells = [side(left, "i", "j", counts).groupBy(by, "i", "j"), side(right, "j", "i", counts).groupBy(by, "i", "j")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        for n in set(pc.list_value_length(a["v"]).to_pylist()):
            x, y = (t.filter(pc.equal(pc.list_value_length(t["v"]), n)) for t in (a, b))
            u, v = (np.asarray(pc.list_flatten(t["v"]).combine_chunks(), float).reshape(-1, n) if n else np.zeros((t.num_rows, 0)) for t in (x, y))
            if x.num_rows and y.num_rows:
                for names, columns in meet(x["id"], u, y["id"], v):
                    key = pa.chunked_array([pa.array(a[by].slice(0, 1).to_pylist() * len(columns[0]), a[by].type)])
                    out.append(pa.table([key, *columns], names=[by, *names]))
        return pa.concat_tables(out) if out else empty

    empty = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(f"{by} {kind}, {schema}")]).empty_table()
    return cells[0].cogroup(cells[1]).applyInArrow(run, f"{by} {kind}, {schema}")


def similarity_join(left: DataFrame, right: DataFrame, by: str, feature: str, threshold: float, left_id: str, right_id: str) -> DataFrame:
    """(by, left_id, right_id, cosine) of pairs under one key at or above the threshold."""

    def meet(ids, u, others, v):
        unit = lambda x: np.divide(x, n := np.sqrt((x * x).sum(1, keepdims=True)), out=np.full_like(x, np.nan), where=n > 0)
        u, v = unit(u), unit(v)
        for at in range(0, len(u), STEP):
            c = u[at : at + STEP] @ v.T
            i, j = np.nonzero(c >= threshold)
            yield ["left_id", "right_id", "cosine"], [ids.take(pa.array(i + at)), others.take(pa.array(j)), pa.chunked_array([c[i, j]])]

    a = left.select(by, F.col(left_id).alias("id"), F.col(feature).cast("array<double>").alias("v"))
    b = right.select(by, F.col(right_id).alias("id"), F.col(feature).cast("array<double>").alias("v"))
    kinds = [d.schema["id"].dataType.simpleString() for d in (a, b)]
    return _in_blocks(a, b, by, meet, f"left_id {kinds[0]}, right_id {kinds[1]}, cosine double")


def video_match(tiles_a: DataFrame, tiles_b: DataFrame, by: str, threshold: float) -> DataFrame:
    """(by, match): whether some frame of a and some of b have tiles whose mean
    cosine, tile by tile, reaches the threshold. Columns: by, frame, tile, feature.

    The mean of all cosines of two sets is the product of the sums of their unit
    vectors over the number of pairs, so tiles are summed before frames meet."""

    def summed(tiles: DataFrame, frame: str, to: str) -> DataFrame:
        f = F.col("feature")
        norm = F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
        t = tiles.select(by, "tile", F.col("frame").alias(frame), F.col("feature"), norm.alias("_norm")).filter("_norm > 0")
        parts = t.select(by, "tile", frame, "_norm", F.posexplode("feature").alias("_i", "_x"))
        parts = parts.groupBy(by, "tile", frame, "_i").agg(F.sum(F.col("_x").cast("double") / F.col("_norm")).alias("_x"), F.count("*").alias("_n"))
        whole = F.sort_array(F.collect_list(F.struct("_i", "_x")))
        return parts.groupBy(by, "tile", frame).agg(F.transform(whole, lambda s: s["_x"]).alias(to), F.max("_n").alias(f"{to}_n"))

    both = summed(tiles_a, "fa", "_a").join(summed(tiles_b, "fb", "_b"), [by, "tile"])
    dot = F.aggregate(F.zip_with("_a", "_b", lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    pairs = both.groupBy(by, "fa", "fb").agg((F.sum(dot) / F.sum(F.col("_a_n") * F.col("_b_n"))).alias("m"))
    return pairs.groupBy(by).agg((F.max("m") >= threshold).alias("match"))


def descriptor_match(a: DataFrame, b: DataFrame, by: str, near: float, accept: float) -> DataFrame:
    """(by, share, match): the share of descriptors of a that have one of b within
    L2 distance ``near``. Columns: by, id, feature."""


    def meet(ids, u, others, v):
        for at in range(0, len(u), STEP):
            part = u[at : at + STEP]
            # the expansion finds what may be near, differences decide
            rough = (part * part).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * part @ v.T
            i, j = np.nonzero(rough < near * near * (1 + 1e-6) + 1e-6)
            hit = np.unique(i[np.sqrt(((part[i] - v[j]) ** 2).sum(1)) < near])
            yield ["id"], [ids.take(pa.array(hit + at))]

    x = a.select(by, "id", F.col("feature").cast("array<double>").alias("v"))
    y = b.select(by, "id", F.col("feature").cast("array<double>").alias("v"))
    hit = _in_blocks(x, y, by, meet, f"id {x.schema['id'].dataType.simpleString()}").distinct()
    hit = x.join(hit, [by, "id"], "left_semi")
    n = x.groupBy(by).agg(F.count("*").alias("n")).join(hit.groupBy(by).agg(F.count("*").alias("k")), by, "left")
    share = F.coalesce("k", F.lit(0)) / F.col("n")
    return n.select(by, share.alias("share"), (share >= accept).alias("match"))
