"""Temporal slicing, sampling and clip predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(frames: DataFrame, start: int, end: int, compat: bool = False) -> DataFrame:
    """Frames start..end, both included; with ``compat`` the first one found is
    dropped in each stream, as the original cursor did."""
    kept = frames.filter(F.col("frame").between(start, end))
    if not compat:
        return kept
    first = kept.groupBy("stream_id").agg(F.min("frame").alias("_first"))
    return kept.join(first, "stream_id").filter("frame > _first").drop("_first")


def limit_frames(frames: DataFrame, n: int) -> DataFrame:
    """Frames below the absolute number n (n < 0: all)."""
    return frames if n < 0 else frames.filter(F.col("frame") < n)


def sample(frames: DataFrame, ratio: float) -> DataFrame:
    """Every int(1 / ratio)-th frame, from frame 0."""
    return frames.filter(F.col("frame") % F.lit(int(1 / ratio)) == 0)


def skip_empty(frames: DataFrame, data: str = "data") -> DataFrame:
    return frames.filter(F.length(data) > 0)


def clip_hash(stream: Column, clip: Column) -> Column:
    """A number in 0..9999 from stream and clip: one that any engine can compute."""
    return F.pmod((stream.cast("bigint") * 7919 + clip.cast("bigint") * 104729) % 1000003 * 31337, F.lit(10000))


def sample_clip(frames: DataFrame, size: int, p: float) -> DataFrame:
    """Whole clips of ``size`` frames, each with probability p by its hash, so the
    choice is the same in every run and partitioning."""
    clip = F.floor(F.col("frame") / size)
    return frames.filter(clip_hash(F.col("stream_id"), clip) < int(p * 10000))


def clip_of(frame: Column, size: int) -> Column:
    """Number of the fixed-size clip that has the frame."""
    return F.floor(frame / size)


# header predicates



def always() -> Column:
    return F.lit(True)


def never() -> Column:
    return F.lit(False)



def has_label(label: str, labels: Column) -> Column:
    return F.array_contains(labels, label)


def starts_before(t, start: Column) -> Column:
    return F.lit(t) >= start


def starts_after(t, start: Column) -> Column:
    return F.lit(t) < start


def ends_before(t, end: Column) -> Column:
    return F.lit(t) >= end


def ends_after(t, end: Column) -> Column:
    return F.lit(t) < end


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Inclusive ranges that share more than one frame."""
    return F.least(e1, e2) - F.greatest(s1, s2) + 1 > 1


def time_filter(start: Column, end: Column, a, b, enclosing: bool = False) -> Column:
    """An end of the clip lies strictly inside (a, b); with ``enclosing`` also
    clips that contain the window."""
    inside = ((start > a) & (start < b)) | ((end > a) & (end < b))
    return inside | ((start <= a) & (end >= b)) if enclosing else inside


def clip_boundaries(ranges: DataFrame, size: int) -> DataFrame:
    """(.., start, end) split into (.., clip_start, clip_end) of ``size`` frames;
    the last one is as long as is left."""
    starts = F.sequence("start", "end", F.lit(size).cast("bigint"))
    out = ranges.filter("start < `end`").withColumn("clip_start", F.explode(starts)).filter("clip_start < `end`")
    return out.withColumn("clip_end", F.least(F.col("clip_start") + size - 1, F.col("end")))


def allowed_labels(detections: DataFrame, labels: list[str], confidence: float) -> DataFrame:
    return detections.filter(F.col("label").isin(labels) & (F.col("score") >= confidence))


def set_operation(kind: str, *parts: DataFrame) -> DataFrame:
    """union (all rows), intersect or except of rows by name."""
    out = parts[0]
    for p in parts[1:]:
        q = p.select(*out.columns)
        out = out.unionByName(q) if kind == "union" else out.intersect(q) if kind == "intersect" else out.subtract(q)
    return out


def chain(*streams: DataFrame) -> DataFrame:
    """Streams one after another: ``clip_seq`` keeps their order; no frame is lost."""
    out = None
    for i, s in enumerate(streams):
        s = s.withColumn("clip_seq", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
