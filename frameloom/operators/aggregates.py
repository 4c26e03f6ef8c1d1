"""Counting, getting, headers, buffers and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.schema import FRAME_RATE


def truthy(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return F.coalesce((c != "") if kind == "string" else (c != 0), F.lit(False))


def count_keys(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n) with key = name_value for every truthy value of the columns ``keys``."""
    kinds = dict(frames.dtypes)
    text = lambda k: F.initcap(F.col(k).cast("string")) if kinds[k] == "boolean" else F.col(k).cast("string")
    seen = F.array(*[F.when(truthy(F.col(k), kinds[k]), F.concat(F.lit(f"{k}_"), text(k))) for k in keys])
    return frames.select(F.explode(F.array_compact(seen)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def get_rows(frames: DataFrame, key: str, frame_rate: float | None = None) -> DataFrame:
    """Frames where ``key`` is truthy, with ``at``: frame number, or whole seconds."""
    at = F.col("frame") if frame_rate is None else F.floor(F.col("frame") / F.lit(frame_rate))
    return frames.filter(truthy(F.col(key), dict(frames.dtypes)[key])).withColumn("at", at.cast("bigint"))


def headers(detections: DataFrame, *keys: str) -> DataFrame:
    """Clip headers: start, inclusive end, sorted label set, boxes and the union box."""
    return detections.groupBy(*keys).agg(
        F.min("frame").alias("start"), F.max("frame").alias("end"), F.sort_array(F.collect_set("label")).alias("label_set"),
        F.count("*").alias("boxes"), *B.union_of(F.struct(*B.SIDES)),
    )


def cut_header(detections: DataFrame, start: int, end: int, *keys: str) -> DataFrame:
    """Headers of the frames in [start, end)."""
    return headers(detections.filter((F.col("frame") >= start) & (F.col("frame") < end)), *keys)


def crop_header(detections: DataFrame, window: tuple[int, int, int, int], *keys: str) -> DataFrame:
    """Headers of the boxes that touch the window."""
    return headers(detections.filter(B.intersects(B.box(*window), F.struct(*B.SIDES))), *keys)


def usage(clips: DataFrame, by: str = "video_ref") -> DataFrame:
    """Per source file: total crop area, clips and the last access."""
    return clips.groupBy(by).agg(F.sum(F.col("height").cast("bigint") * F.col("width")).alias("area"), F.count("*").alias("n"), F.max("last_accessed").alias("last_accessed"))


def within_budget(rows: DataFrame, size: str, budget: float, *order: Column) -> DataFrame:
    """Rows in order while their running size stays within the budget."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def cache_lru(files: DataFrame, budget: float) -> DataFrame:
    """Files to cache, most recent first (one row per file: a catalog report)."""
    return within_budget(files, "size", budget, F.col("last_accessed").desc(), F.col("video_ref"))


def cache_benefit(files: DataFrame, budget: float, full: float = 113000.0) -> DataFrame:
    """Files to cache by (1 - area / full) * n, highest first, positive ones only."""
    b = files.withColumn("benefit", (F.lit(1.0) - F.col("area") / F.lit(full)) * F.col("n")).filter("benefit > 0")
    return within_budget(b, "size", budget, F.col("benefit").desc(), F.col("video_ref"))


def buffer_of(frame: Column, size: int) -> Column:
    return F.floor(frame / size)


def buffer_reduce(frames: DataFrame, size: int, aggregates: dict[str, Column], rows: bool = False, sampling: float = 1.0) -> DataFrame:
    """Aggregates per buffer of ``size`` frames (every int(1/sampling)-th counts);
    with ``rows`` they are put on each buffered frame."""
    f = frames.withColumn("buffer", buffer_of(F.col("frame"), size))
    used = f.filter(F.col("frame") % int(1 / sampling) == 0)
    out = used.groupBy("stream_id", "buffer").agg(*[c.alias(n) for n, c in aggregates.items()])
    return f.join(out, ["stream_id", "buffer"], "left") if rows else out


def buffer_map(frames: DataFrame, schema: str, function, size: int = 64) -> DataFrame:
    """``function`` (pandas to pandas) over buffers of up to ``size`` rows; the
    session's batch size stays as it is, and results don't depend on either."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), size):
                yield function(b.iloc[at : at + size])

    return frames.mapInPandas(run, schema)


def buffer_merge(frames: DataFrame, schema: str, function, size: int = 64, sampling: float = 1.0, key: tuple[str, ...] = ("stream_id", "frame")) -> DataFrame:
    """``frames`` with what ``buffer_map`` makes of every int(1/sampling)-th frame,
    merged by ``key``; frames in between keep nulls. ``function`` returns the key too."""
    used = frames.filter(F.col("frame") % int(1 / sampling) == 0)
    return frames.join(buffer_map(used, schema, function, size), list(key), "left")


def label_union(detections: DataFrame, size: int) -> DataFrame:
    """Box around all boxes of a label in each buffer of frames."""
    b = detections.withColumn("buffer", buffer_of(F.col("frame"), size))
    return b.groupBy("stream_id", "buffer", "label").agg(*B.union_of(F.struct(*B.SIDES)))


def batch_tag(frames: DataFrame, size: int, tag: Column, name: str = "tag") -> DataFrame:
    """``tag`` (an aggregate) of each batch of ``size`` frames on all its frames;
    size -1 takes one second."""
    n = int(FRAME_RATE) if size == -1 else size
    w = W.partitionBy("stream_id", buffer_of(F.col("frame"), n))
    return frames.withColumn(name, tag.over(w))


def put_log(log: DataFrame) -> DataFrame:
    """End times relative to the start, in order."""
    return log.select("video_name", (F.col("end_time") - F.col("start_time")).alias("elapsed")).orderBy("elapsed", "video_name")
