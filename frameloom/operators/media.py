"""File-level operations as relational ones: metadata, key frames, blocks, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.schema import FRAME_RATE


def properties(frames: DataFrame, rate: float = FRAME_RATE) -> DataFrame:
    """Per stream: frames, seconds, width, height and bits per second of the pixels."""
    seconds = F.count("*") / F.lit(rate)
    return frames.groupBy("stream_id").agg(F.count("*").alias("frames"), seconds.alias("seconds"), F.max("width").alias("width"), F.max("height").alias("height"), (F.sum(F.length("data")) * 8 / seconds).alias("bitrate"))


def key_frames(frames: DataFrame, key: Column, rate: float = FRAME_RATE) -> DataFrame:
    """(stream_id, seconds) of the key frames."""
    return frames.filter(key).select("stream_id", (F.col("frame") / F.lit(rate)).alias("seconds"))


def split_by_key_frames(frames: DataFrame, key: Column) -> DataFrame:
    w = W.partitionBy("stream_id").orderBy("frame")
    return frames.withColumn("segment", F.sum(F.coalesce(key.cast("bigint"), F.lit(0))).over(w))


def end_trim(frames: DataFrame, end: float, rate: float = FRAME_RATE) -> DataFrame:
    """Frames up to ``end`` seconds."""
    return frames.filter(F.col("frame") / F.lit(rate) <= end)


def block_put(frames: DataFrame, path: str, seconds: float, rate: float = FRAME_RATE) -> None:
    """Folders of ``seconds`` each, per stream."""
    block = F.floor(F.col("frame") / F.lit(rate) / F.lit(seconds))
    frames.withColumn("block", block).repartition("stream_id", "block").write.mode("overwrite").partitionBy("stream_id", "block").parquet(path)


def block_get(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks of the streams whose name starts with ``name``."""
    return blocks.filter(F.col("stream_id").startswith(name))


def auto_split(frames: DataFrame, split: Column, size: int) -> DataFrame:
    """Segment (from each split flag) and clip of ``size`` frames inside it."""
    w = W.partitionBy("stream_id").orderBy("frame")
    s = frames.withColumn("segment", F.sum(F.coalesce(split.cast("bigint"), F.lit(0))).over(w))
    at = F.row_number().over(W.partitionBy("stream_id", "segment").orderBy("frame")) - 1
    return s.withColumn("clip", F.floor(at / size))


def tiered_get(detections: DataFrame, headers: DataFrame, predicate: Column, size: int) -> DataFrame:
    """Clips of ``size`` frames inside the stored segments that satisfy the
    predicate, tested on the segment's header and again on the clip's own."""
    from frameloom.operators.aggregates import headers as header_of

    chosen = headers.filter(predicate).select("stream_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    from frameloom.operators.joins import frames_in

    d = frames_in(detections, chosen, "stream_id", "_s", "_e", size)
    d = d.withColumn("clip", F.floor((F.col("frame") - F.col("_s")) / size)).withColumn("segment", F.col("_s"))
    return header_of(d, "stream_id", "segment", "clip").filter(predicate).orderBy("stream_id", "start")
