"""The driver's tables as frame streams, detections, clips and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """A stream per user: frames by time, label, metric."""
    e = table(spark, d, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    return e.select(F.col("user_id").alias("stream_id"), n.alias("frame"), F.col("event_type").alias("label"), F.col("value").alias("metric"))


FRAMES = "f AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS label, value AS metric FROM events)"


def detections(spark: SparkSession, d: str) -> DataFrame:
    """A box per line item; the supplier is the video, the order the frame."""
    i = table(spark, d, "lineitem")
    x, y, q = (F.col("l_partkey") % 100).cast("int"), (F.col("l_linenumber") * 10).cast("int"), F.col("l_quantity").cast("int")
    return i.select(
        F.col("l_suppkey").alias("stream_id"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("int").alias("idx"), F.col("l_returnflag").alias("label"),
        x.alias("x0"), y.alias("y0"), (x + q).alias("x1"), (y + q).alias("y1"), F.col("l_discount").alias("score"),
    )


DETECTIONS = (
    "d AS (SELECT l_suppkey AS stream_id, l_orderkey AS frame, CAST(l_linenumber AS INTEGER) AS idx, l_returnflag AS label, CAST(l_partkey % 100 AS INTEGER) AS x0, CAST(l_linenumber * 10 AS INTEGER) AS y0,"
    " CAST(l_partkey % 100 + CAST(l_quantity AS INTEGER) AS INTEGER) AS x1, CAST(l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS INTEGER) AS y1, l_discount AS score FROM lineitem)"
)


def clips(spark: SparkSession, d: str, size: int = 20) -> DataFrame:
    """Clips of ``size`` frames of each stream, with a made-up geometry."""
    f = frames(spark, d).groupBy("stream_id", F.floor(F.col("frame") / size).alias("clip_id"))
    c = f.agg(F.min("frame").alias("start_time"), (F.max("frame") + 1).alias("end_time"))
    return c.select(
        "clip_id", F.col("stream_id").cast("string").alias("video_name"), "start_time", "end_time", (F.col("stream_id") % 50).cast("int").alias("origin_x"), (F.col("clip_id") * 7 % 40).cast("int").alias("origin_y"),
        (F.col("stream_id") % 30 + 10).cast("int").alias("height"), (F.col("clip_id") % 20 + 10).cast("int").alias("width"), (F.col("clip_id") % 3 == 0).alias("is_background"),
    )


CLIPS = FRAMES + (
    ", c AS (SELECT CAST(frame // 20 AS BIGINT) AS clip_id, CAST(stream_id AS VARCHAR) AS video_name, min(frame) AS start_time, max(frame) + 1 AS end_time, CAST(stream_id % 50 AS INTEGER) AS origin_x,"
    " CAST((frame // 20) * 7 % 40 AS INTEGER) AS origin_y, CAST(stream_id % 30 + 10 AS INTEGER) AS height, CAST((frame // 20) % 20 + 10 AS INTEGER) AS width, (frame // 20) % 3 = 0 AS is_background FROM f GROUP BY stream_id, frame // 20)"
    ", lb AS (SELECT DISTINCT label, CAST(frame // 20 AS BIGINT) AS clip_id, CAST(stream_id AS VARCHAR) AS video_name FROM f)"
)


def clip_labels(spark: SparkSession, d: str, size: int = 20) -> DataFrame:
    f = frames(spark, d)
    return f.select("label", F.floor(F.col("frame") / size).alias("clip_id"), F.col("stream_id").cast("string").alias("video_name")).distinct()
