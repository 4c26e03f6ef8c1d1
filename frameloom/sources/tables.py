"""Annotation tables with explicit schemas, and partitioned writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "youtube_id string, second_no double, fps int, frame_no int, class string, xmin double, xmax double, ymin double, ymax double"
RAW = "youtube_id string, timestamp_ms bigint, class_id int, class_name string, object_id int, object_presence string, xmin double, xmax double, ymin double, ymax double"


def label_csv(spark: SparkSession, path: str, width: int, height: int, header: bool = True) -> DataFrame:
    """Annotations with boxes in pixels, from shares of width and height."""
    d = spark.read.csv(path, schema=LABELS, header=header)
    return d.select(
        F.col("youtube_id").alias("stream_id"), F.col("frame_no").cast("bigint").alias("note_frame"), F.col("class").alias("label"),
        (F.col("xmin") * width).cast("int").alias("x0"), (F.col("ymin") * height).cast("int").alias("y0"),
        (F.col("xmax") * width).cast("int").alias("x1"), (F.col("ymax") * height).cast("int").alias("y1"),
    )


def raw_label_etl(raw: DataFrame, fps: int) -> DataFrame:
    """Seconds since each video's first label, and the frame at that time."""
    from pyspark.sql import Window as W

    w = W.partitionBy("youtube_id")
    rel = (F.col("timestamp_ms") - F.min("timestamp_ms").over(w)) / F.lit(1000.0)
    d = raw.withColumn("second_no", rel).withColumn("last_second", (F.max("timestamp_ms").over(w) - F.min("timestamp_ms").over(w)) / F.lit(1000.0))
    return d.select("youtube_id", "second_no", F.lit(fps).alias("fps"), F.floor(F.col("second_no") * fps).cast("int").alias("frame_no"), F.col("class_name").alias("class"), "xmin", "xmax", "ymin", "ymax", "last_second")


def mot_truth(spark: SparkSession, path: str) -> DataFrame:
    """Tracking ground truth without a header: frame, id, x, y, w, h, score, class, ..."""
    schema = "frame bigint, track_id bigint, x double, y double, w double, h double, score double, class double, visibility double"
    d = spark.read.csv(path, schema=schema)
    return d.select("frame", "track_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), "score", "class")


def track_json(spark: SparkSession, path: str, stream_id: str, halve: bool = True) -> DataFrame:
    """One JSON array by frame, each entry null or a list of tracks; coordinates
    are halved (whole numbers) if asked."""
    kind = "array<array<struct<track_id:bigint,left:double,top:double,right:double,bottom:double>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v"))
    d = d.select(F.posexplode("v").alias("frame", "tracks")).filter("tracks IS NOT NULL").select("frame", F.explode("tracks").alias("t"))
    side = lambda c: (F.floor(F.col(f"t.{c}") / 2) if halve else F.col(f"t.{c}")).cast("int")
    return d.select(F.lit(stream_id).alias("stream_id"), F.col("frame").cast("bigint").alias("frame"), F.col("t.track_id").alias("track_id"), side("left").alias("x0"), side("top").alias("y0"), side("right").alias("x1"), side("bottom").alias("y1"))


def write_clips(frames: DataFrame, path: str, size: int | None = None) -> None:
    """One folder per stream and clip of ``size`` frames (one clip without it)."""
    clip = F.floor(F.col("frame") / size) if size else F.lit(0)
    frames.withColumn("clip", clip).repartition("stream_id", "clip").sortWithinPartitions("stream_id", "clip", "frame").write.mode("overwrite").partitionBy("stream_id", "clip").parquet(path)


def write_tracks(crops: DataFrame, path: str) -> None:
    """One folder per track."""
    crops.repartition("track_id").sortWithinPartitions("track_id", "frame").write.mode("overwrite").partitionBy("track_id").parquet(path)
