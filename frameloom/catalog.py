"""Clip catalog and storage: three tables, pixels in Parquet by video and clip.

Reads are plans over the tables; writes replace a video's partitions, so a
repeated put gives the same state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.operators import crops as C
from frameloom.operators.joins import frames_in
from frameloom.operators.slicing import time_filter
from frameloom.schema import BACKGROUND, CLIP, LABEL


@dataclass(frozen=True)
class Condition:
    """What clips must satisfy; None asks for nothing.

    label: one or several labels, any of which the clip has. crop: a box that
    contains the clip or covers ``cover`` of its area. time: (start, end).
    custom: a function from the clip table to clip rows to keep. resolution and
    sampling are applied to the frames that are returned.
    """

    label: str | list[str] | None = None
    crop: tuple[int, int, int, int] | None = None
    time: tuple[int, int] | None = None
    enclosing: bool = True
    custom: Callable[[DataFrame], DataFrame] | None = None
    resolution: float = 1.0
    sampling: float = 1.0
    cover: float = 0.7

    def to_json(self) -> str:
        if self.custom is not None:
            raise ValueError("a condition with a function has no JSON form")
        return json.dumps({k: v for k, v in self.__dict__.items() if k != "custom"})

    @classmethod
    def from_json(cls, text: str) -> Condition:
        d = json.loads(text)
        return cls(**{k: tuple(v) if k in ("crop", "time") and v is not None else v for k, v in d.items()})

    def clips(self, clip: DataFrame, label: DataFrame) -> DataFrame:
        """Rows of ``clip`` that satisfy the condition: semi-joins and predicates."""
        keys = ["clip_id", "video_name"]
        out = clip
        if self.label is not None:
            names = [self.label] if isinstance(self.label, str) else list(self.label)
            out = out.join(label.filter(F.col("label").isin(names)), keys, "left_semi")
        if self.crop is not None:
            out = out.filter(crop_predicate(self.crop, self.cover))
        if self.time is not None:
            out = out.filter(time_filter(F.col("start_time"), F.col("end_time"), *self.time, enclosing=self.enclosing))
        if self.custom is not None:
            out = out.join(self.custom(clip).select(*keys).distinct(), keys, "left_semi")
        return out


def clip_box() -> Column:
    return B.box(F.col("origin_x"), F.col("origin_y"), F.col("origin_x") + F.col("width"), F.col("origin_y") + F.col("height"))


def crop_predicate(crop: tuple[int, int, int, int], cover: float = 0.7) -> Column:
    c, own = B.box(*crop), clip_box()
    share = F.try_divide(B.intersect_area(c, own).cast("double"), B.area(own).cast("double"))
    return B.contains(c, own) | F.coalesce(share >= cover, F.lit(False))


def contiguity(clips: DataFrame, gap: int = 5) -> DataFrame:
    """``clips`` with ``chain``: clips of a video chain up while the next starts
    within ``gap`` frames of the previous end."""
    w = W.partitionBy("video_name").orderBy("start_time", "clip_id")
    far = F.coalesce(F.abs(F.col("start_time") - F.lag("end_time").over(w)) > gap, F.lit(True))
    return clips.withColumn("_far", far.cast("bigint")).withColumn("chain", F.sum("_far").over(w)).drop("_far")


def clip_headers(runs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clip, label, background) rows of merged runs (C.run_boxes plus frame
    height and width): a background clip per run and a clip per crop."""
    span = [(F.col("first_batch") * size).cast("int").alias("start_time"), ((F.col("last_batch") + 1) * size).cast("int").alias("end_time")]
    base = F.col("run") * 10000
    none = F.lit(None)
    trail = none.cast("array<struct<t:int,x:int,y:int>>").alias("translation")
    back = runs.groupBy("stream_id", "run").agg(F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch"), F.max("frame_height").alias("height"), F.max("frame_width").alias("width"))
    back = back.select(base.alias("clip_id"), F.col("stream_id").alias("video_name"), *span, F.lit(0).alias("origin_x"), F.lit(0).alias("origin_y"), "height", "width", none.cast("string").alias("video_ref"), F.lit(True).alias("is_background"), trail, none.cast("string").alias("other"))
    front = runs.filter("idx IS NOT NULL AND x0 IS NOT NULL")
    cid = (base + F.col("idx") + 1).alias("clip_id")
    fore = front.select(cid, F.col("stream_id").alias("video_name"), *span, F.col("x0").alias("origin_x"), F.col("y0").alias("origin_y"), (F.col("y1") - F.col("y0")).alias("height"), (F.col("x1") - F.col("x0")).alias("width"), none.cast("string").alias("video_ref"), F.lit(False).alias("is_background"), trail, none.cast("string").alias("other"))
    labels = front.select("label", cid, F.col("stream_id").alias("video_name"))
    links = front.select(base.alias("background_id"), cid, F.col("stream_id").alias("video_name"))
    return back.unionByName(fore), labels, links


class ClipStore:
    """A folder with the tables clip, label, background and frames.

    The frames of a clip are found by (video, frame range), so crops and
    backgrounds share one copy of the pixels and a ``get`` cuts what it needs.
    """

    TABLES = {"clip": CLIP, "label": LABEL, "background": BACKGROUND}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.cached: dict[tuple[str, str], DataFrame] = {}

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self._path(name))
        except Exception as e:  # a store without a put is empty
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return self.spark.createDataFrame([], self.TABLES[name])

    def _replace(self, name: str, df: DataFrame) -> None:
        """Overwrite the partitions of the videos in ``df`` only."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_name").parquet(self._path(name))

    def put(self, frames: DataFrame, detections: DataFrame, size: int = 20, join: str = "crops", ratio: float = 1.0) -> None:
        """Batches -> crops -> merged runs -> clips, for every video of ``frames``
        at once (stream_id is the video's name). Pixels stay per frame."""
        if ratio < 1:
            frames = frames.filter(F.col("frame") % int(1 / ratio) == 0)
        batches = frames.select("stream_id", F.floor(F.col("frame") / size).alias("batch")).distinct()
        crops = C.batch_crops(detections, size) if join == "crops" else C.union_crops(detections, size).withColumn("idx", F.lit(0)) if join == "union" else C.batch_crops(C.first_frame_crops(detections, size).drop("batch"), size)
        runs = C.merge_runs(crops, batches, join)
        self._write(frames, C.run_boxes(crops, runs), runs, size)

    def put_fixed(self, frames: DataFrame, boxes: list[tuple[str, tuple[int, int, int, int]]], size: int) -> None:
        """The same crops for every batch, given by the user; one run per video."""
        batches = frames.select("stream_id", F.floor(F.col("frame") / size).alias("batch")).distinct()
        rows = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(label).alias("label"), *[F.lit(v).alias(s) for v, s in zip(b, B.SIDES, strict=True)]) for k, (label, b) in enumerate(boxes)])
        crops = batches.select("stream_id", "batch", F.explode(rows).alias("c")).select("stream_id", "batch", "c.*")
        runs = batches.withColumn("run", F.lit(0).cast("bigint"))
        self._write(frames, C.run_boxes(crops, runs), runs, size)

    def _write(self, frames: DataFrame, boxes: DataFrame, runs: DataFrame, size: int) -> None:
        span = runs.groupBy("stream_id", "run").agg(F.min("batch").alias("_a"), F.max("batch").alias("_b"))
        shape = frames.groupBy("stream_id").agg(F.max("height").alias("frame_height"), F.max("width").alias("frame_width"))
        all_ = span.join(boxes, ["stream_id", "run"], "left").join(shape, "stream_id")
        all_ = all_.withColumn("first_batch", F.col("_a")).withColumn("last_batch", F.col("_b")).drop("_a", "_b")
        clip, label, background = clip_headers(all_, size)
        tables = {"frames": frames.withColumnRenamed("stream_id", "video_name"), "clip": clip.withColumn("video_ref", F.lit(self._path("frames"))), "label": label, "background": background}
        videos = frames.select(F.col("stream_id").alias("video_name")).distinct()
        for name, df in tables.items():
            self._replace(name, df)
            self._empty(name, videos.join(df.select("video_name").distinct(), "video_name", "left_anti"))

    def _empty(self, name: str, videos: DataFrame) -> None:
        """Delete the partitions of videos that have no rows any more."""
        fs, jvm = None, self.spark.sparkContext._jvm
        for (video,) in videos.toLocalIterator():  # names only, a partition at a time
            path = jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/video_name={video}")
            fs = fs or path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)

    def get(self, name: str | None, condition: Condition | None = None) -> DataFrame:
        """Frames of the matching clips of a video (None: of all): clip_id, the
        clip's origin, global frame numbers, in one plan."""
        clip = self.table("clip")
        if name is not None:
            clip = clip.filter(F.col("video_name") == name)
        condition = condition or Condition()
        chosen = condition.clips(clip, self.table("label")).select("clip_id", "video_name", "start_time", "end_time", F.struct(F.col("origin_x").alias("x"), F.col("origin_y").alias("y")).alias("origin"), F.col("height").alias("clip_height"), F.col("width").alias("clip_width"))
        frames = self.table("frames").drop("origin")
        if condition.sampling < 1:
            frames = frames.filter(F.col("frame") % int(1 / condition.sampling) == 0)
        chosen = chosen.withColumn("_last", F.col("end_time") - 1)
        out = frames_in(frames, chosen, "video_name", "start_time", "_last").drop("_last").withColumnRenamed("video_name", "stream_id")
        if condition.resolution != 1.0:
            from frameloom.operators.maps import resize

            out = resize(out, condition.resolution)
        return out

    def delete(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in (*self.TABLES, "frames"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self._path(t)}/video_name={name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def list(self) -> DataFrame:
        return self.table("clip").select("video_name").distinct().orderBy("video_name")

    def size(self, name: str) -> int:
        """Bytes of a video's pixels on disk."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path('frames')}/video_name={name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def cache(self, name: str, condition: Condition | None = None) -> DataFrame:
        """Decoded frames kept by the session until ``uncache``; idempotent."""
        key = name, repr(condition)
        if key not in self.cached:
            self.cached[key] = self.get(name, condition).persist()
        return self.cached[key]

    def uncache(self, name: str, condition: Condition | None = None) -> None:
        if (df := self.cached.pop((name, repr(condition)), None)) is not None:
            df.unpersist()

    def set_quality(self, name: str, scale: float = 1.0, condition: Condition | None = None, quantum: int = 1, inplace: bool = True) -> DataFrame:
        """Frames of a video's matching clips with pixels and clip geometry rescaled
        and colours quantised in steps of ``quantum``. In place (without a condition only, as
        clips share frames) they replace the video's tables; else the store stays."""
        from frameloom.operators.maps import color_quant, resize

        if inplace and condition is not None:
            raise ValueError("clips share their frames: a condition needs inplace=False")
        frames = self.table("frames").filter(F.col("video_name") == name) if inplace else self.get(name, condition)
        scaled = resize(frames, scale) if scale != 1.0 else frames
        scaled = color_quant(scaled, quantum) if quantum > 1 else scaled
        if not inplace:
            return scaled
        clips = self.table("clip").filter(F.col("video_name") == name)
        clips = clips.withColumns({c: (F.col(c) * scale).cast("int") for c in ("origin_x", "origin_y", "height", "width")})
        for table, df in (("frames", scaled), ("clip", clips)):
            self._rewrite(table, df)
        return self.table("frames").filter(F.col("video_name") == name)

    def _rewrite(self, table: str, df: DataFrame) -> None:
        """Replace partitions by rows read from them, through a folder of this call's own."""
        part = f"{self.root}/_rewrite/{table}-{uuid.uuid4().hex}"
        df.write.parquet(part)
        self._replace(table, self.spark.read.schema(df.schema).parquet(part))
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def insert(self, name: str, rows: DataFrame) -> None:
        """Add rows to the table clip, label or background; equal ones stay once."""
        old = self.table(name)
        rows = rows.select(*old.columns)
        self._rewrite(name, old.join(rows.select("video_name").distinct(), "video_name", "left_semi").unionByName(rows).dropDuplicates([c for c in old.columns if c != "translation"]))

    def update(self, name: str, where: Column, values: dict[str, Column]) -> None:
        """Set columns of the rows where ``where`` holds; the rest stays as it is."""
        if "video_name" in values:
            raise ValueError("a row's video is its place; delete and insert instead")
        old = self.table(name)
        touched = old.join(old.filter(where).select("video_name").distinct(), "video_name", "left_semi")
        self._rewrite(name, touched.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(old.schema[c].dataType) for c, v in values.items()}))

    def remove(self, name: str, where: Column) -> None:
        """Delete the rows of a table where ``where`` holds."""
        old = self.table(name)
        videos = old.filter(where).select("video_name").distinct().cache()
        left = old.join(videos, "video_name", "left_semi").filter(~F.coalesce(where, F.lit(False)))
        gone = videos.join(left.select("video_name").distinct(), "video_name", "left_anti").cache()
        gone.count()
        self._rewrite(name, left)
        self._empty(name, gone)
        videos.unpersist()
        gone.unpersist()

    def everything(self) -> DataFrame:
        """Clips with their labels and backgrounds."""
        keys = ["clip_id", "video_name"]
        labels = self.table("label").groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("labels"))
        return self.table("clip").join(labels, keys, "left").join(self.table("background"), keys, "left")

    def query_clip(self, clip_id: int, name: str) -> DataFrame:
        return self.table("clip").filter((F.col("clip_id") == clip_id) & (F.col("video_name") == name))

    def query_background(self, name: str, background_id: int | None = None, clip_id: int | None = None) -> DataFrame:
        out = self.table("background").filter(F.col("video_name") == name)
        for c, v in (("background_id", background_id), ("clip_id", clip_id)):
            out = out if v is None else out.filter(F.col(c) == v)
        return out

    def query_label(self, label: str, name: str) -> DataFrame:
        return self.table("label").filter((F.col("label") == label) & (F.col("video_name") == name))


def move_tier(headers: DataFrame, predicate: Column, tier: str) -> DataFrame:
    """``headers`` with the matching rows in ``tier`` ('local' or 'extern')."""
    return headers.withColumn("tier", F.when(predicate, tier).otherwise(F.col("tier")))


def is_extern() -> Column:
    return F.col("tier") == "extern"
