"""Per-frame maps. Box maps are expressions; pixel maps run on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.functions import pixels as P


def _pixels(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply an image function to ``data``; height, width and channels follow."""
    schema = frames.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.copy()
            images = [f(P.image(r.data, r.height, r.width, r.channels)) if r.data is not None else None for r in b.itertuples()]
            out["data"] = [None if i is None else np.ascontiguousarray(i, np.uint8).tobytes() for i in images]
            for n, axis in (("height", 0), ("width", 1)):
                out[n] = pd.array([None if i is None else i.shape[axis] for i in images], "Int32")
            out["channels"] = pd.array([None if i is None else (i.shape[2] if i.ndim == 3 else 1) for i in images], "Int32")
            yield out

    return frames.mapInPandas(run, schema)


def crop(frames: DataFrame, x0: int, y0: int, x1: int, y1: int, compat: bool = False) -> DataFrame:
    """Pixels within the box, clamped to the frame. Origins add up; with
    ``compat`` the crop's own corner replaces the origin."""
    out = _pixels(frames, lambda i: P.crop(i, x0, y0, x1, y1))
    cx, cy = F.greatest(F.lit(x0), F.lit(0)), F.greatest(F.lit(y0), F.lit(0))
    ox, oy = (F.lit(0), F.lit(0)) if compat else (F.coalesce("origin.x", F.lit(0)), F.coalesce("origin.y", F.lit(0)))
    return out.withColumn("origin", F.struct((ox + cx).cast("int").alias("x"), (oy + cy).cast("int").alias("y")))


def crop_boxes(detections: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Detections that touch the crop, in its coordinates and within it."""
    window = B.box(x0, y0, x1, y1)
    hit = detections.filter(B.intersects(window, F.struct(*B.SIDES)))
    c = B.shift(B.clip_to(F.struct(*B.SIDES), window), x0, y0)
    return hit.withColumn("_b", c).withColumns({s: F.col(f"_b.{s}") for s in B.SIDES}).drop("_b")


def mask(frames: DataFrame, x0: int, y0: int, x1: int, y1: int, compat: bool = False) -> DataFrame:
    """Everything outside the box becomes 0; ``compat`` blanks the top-left and
    bottom-right corner blocks only."""
    return _pixels(frames, lambda i: P.corners_blank(i, x0, y0, x1, y1) if compat else P.mask(i, x0, y0, x1, y1))


def gc(frames: DataFrame) -> DataFrame:
    return frames.drop("data")


def resize(frames: DataFrame, factor: float, pixels: bool = True) -> DataFrame:
    """Pixels and box coordinates times ``factor``."""
    out = _pixels(frames, lambda i: P.resize(i, factor)) if pixels else frames
    if "bounding_boxes" in frames.columns:
        b = lambda x: F.struct(x["label"].alias("label"), *[(x[s] * factor).alias(s) for s in B.SIDES])
        out = out.withColumn("bounding_boxes", F.transform("bounding_boxes", b))
    return out


def resize_boxes(detections: DataFrame, factor: float) -> DataFrame:
    return detections.withColumns({s: F.col(s) * F.lit(float(factor)) for s in B.SIDES})


def grayscale(frames: DataFrame) -> DataFrame:
    return _pixels(frames, P.gray)


def color_quant(frames: DataFrame, d: int) -> DataFrame:
    return _pixels(frames, lambda i: P.quantize(i, d))


def blur(frames: DataFrame, k: int = 5) -> DataFrame:
    return _pixels(frames, lambda i: P.blur(i, k))


def expand(frames: DataFrame) -> DataFrame:
    """One channel as three equal ones."""
    return _pixels(frames, P.expand)


def canny(frames: DataFrame, low: float = 225, high: float = 250) -> DataFrame:
    return _pixels(frames, lambda i: P.canny(i, low, high))


def null(frames: DataFrame) -> DataFrame:
    return frames


def running_background(frames: DataFrame) -> DataFrame:
    """Pixels equal to the previous frame's become 0, then a bilateral filter; a
    stream's first frame passes."""
    prev = frames.withColumn("_prev", F.lag("data").over(W.partitionBy("stream_id").orderBy("frame")))

    @F.pandas_udf("binary")
    def moved(data: pd.Series, before: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        rows = zip(data, before, h, w, c, strict=True)
        return pd.Series([a if b is None or a is None else P.bilateral(P.changed(P.image(a, *s), P.image(b, *s))).astype(np.uint8).tobytes() for a, b, *s in rows])

    return prev.withColumn("data", moved("data", "_prev", "height", "width", "channels")).drop("_prev")


def keypoint_filter(frames: DataFrame, distance: float) -> DataFrame:
    """Boxes with one of the previous frame's (unfiltered) boxes closer than
    ``distance`` by low corners; a stream's first frame passes."""
    before = F.lag("bounding_boxes").over(W.partitionBy("stream_id").orderBy("frame"))
    near = lambda a, b: (a["x0"] - b["x0"]) * (a["x0"] - b["x0"]) + (a["y0"] - b["y0"]) * (a["y0"] - b["y0"]) < distance * distance
    kept = F.filter("bounding_boxes", lambda b: F.exists("_before", lambda p: near(b, p)))
    return frames.withColumn("_before", before).withColumn("bounding_boxes", F.when(F.col("_before").isNull(), F.col("bounding_boxes")).otherwise(kept)).drop("_before")


def keypoint_filter_rows(detections: DataFrame, distance: float) -> DataFrame:
    """The same from rows: a semi-join with the stream's previous frame."""
    order = F.dense_rank().over(W.partitionBy("stream_id").orderBy("frame"))
    d = detections.withColumn("_k", order)
    p = d.select(F.col("stream_id").alias("_s"), (F.col("_k") + 1).alias("_n"), F.col("x0").alias("_x"), F.col("y0").alias("_y"))
    near = (F.col("x0") - F.col("_x")) * (F.col("x0") - F.col("_x")) + (F.col("y0") - F.col("_y")) * (F.col("y0") - F.col("_y")) < distance * distance
    met = d.join(p, (F.col("stream_id") == F.col("_s")) & (F.col("_k") == F.col("_n")) & near, "left_semi")
    return d.filter("_k = 1").unionByName(met).drop("_k")


def motion_vectors(frames: DataFrame, corners: int = 100, least: float = 0.1) -> DataFrame:
    """Displacements (x0, y0, x1, y1) of corners against the previous frame."""
    prev = frames.withColumn("_prev", F.lag("data").over(W.partitionBy("stream_id").orderBy("frame")))

    @F.pandas_udf("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    def flow(data: pd.Series, before: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for a, b, *s in zip(data, before, h, w, c, strict=True):
            v = [] if a is None or b is None else P.flow(P.gray(P.image(b, *s)), P.gray(P.image(a, *s)), corners)
            out.append([dict(zip(B.SIDES, map(float, q), strict=True)) for q in v if np.hypot(q[2] - q[0], q[3] - q[1]) > least])
        return pd.Series(out)

    return prev.withColumn("motion_vectors", flow("data", "_prev", "height", "width", "channels")).drop("_prev")


def _length(v):
    return F.sqrt(F.pow(v["x1"] - v["x0"], F.lit(2.0)) + F.pow(v["y1"] - v["y0"], F.lit(2.0)))


def direction(frames: DataFrame, vectors: str = "motion_vectors") -> DataFrame:
    """Angle against the x axis of each vector, 0 if it has no length."""
    turn = lambda v: F.when(_length(v) == 0, F.lit(0.0)).otherwise(F.acos((v["x1"] - v["x0"]) / _length(v)))
    return frames.withColumn("direction", F.transform(vectors, turn))


def speed(frames: DataFrame, vectors: str = "motion_vectors") -> DataFrame:
    return frames.withColumn("speed", F.transform(vectors, _length))


def ocr(frames: DataFrame, read: Callable[[np.ndarray], str]) -> DataFrame:
    """Text that the pluggable function ``read`` sees in each frame."""

    @F.pandas_udf("string")
    def f(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else read(P.image(d, *s)) for d, *s in zip(data, h, w, c, strict=True)], dtype=object)

    return frames.withColumn("text", f("data", "height", "width", "channels"))


def metadata(frames: DataFrame) -> DataFrame:
    return frames.drop("data")


def reverse_crop(frames: DataFrame, boxes: list[tuple[int, int, int, int]]) -> DataFrame:
    """Blacks out the boxes."""
    return _pixels(frames, lambda i: P.black_out(i, boxes))
