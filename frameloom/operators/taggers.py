"""Taggers: frames in, detections out. Pixel work runs on Arrow batches; models
are factories that each Python worker calls once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.functions import pixels as P
from frameloom.operators.aggregates import batch_tag

BOXES = "array<struct<label:string,x0:int,y0:int,x1:int,y1:int>>"
ROWS = "stream_id string, frame bigint, idx int, label string, x0 int, y0 int, x1 int, y1 int, score double"


def _point(label: str, x: int, y: int) -> dict:
    return {"label": label, "x0": x, "y0": y, "x1": x, "y1": y}


def _tag(frames: DataFrame, tag: Callable[[np.ndarray], list[dict]]) -> DataFrame:
    @F.pandas_udf(BOXES)
    def f(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([[] if d is None else tag(P.image(d, *s)) for d, *s in zip(data, h, w, c, strict=True)], dtype=object)

    return frames.withColumn("bounding_boxes", f("data", "height", "width", "channels"))


def key_points(frames: DataFrame, blur: int = 5, low: float = 225, high: float = 250, least: float = 10, label: str = "object") -> DataFrame:
    """Centres of edge contours with an area above ``least``, as degenerate boxes."""
    return _tag(frames, lambda i: [_point(label, x, y) for x, y in P.key_points(i, blur, low, high, least)])


def good_key_points(frames: DataFrame, n: int = 100, quality: float = 0.3, apart: float = 3, label: str = "object") -> DataFrame:
    """Strong corners as degenerate boxes."""
    return _tag(frames, lambda i: [_point(label, int(x), int(y)) for x, y in P.corner_points(i, n, quality, apart)])


def size_movement(frames: DataFrame, large: float | None = None, least: float = 25) -> DataFrame:
    """Boxes of moving edges against the previous frame: 'large' above ``large``,
    else 'small'; without ``large`` the centres of areas above ``least`` as 'object'."""
    prev = frames.withColumn("_prev", F.lag("data").over(W.partitionBy("stream_id").orderBy("frame")))

    @F.pandas_udf(BOXES)
    def f(data: pd.Series, before: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for a, b, *s in zip(data, before, h, w, c, strict=True):
            got = [] if a is None or b is None else P.moving_boxes(P.image(a, *s), P.image(b, *s), least)
            if large is None:
                out.append([_point("object", (r[0] + r[2]) // 2, (r[1] + r[3]) // 2) for r, _ in got])
            else:
                out.append([{"label": "large" if area > large else "small", **dict(zip(("x0", "y0", "x1", "y1"), r, strict=True))} for r, area in got])
        return pd.Series(out, dtype=object)

    return prev.withColumn("bounding_boxes", f("data", "_prev", "height", "width", "channels")).drop("_prev")


def segment_foreground(frames: DataFrame, size: int, threshold: float = 21, share: float = 0.05, label: str = "foreground") -> DataFrame:
    """(stream_id, batch, label, x0, y0, x1, y1): the moving extent of each batch of
    ``size`` frames; batches without one have no row."""
    b = frames.withColumn("batch", F.floor(F.col("frame") / size))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        r = P.foreground(np.stack([P.image(d, h, w, c) for d, h, w, c in zip(p.data, p.height, p.width, p.channels, strict=True)]), threshold, share) if len(p) > 1 else None
        return pd.DataFrame([] if r is None else [(str(p.stream_id.iloc[0]), p.batch.iloc[0], label, *r)], columns=["stream_id", "batch", "label", "x0", "y0", "x1", "y1"])

    return b.select("stream_id", "batch", "frame", "height", "width", "channels", "data").groupBy("stream_id", "batch").applyInPandas(run, "stream_id string, batch bigint, label string, x0 int, y0 int, x1 int, y1 int")


def detect(frames: DataFrame, load: Callable[[], Callable[[list[np.ndarray]], list[list[tuple]]]], labels: list[str] | None = None, confidence: float = 0.0) -> DataFrame:
    """Rows (ROWS) from a batch detector: ``load`` gives, once per worker task, a
    function from images to lists of (x1, y1, x2, y2, score, label)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            b = b[b.data.notna()]
            found = model([P.image(r.data, r.height, r.width, r.channels) for r in b.itertuples()]) if len(b) else []
            rows = [
                (str(r.stream_id), r.frame, k, str(d[5]), *(int(v) for v in d[:4]), float(d[4]))
                for r, ds in zip(b.itertuples(), found, strict=True) for k, d in enumerate(ds)
                if d[4] >= confidence and (labels is None or d[5] in labels)
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])

    return frames.mapInPandas(run, ROWS)


def custom_tag(frames: DataFrame, size: int, tag: Column, name: str = "tag") -> DataFrame:
    """One tag per batch of ``size`` frames (-1: a second), on all its frames."""
    return batch_tag(frames, size, tag, name)


def fixed_tag(frames: DataFrame, label: str, box: tuple[int, int, int, int]) -> DataFrame:
    b = F.struct(F.lit(label).alias("label"), *[F.lit(v).alias(s) for v, s in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])
    return frames.withColumn("bounding_boxes", F.array(b))


def seeded_tags(frames: DataFrame, n: int = 10, side: int = 100, seed: int = 0) -> DataFrame:
    """``n`` made-up labels and boxes per frame, the same in every run; corners in order."""
    value = lambda k, i: F.pmod(F.xxhash64(F.lit(seed), "stream_id", "frame", F.lit(k), i), F.lit(side)).cast("int")
    letter = lambda i: F.char(F.lit(97) + F.pmod(F.xxhash64(F.lit(seed + 1), "stream_id", "frame", i), F.lit(26)))
    side_ = lambda a, b, f: lambda i: f(value(a, i), value(b, i))
    x0, x1, y0, y1 = side_(0, 1, F.least), side_(0, 1, F.greatest), side_(2, 3, F.least), side_(2, 3, F.greatest)
    tag = lambda i: F.struct(letter(i).alias("label"), x0(i).alias("x0"), y0(i).alias("y0"), x1(i).alias("x1"), y1(i).alias("y1"))
    return frames.withColumn("bounding_boxes", F.transform(F.sequence(F.lit(1), F.lit(n)), tag))


def explode_boxes(frames: DataFrame) -> DataFrame:
    """One row per box of ``bounding_boxes``, numbered."""
    keep = [c for c in frames.columns if c not in ("bounding_boxes", "data")]
    return frames.select(*keep, F.posexplode("bounding_boxes").alias("idx", "_b")).select(*keep, "idx", "_b.*")


def pixel_change(frames: DataFrame, name: str = "change") -> DataFrame:
    """Mean absolute difference of blurred gray frames against the previous one;
    ``events.shots`` cuts on it."""
    prev = frames.withColumn("_prev", F.lag("data").over(W.partitionBy("stream_id").orderBy("frame")))

    @F.pandas_udf("double")
    def f(data: pd.Series, before: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        rows = zip(data, before, h, w, c, strict=True)
        return pd.Series([None if a is None or b is None else P.mean_change(P.image(a, *s), P.image(b, *s)) for a, b, *s in rows], dtype=float)

    return prev.withColumn(name, f("data", "_prev", "height", "width", "channels")).drop("_prev")


def average_change(frames: DataFrame, first: int = 100) -> DataFrame:
    """(stream_id, average) of the change over the first frames."""
    return pixel_change(frames.filter(F.col("frame") < first)).groupBy("stream_id").agg(F.avg("change").alias("average"))


def tile_features(frames: DataFrame, cell: int = 8) -> DataFrame:
    """(stream_id, frame, tile, feature): gradient histograms for matching frames."""

    @F.pandas_udf("array<array<double>>")
    def f(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([[list(map(float, v)) for v in P.hog(P.image(d, *s), cell)] for d, *s in zip(data, h, w, c, strict=True)], dtype=object)

    t = frames.filter("data IS NOT NULL").withColumn("_t", f("data", "height", "width", "channels"))
    return t.select("stream_id", "frame", F.posexplode("_t").alias("tile", "feature"))
