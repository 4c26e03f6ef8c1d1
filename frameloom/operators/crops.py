"""Clip building: crops of batches, merged over consecutive similar batches.

The folds depend on order and carry state, so they run per stream over rows
sorted by batch; a stream's state is a few boxes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.operators.fold import coded, fold_arrays, plain

IOU, SIDE, LEAST = 0.7, 0.05, 10
CROPS = "stream_id string, batch bigint, idx int, label string, x0 int, y0 int, x1 int, y1 int"


def _area(a):
    return abs((a[2] - a[0]) * (a[3] - a[1]))


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    u = _area(a) + _area(b) - i
    return i / u if u else 0.0


def _around(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def cluster(objects: list[tuple[int, str, tuple]], compat: bool = False) -> list[tuple[str, tuple]]:
    """Objects (frame, label, box) of a batch in order, as growing crops: each
    joins the first crop of its label with an IoU above 0.7. Objects under 10
    pixels on a side are left out; with ``compat`` so is the rest of their frame."""
    out: list[list] = []
    stopped = None
    for frame, label, b in objects:
        if compat and frame == stopped:
            continue
        if b[2] - b[0] < LEAST or b[3] - b[1] < LEAST:
            stopped = frame
            continue
        for c in out:
            if c[0] == label and _iou(c[1], b) > IOU:
                c[1] = _around(c[1], b)
                break
        else:
            out.append([label, b])
    return [tuple(c) for c in out]


def similar(a: list[tuple[str, tuple]], b: list[tuple[str, tuple]]) -> list[tuple[str, tuple]] | None:
    """Union boxes if the crops of two batches pair off one to one, else None."""
    if sorted(x for x, _ in a) != sorted(x for x, _ in b):
        return None
    left, out = list(b), []
    for label, p in a:
        w, h = p[2] - p[0], p[3] - p[1]
        for k, (other, q) in enumerate(left):
            fits = other == label and w and h and _iou(p, q) > IOU
            if fits and abs(q[2] - q[0] - w) / w < SIDE and abs(q[3] - q[1] - h) / h < SIDE:
                out.append((label, _around(p, q)))
                del left[k]
                break
        else:
            return None
    return out


def batch_crops(detections: DataFrame, size: int, compat: bool = False) -> DataFrame:
    """Crops of each batch of ``size`` frames (CROPS), by ``cluster``."""
    d = detections.withColumn("batch", F.floor(F.col("frame") / size))

    def run(b: pa.RecordBatch, starts: np.ndarray) -> dict[str, pa.Array]:
        sides = [b.column(c).to_numpy(zero_copy_only=False) for c in B.SIDES]
        label, labels = coded(b.column("label"))
        rows = np.arange(b.num_rows)
        if not compat:
            rows = np.flatnonzero(~((sides[2] - sides[0] < LEAST) | (sides[3] - sides[1] < LEAST)))
        group = (np.searchsorted(starts, rows, side="right") - 1).astype(np.int64)
        own = np.bincount(group, minlength=len(starts))
        # an object that is alone in its batch is a crop as it is
        alone = rows[own[group] == 1] if not compat else rows[:0]
        many = rows[own[group] > 1] if not compat else rows
        at, number, codes, boxes = [], [], [], []
        objects = list(zip(plain(b.column("frame").take(pa.array(many))), label[many].tolist(), zip(*[s[many].tolist() for s in sides], strict=True), strict=True))
        size = own[own > (0 if compat else 1)]
        ends = np.cumsum(size)
        for lo, hi in zip((ends - size).tolist(), ends.tolist(), strict=True):
            got = cluster(objects[lo:hi], compat)
            at += [lo] * len(got)
            number += range(len(got))
            codes += [c for c, _ in got]
            boxes += [x for _, x in got]
        at = pa.array(np.append(alone, many[np.array(at, np.int64)]))
        codes = np.append(label[alone], np.array(codes, np.int64))
        boxes = np.array(boxes, sides[0].dtype).reshape(-1, 4)
        out = {c: b.column(c).take(at) for c in ("stream_id", "batch")}
        out |= {"idx": pa.array(np.append(np.zeros(len(alone), np.int64), np.array(number, np.int64))), "label": labels.take(pa.array(codes, mask=codes < 0))}
        return out | {c: pa.array(np.append(s[alone], x), from_pandas=True) for c, s, x in zip(B.SIDES, sides, boxes.T, strict=True)}

    order = ["frame", "idx", "label", *B.SIDES]
    rows = d.select("stream_id", "batch", *order)
    return _named(fold_arrays(rows, ["stream_id", "batch"], order, _typed(CROPS, rows), run))


def _typed(schema: str, rows: DataFrame) -> str:
    """``schema`` with the stream's type as in ``rows``; ``_named`` makes it a string."""
    return schema.replace("stream_id string", f"stream_id {dict(rows.dtypes)['stream_id']}")


def _named(d: DataFrame) -> DataFrame:
    return d.withColumn("stream_id", F.col("stream_id").cast("string"))


def union_crops(detections: DataFrame, size: int) -> DataFrame:
    """One crop around all boxes of each batch, labelled 'foreground'."""
    d = detections.withColumn("batch", F.floor(F.col("frame") / size))
    return d.groupBy("stream_id", "batch").agg(*B.union_of(F.struct(*B.SIDES))).withColumn("label", F.lit("foreground"))


def first_frame_crops(detections: DataFrame, size: int) -> DataFrame:
    """The objects of each batch's first frame."""
    d = detections.withColumn("batch", F.floor(F.col("frame") / size))
    first = F.min("frame").over(W.partitionBy("stream_id", "batch"))
    return d.withColumn("_first", first).filter("frame = _first").drop("_first")


def merge_runs(crops: DataFrame, batches: DataFrame, join: str = "crops") -> DataFrame:
    """(stream_id, batch, run): consecutive batches that merge have one run.

    ``batches`` has every (stream_id, batch), also those without crops. ``join``:
    'crops' pairs crops off (``similar``), 'union' does so for the single union
    crop, 'null' never merges. A run's state grows to the union boxes.
    """
    if join == "null":
        return batches.select("stream_id", "batch", F.col("batch").alias("run")).distinct()

    def run(b: pa.RecordBatch, starts: np.ndarray) -> dict[str, pa.Array]:
        batch = b.column("batch").to_numpy(zero_copy_only=False)
        new = np.append(True, batch[1:] != batch[:-1])
        new[starts] = True
        at = np.flatnonzero(new)
        label = coded(b.column("label"))[0].tolist()
        crop = list(zip(label, zip(*[plain(b.column(s)) for s in B.SIDES], strict=True), strict=True))
        given = b.column("x0").is_valid().to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(given))[np.append(at, b.num_rows)].tolist()
        crop = [c for c, g in zip(crop, given.tolist(), strict=True) if g]
        asked = np.logical_or.reduceat(b.column("_asked").to_numpy(zero_copy_only=False), at)
        stream = np.searchsorted(starts, at, side="right").tolist()
        runs, state, number, current = [], None, -1, -1
        for known, s, lo, hi in zip(asked.tolist(), stream, bounds, bounds[1:]):  # noqa: B905
            if s != current:
                current, state, number = s, None, -1
            if known:
                own = crop[lo:hi]
                merged = None if state is None else similar(state, own)
                if merged is None:
                    number, state = number + 1, own
                else:
                    state = merged
            runs.append(number)
        kept = pa.array(at[asked])
        return {c: b.column(c).take(kept) for c in ("stream_id", "batch")} | {"run": pa.array(np.array(runs, np.int64)[asked])}

    c = crops if "idx" in crops.columns else crops.withColumn("idx", F.lit(0))
    c = c.select("stream_id", "batch", "idx", "label", *B.SIDES)
    if batches is crops:
        rows = c.withColumn("_asked", F.lit(True))
    else:
        rows = _named(c).withColumn("_asked", F.lit(False)).unionByName(_named(batches.select("stream_id", "batch")).withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    rows = rows.filter("batch IS NOT NULL")
    return _named(fold_arrays(rows, ["stream_id"], ["batch", "idx"], _typed("stream_id string, batch bigint, run bigint", rows), run))


def run_boxes(crops: DataFrame, runs: DataFrame) -> DataFrame:
    """Union box per run and crop index, over the batches of the run."""
    c = crops.join(runs, ["stream_id", "batch"])
    return c.groupBy("stream_id", "run", "idx").agg(F.min("label").alias("label"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"), *B.union_of(F.struct(*B.SIDES)))
