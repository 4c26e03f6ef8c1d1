"""Box algebra as column expressions on structs (x0, y0, x1, y1).

Nothing here is a UDF: Catalyst sees, prunes and compiles every expression.
Areas have no +1 unless ``plus=1`` is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0, y0, x1, y1) -> Column:
    """Whole-number box; coordinates are truncated."""
    return F.struct(*[_c(v).cast("int").alias(n) for v, n in zip((x0, y0, x1, y1), SIDES, strict=True)])


def fbox(x0, y0, x1, y1) -> Column:
    """Box with fractional coordinates."""
    return F.struct(*[_c(v).cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), SIDES, strict=True)])


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v) if not isinstance(v, str) else F.col(v)


def checked(b: Column) -> Column:
    """The box, or an error if it is inverted."""
    return F.when(valid(b), b).otherwise(F.raise_error(F.lit("inverted box")).cast("struct<x0:int,y0:int,x1:int,y1:int>"))


def valid(b: Column) -> Column:
    return (b["x0"] <= b["x1"]) & (b["y0"] <= b["y1"])


def shift(b: Column, x, y) -> Column:
    """Coordinates relative to the origin (x, y)."""
    return box(b["x0"] - _c(x), b["y0"] - _c(y), b["x1"] - _c(x), b["y1"] - _c(y))


def x_translate(b: Column, by) -> Column:
    return box(b["x0"] + _c(by), b["y0"], b["x1"] + _c(by), b["y1"])


def y_translate(b: Column, by) -> Column:
    return box(b["x0"], b["y0"] + _c(by), b["x1"], b["y1"] + _c(by))


def area(b: Column, plus: int = 0) -> Column:
    return F.abs((b["x1"] - b["x0"] + plus) * (b["y1"] - b["y0"] + plus))


def spread(b: Column, factor) -> Column:
    """Low corner divided by ``factor``, high corner multiplied."""
    f = _c(factor)
    return box(b["x0"] / f, b["y0"] / f, b["x1"] * f, b["y1"] * f)


def pad(b: Column, by) -> Column:
    return box(b["x0"] - _c(by), b["y0"] - _c(by), b["x1"] + _c(by), b["y1"] + _c(by))


def contains(a: Column, b: Column) -> Column:
    """Corners of b within a, borders included."""
    return (b["x0"] >= a["x0"]) & (b["x1"] <= a["x1"]) & (b["y0"] >= a["y0"]) & (b["y1"] <= a["y1"])


def intersects(a: Column, b: Column) -> Column:
    """The boxes overlap or touch."""
    return (a["x1"] >= b["x0"]) & (b["x1"] >= a["x0"]) & (a["y1"] >= b["y0"]) & (b["y1"] >= a["y0"])


def intersect_area(a: Column, b: Column, plus: int = 0) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) + plus
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) + plus
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def union_area(a: Column, b: Column, plus: int = 0) -> Column:
    return area(a, plus) + area(b, plus) - intersect_area(a, b, plus)


def union_box(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def union_of(b: Column) -> list[Column]:
    """Aggregates for the box around all boxes of a group."""
    return [F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1")]


def iou(a: Column, b: Column, plus: int = 0) -> Column:
    """Intersection over union; null if the union is empty."""
    i = intersect_area(a, b, plus).cast("double")
    return F.try_divide(i, union_area(a, b, plus).cast("double"))


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of b."""
    return F.try_divide(intersect_area(a, b).cast("double"), area(b).cast("double"))


def serialize(b: Column) -> Column:
    return F.to_json(b)


def height_width(b: Column) -> Column:
    return F.struct((b["y1"] - b["y0"]).alias("height"), (b["x1"] - b["x0"]).alias("width"))


def scale(b: Column, y, x) -> Column:
    return fbox(b["x0"] * _c(x), b["y0"] * _c(y), b["x1"] * _c(x), b["y1"] * _c(y))


def clip_to(b: Column, window: Column) -> Column:
    """Corners moved into the window."""
    inside = lambda v, lo, hi: F.greatest(F.least(v, hi), lo)
    return F.struct(
        inside(b["x0"], window["x0"], window["x1"]).alias("x0"), inside(b["y0"], window["y0"], window["y1"]).alias("y0"),
        inside(b["x1"], window["x0"], window["x1"]).alias("x1"), inside(b["y1"], window["y0"], window["y1"]).alias("y1"),
    )


def outside(b: Column, window: Column) -> Column:
    """Fully outside; touching counts."""
    return (b["x0"] >= window["x1"]) | (b["x1"] <= window["x0"]) | (b["y0"] >= window["y1"]) | (b["y1"] <= window["y0"])


def change_frame(b: Column, window: Column) -> Column:
    """Coordinates as shares of the window."""
    w, h = (window["x1"] - window["x0"]).cast("double"), (window["y1"] - window["y0"]).cast("double")
    return fbox((b["x0"] - window["x0"]) / w, (b["y0"] - window["y0"]) / h, (b["x1"] - window["x0"]) / w, (b["y1"] - window["y0"]) / h)


def normalized(b: Column, height, width) -> Column:
    return scale(b, F.lit(1.0) / _c(height), F.lit(1.0) / _c(width))


def absolute(b: Column, height, width) -> Column:
    return scale(b, height, width)


def square_distance(a: Column, b: Column) -> Column:
    return sum(((a[s] - b[s]) * (a[s] - b[s]) for s in SIDES[1:]), (a["x0"] - b["x0"]) * (a["x0"] - b["x0"]))


def thresholded_iou(a: Column, b: Column, score: Column, threshold: float) -> Column:
    """The first box's score where the IoU is above the threshold, else 0."""
    return F.when(iou(a, b) > threshold, score).otherwise(F.lit(0.0))


def flip_left_right(b: Column, width=1.0) -> Column:
    return fbox(_c(width) - b["x1"], b["y0"], _c(width) - b["x0"], b["y1"])


def flip_up_down(b: Column, height=1.0) -> Column:
    return fbox(b["x0"], _c(height) - b["y1"], b["x1"], _c(height) - b["y0"])


def rotate_90(b: Column, width=1.0) -> Column:
    """Counter-clockwise by 90 degrees."""
    return fbox(b["y0"], _c(width) - b["x1"], b["y1"], _c(width) - b["x0"])


def from_centre(x, y, w, h) -> Column:
    """Corners from centre and size."""
    x, y, w, h = map(_c, (x, y, w, h))
    return fbox(x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def encode_anchor(b: Column, anchor: Column) -> Column:
    """Centre offsets in anchor sizes and log2 size ratios."""
    cx, cy = lambda r: (r["x0"] + r["x1"]) / 2.0, lambda r: (r["y0"] + r["y1"]) / 2.0
    w, h = lambda r: r["x1"] - r["x0"], lambda r: r["y1"] - r["y0"]
    return F.struct(((cx(b) - cx(anchor)) / w(anchor)).alias("x"), ((cy(b) - cy(anchor)) / h(anchor)).alias("y"), F.log2(w(b) / w(anchor)).alias("w"), F.log2(h(b) / h(anchor)).alias("h"))


def decode_anchor(e: Column, anchor: Column) -> Column:
    w, h = anchor["x1"] - anchor["x0"], anchor["y1"] - anchor["y0"]
    cx, cy = (anchor["x0"] + anchor["x1"]) / 2.0, (anchor["y0"] + anchor["y1"]) / 2.0
    return from_centre(e["x"] * w + cx, e["y"] * h + cy, F.pow(F.lit(2.0), e["w"]) * w, F.pow(F.lit(2.0), e["h"]) * h)


def box_rmse(a: Column, b: Column) -> Column:
    """Root of the squared differences of centre and size."""
    d = lambda u, v: F.pow(u - v, F.lit(2.0))
    c = lambda r: ((r["x0"] + r["x1"]) / 2.0, (r["y0"] + r["y1"]) / 2.0, (r["x1"] - r["x0"]) * 1.0, (r["y1"] - r["y0"]) * 1.0)
    parts = [d(u, v) for u, v in zip(c(a), c(b), strict=True)]
    return F.sqrt(parts[0] + parts[1] + parts[2] + parts[3])


# keypoints: arrays of structs (x, y)


def keypoints_scale(k: Column, y, x) -> Column:
    return F.transform(k, lambda p: F.struct((p["x"] * _c(x)).alias("x"), (p["y"] * _c(y)).alias("y")))


def keypoints_clip(k: Column, window: Column) -> Column:
    return F.transform(k, lambda p: F.struct(F.greatest(F.least(p["x"], window["x1"]), window["x0"]).alias("x"), F.greatest(F.least(p["y"], window["y1"]), window["y0"]).alias("y")))


def keypoints_prune(k: Column, window: Column) -> Column:
    """Points outside the window become NaN."""
    nan = F.lit(float("nan"))
    inside = lambda p: (p["x"] >= window["x0"]) & (p["x"] <= window["x1"]) & (p["y"] >= window["y0"]) & (p["y"] <= window["y1"])
    return F.transform(k, lambda p: F.struct(F.when(inside(p), p["x"].cast("double")).otherwise(nan).alias("x"), F.when(inside(p), p["y"].cast("double")).otherwise(nan).alias("y")))


def keypoints_change_frame(k: Column, window: Column) -> Column:
    w, h = window["x1"] - window["x0"], window["y1"] - window["y0"]
    return F.transform(k, lambda p: F.struct(((p["x"] - window["x0"]) / w).alias("x"), ((p["y"] - window["y0"]) / h).alias("y")))


def keypoints_flip(k: Column, order: list[int], centre: float = 0.5, vertical: bool = False) -> Column:
    """Mirrored around ``centre``, taken in the given order."""
    x = lambda p: p["x"] if vertical else F.lit(2 * centre) - p["x"]
    y = lambda p: F.lit(2 * centre) - p["y"] if vertical else p["y"]
    turned = F.transform(k, lambda p: F.struct(x(p).alias("x"), y(p).alias("y")))
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(turned, i))


def keypoints_rotate_90(k: Column) -> Column:
    return F.transform(k, lambda p: F.struct(p["y"].alias("x"), (F.lit(1.0) - p["x"]).alias("y")))


# masks: arrays of longs, 64 pixels each


def mask_area(m: Column) -> Column:
    return F.aggregate(m, F.lit(0).cast("bigint"), lambda a, x: a + F.bit_count(x))


def mask_intersection(a: Column, b: Column) -> Column:
    return mask_area(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))


def mask_iou(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    i = mask_intersection(a, b)
    return i / F.greatest((mask_area(a) + mask_area(b) - i).cast("double"), F.lit(epsilon))


def mask_ioa(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    return mask_intersection(a, b) / F.greatest(mask_area(b).cast("double"), F.lit(epsilon))
