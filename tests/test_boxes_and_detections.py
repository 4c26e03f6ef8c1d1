"""Box algebra, suppression, crops and evaluation on literal cases."""

import pytest
from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.operators import crops as C
from frameloom.operators import detections as D


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()


def test_box_algebra(spark):
    a, b = B.box(0, 0, 49, 49), B.box(1, 1, 50, 50)
    r = one(spark, B.area(a), B.intersect_area(a, b), B.iou(a, b), B.contains(a, b), B.intersects(a, B.box(49, 49, 60, 60)), B.spread(B.box(3, 3, 4, 4), 2)["x0"])
    assert r.c0 == 2401 and r.c1 == 48 * 48 and r.c2 == pytest.approx(2304 / 2498) and r.c3 is False and r.c4 is True and r.c5 == 1
    with pytest.raises(Exception, match="inverted"):
        one(spark, B.checked(B.box(5, 0, 1, 1)))


def test_empty_boxes_have_no_iou(spark):
    p = B.box(1, 1, 1, 1)
    assert one(spark, B.iou(p, p)).c0 is None


def test_clusters_and_runs():
    batch = [(0, "test", (0, 0, 49, 49)), (1, "test", (1, 1, 50, 50)), (2, "test1", (0, 0, 49, 49)), (3, "test1", (1, 1, 49, 49))]
    crops = C.cluster(batch)
    assert crops == [("test", (0, 0, 50, 50)), ("test1", (0, 0, 49, 49))]
    assert C.similar(crops, crops) == crops
    assert C.similar(crops, crops[:1]) is None
    small = [(0, "a", (0, 0, 5, 5)), (0, "a", (0, 0, 40, 40))]
    assert C.cluster(small) == [("a", (0, 0, 40, 40))] and C.cluster(small, compat=True) == []


def brute_nms(rows, threshold):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[1:5])):
        if all(C._iou(r[1:5], k[1:5]) <= threshold for k in kept):
            kept.append(r)
    return sorted(kept)


def test_nms_and_votes(spark):
    import random

    rng = random.Random(3)
    rows = []
    for g in range(6):
        for _ in range(30):
            x, y, s = rng.randrange(40), rng.randrange(40), rng.randrange(5, 30)
            rows.append((g, x, y, x + s, y + s, round(rng.random(), 3)))
    d = spark.createDataFrame(rows, "g bigint, x0 int, y0 int, x1 int, y1 int, score double")
    got = sorted(tuple(r) for r in D.nms(d, ["g"], 0.4).collect())
    assert got == sorted(r for g in range(6) for r in brute_nms([q for q in rows if q[0] == g], 0.4))
    two = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 0, 0, 10, 12, 0.1)], "g int, det_id int, x0 int, y0 int, x1 int, y1 int, score double")
    v = D.box_voting(two.filter("det_id = 1"), two, ["g"], 0.5).head()
    assert v.y1 == pytest.approx(10.2) and v.score == pytest.approx(0.5)


def test_average_precision(spark):
    d = spark.createDataFrame([("c", 1, 0.9, 1.0), ("c", 2, 0.8, 0.0), ("c", 3, 0.7, 1.0)], "c string, det_id int, score double, hit double")
    n = spark.createDataFrame([("c", 2.0)], "c string, n_truth double")
    ap = D.average_precision(D.precision_recall(d, ["c"], n), ["c"]).head().ap
    assert ap == pytest.approx(0.5 * 1 + 0.5 * (2 / 3))


def test_bipartite(spark):
    s = spark.createDataFrame([(0, 0, 0, 0.9), (0, 0, 1, 0.8), (0, 1, 0, 0.7), (0, 1, 1, 0.1), (0, 0, 2, 0.0)], "g int, row int, col int, similarity double")
    assert {(r.col, r.row) for r in D.bipartite_match(s, ["g"]).collect()} == {(0, 0), (1, 1), (2, -1)}
    forced = D.argmax_match(s, ["g"], 0.95, 0.5, force=True)
    assert {(r.col, r.row) for r in forced.collect()} >= {(0, 0)}


def test_hierarchy(spark):
    e = spark.createDataFrame([("cat", "animal"), ("animal", "thing"), ("dog", "animal")], "label string, parent string")
    x = spark.createDataFrame([(1, "cat")], "image int, label string")
    assert {r.label for r in D.expand_boxes(x, e).collect()} == {"cat", "animal", "thing"}
    i = spark.createDataFrame([(1, "animal", 0)], "image int, label string, confidence int")
    assert {r.label for r in D.expand_image_labels(i, e).collect()} == {"cat", "dog", "animal"}
    assert D.label_map(spark.createDataFrame([(0, "bg", None, 0), (1, "a", "A", 1), (1, "b", None, 2)], "id int, name string, display_name string, seq int"), 5).collect()[0].name == "A"


def test_group_of_and_difficult(spark):
    t = spark.createDataFrame([(1, 1, 0, 0, 10, 10, False, False), (1, 2, 20, 20, 30, 30, True, False), (1, 3, 40, 40, 90, 90, False, True)], "g int, gt_id int, x0 int, y0 int, x1 int, y1 int, difficult boolean, group_of boolean")
    d = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 0, 0, 10, 11, 0.8), (1, 3, 20, 20, 30, 30, 0.7), (1, 4, 50, 50, 60, 60, 0.6)], "g int, det_id int, x0 int, y0 int, x1 int, y1 int, score double")
    got = {r.det_id: r.status for r in D.true_positives(d, t, ["g"], 0.5).collect()}
    assert got == {1: "tp", 2: "fp", 3: "ignored", 4: "ignored"}
    assert D.group_of_weights(d, t, ["g"], 0.5, 0.4).head().score == 0.6


def test_keypoints_and_masks(spark):
    k = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    r = one(spark, B.keypoints_rotate_90(k), B.keypoints_flip(k, [0], 5.0), B.mask_iou(F.array(F.lit(7).cast("bigint")), F.array(F.lit(3).cast("bigint"))))
    assert r.c0[0].x == 2.0 and r.c1[0].x == 9.0 and r.c2 == pytest.approx(2 / 3)


def test_evaluate_and_mask_nms(spark):
    t = spark.createDataFrame([("c", 1, 1, 0, 0, 10, 10), ("c", 2, 1, 0, 0, 10, 10), ("e", 1, 1, 0, 0, 5, 5)], "label string, image int, gt_id int, x0 int, y0 int, x1 int, y1 int")
    d = spark.createDataFrame([("c", 1, 1, 0, 0, 10, 10, 0.9), ("c", 2, 1, 50, 50, 60, 60, 0.8)], "label string, image int, det_id int, x0 int, y0 int, x1 int, y1 int, score double")
    got = {r.label: (r.ap, r.corloc, r.n_truth) for r in D.evaluate(d, t).collect()}
    assert got == {"c": (0.5, 0.5, 2.0), "e": (0.0, 0.0, 1.0)}
    m = spark.createDataFrame([(1, 1, 0.9, [7]), (1, 2, 0.8, [3]), (1, 3, 0.7, [56])], "g int, det_id int, score double, mask array<bigint>")
    assert {r.det_id for r in D.mask_nms(m, ["g"], 0.5).collect()} == {1, 3}
