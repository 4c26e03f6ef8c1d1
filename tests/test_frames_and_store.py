"""Frame source, pixel maps, clip store, plans and readers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.catalog import ClipStore, Condition, contiguity
from frameloom.functions import pixels as P
from frameloom.operators import maps as M
from frameloom.plans import Metric, Op, Pipeline, crop_push_down, validate
from frameloom.sources import register, track_json


@pytest.fixture(scope="module")
def frames(spark):
    register(spark)
    return spark.read.format("frames").option("streams", "a,b").option("frames", 30).load()


def test_source_pushes_frame_ranges(spark, frames):
    assert frames.filter("frame >= 10 AND frame < 15").count() == 10
    own = spark.read.format("frames").option("frames", 30).option("pushdown", "true").load()
    assert own.filter("frame >= 10 AND frame < 15").count() == 5
    assert sorted(r.frame for r in spark.read.format("frames").option("rows", "3,7").load().collect()) == [3, 7]
    assert spark.read.format("frames").option("offset", 5).option("limit", 8).load().count() == 3


def test_pixel_maps(frames):
    one = frames.filter("stream_id = 'a' AND frame = 2")
    c = M.crop(one, 4, 10, 20, 100).head()
    assert (c.height, c.width, c.origin.x, c.origin.y) == (38, 16, 4, 10) and len(c.data) == 38 * 16 * 3
    g = M.grayscale(one).head()
    assert g.channels == 1 and max(g.data) == 255
    assert M.resize(one, 0.5).head().width == 32
    m = P.image(M.mask(one, 0, 0, 8, 48).head().data, 48, 64, 3)
    assert m[:, 8:].max() == 0 and m.max() == 255
    assert M.motion_vectors(M.grayscale(frames.filter("stream_id = 'a' AND frame < 3"))).filter(F.size("motion_vectors") > 0).count() >= 1


def test_pixel_functions():
    i = np.zeros((40, 40), np.uint8)
    i[10:30, 10:30] = 255
    assert P.canny(P.blur(i), 50, 100).max() == 255
    x, y = P.key_points(i, 5, 50, 100)[0]
    assert abs(x - 20) <= 2 and abs(y - 20) <= 2
    moved = np.roll(i, 2, 1)
    dx = [v[2] - v[0] for v in P.flow(i, moved, 10)]
    assert dx and abs(float(np.median(dx)) - 2) < 0.7
    assert P.foreground(np.stack([i, moved, i, moved]), 10, 0.5) is not None
    assert P.foreground(np.stack([i, i]), 10, 0.5) is None
    assert P.hog(i).shape == (25, 9) and P.quantize(i, 2).max() == 255


def test_store(spark, frames, tmp_path):
    det = spark.createDataFrame([("a", f, 0, "car", 10, 10, 30, 30) for f in range(30)], "stream_id string, frame bigint, idx int, label string, x0 int, y0 int, x1 int, y1 int")
    s = ClipStore(spark, str(tmp_path / "store"))
    s.put(frames, det, 10)
    assert [r.video_name for r in s.list().collect()] == ["a", "b"]
    assert s.table("clip").filter("video_name = 'a'").count() == 2
    assert s.get("a", Condition(label="car")).count() == 30
    assert s.get("a", Condition(label="dog")).count() == 0
    assert s.get("a", Condition(label="car", time=(12, 14))).count() == 30  # a clip around the window counts
    assert s.get("a", Condition(label="car", crop=(0, 0, 5, 5))).count() == 0
    assert s.size("a") > 0
    s.put(frames, det, 10)  # a repeated put changes nothing
    assert s.table("clip").filter("video_name = 'a'").count() == 2
    s.set_quality("a", 0.5)
    assert s.get("a", Condition(label="car")).head().width == 32
    s.delete("a")
    assert [r.video_name for r in s.list().collect()] == ["b"]
    c = Condition(label="x", crop=(1, 2, 3, 4))
    assert Condition.from_json(c.to_json()) == c


def test_fixed_crops_and_chains(spark, frames, tmp_path):
    s = ClipStore(spark, str(tmp_path / "store"))
    s.put_fixed(frames, [("left", (0, 0, 20, 48)), ("right", (20, 0, 64, 48))], 10)
    assert s.query_background("a", background_id=0).count() == 2
    c = spark.createDataFrame([("v", 0, 0, 10), ("v", 1, 12, 20), ("v", 2, 40, 50)], "video_name string, clip_id int, start_time int, end_time int")
    assert [r.chain for r in contiguity(c).orderBy("clip_id").collect()] == [1, 1, 2]


def test_plans():
    p = Pipeline()[Metric("metric", {"name": "one", "region": (10, 10, 20, 20)})][Metric("metric", {"name": "two", "region": (50, 5, 60, 40)})][Op("filter", {"metric": "two", "kernel": [1.0], "threshold": 0.5})]
    validate(p)
    first = crop_push_down(p).ops[0]
    assert first.name == "crop" and first.args == {"x0": 9, "y0": 4, "x1": 66, "y1": 44}
    with pytest.raises(ValueError):
        validate(Pipeline()[Metric("metric", {"name": "a", "region": (0, 0, 1, 1)})][Op("filter", {"metric": "b"})])


def test_tracks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([None, [{"track_id": 1, "left": 5, "top": 6, "right": 9, "bottom": 10}]]))
    r = track_json(spark, str(tmp_path / "t.json"), "s").collect()
    assert [(x.frame, x.x0, x.y1) for x in r] == [(1, 2, 5)]


def test_taggers(spark, frames):
    from frameloom.operators import media, taggers

    a = frames.filter("stream_id = 'a' AND frame < 6")
    k = taggers.explode_boxes(taggers.key_points(a, low=50, high=100)).collect()
    assert {r.frame for r in k} == set(range(6)) and all(abs(r.y0 - 24) <= 3 for r in k)
    seg = taggers.segment_foreground(a, 6).collect()
    assert len(seg) == 1 and seg[0].y0 >= 15 and seg[0].y1 <= 32
    got = taggers.detect(a, lambda: lambda images: [[(0, 0, i.shape[1], i.shape[0], 0.9, "all"), (0, 0, 1, 1, 0.1, "low")] for i in images], confidence=0.5)
    assert got.count() == 6 and got.head().x1 == 64
    assert taggers.average_change(a).head().average > 0
    assert taggers.size_movement(a, large=10.0, least=1).filter(F.size("bounding_boxes") > 0).count() >= 1
    one, two = (taggers.explode_boxes(taggers.seeded_tags(a.drop("data"), seed=4)).collect() for _ in range(2))
    assert sorted(one) == sorted(two) and all(r.x0 <= r.x1 for r in one)
    assert taggers.tile_features(a.filter("frame = 0")).count() == 48
    p = media.properties(a).head()
    assert (p.frames, p.width) == (6, 64)
    assert media.auto_split(a, F.col("frame") == 3, 2).select("segment", "clip").distinct().count() == 4
