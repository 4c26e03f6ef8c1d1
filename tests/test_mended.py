"""Null keys, repeated puts, catalog changes, joins by blocks, readers, writers and streams."""

import random
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.catalog import ClipStore, Condition
from frameloom.operators import aggregates, detections, joins, media
from frameloom.operators.fold import fold_groups
from frameloom.plans import Op, Pipeline, validate
from frameloom.sources import tables
from frameloom.streaming import events

FRAME = "stream_id string, frame bigint, height int, width int, channels int, origin struct<x:int,y:int>, data binary"
DETECTION = "stream_id string, frame bigint, idx int, label string, x0 int, y0 int, x1 int, y1 int"


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(s, f, 8, 8, 1, (0, 0), bytes(64)) for s in ("a", "b") for f in range(30)]
    return spark.createDataFrame(rows, FRAME)


def test_suppression_with_a_null_in_the_key(spark):
    rows = [("s", None, 0, 0, 10, 10, 0.9), ("s", None, 0, 0, 10, 10, 0.8), (None, "x", 0, 0, 10, 10, 0.7), (None, "x", 0, 0, 10, 10, 0.6), (None, None, 0, 0, 10, 10, 0.5), ("s", "x", 0, 0, 10, 10, 0.4)]
    d = spark.createDataFrame(rows, "stream_id string, label string, x0 int, y0 int, x1 int, y1 int, score double")
    assert sorted(r.score for r in detections.nms(d, ["stream_id", "label"], 0.5).collect()) == [0.4, 0.5, 0.7, 0.9]


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, n) for k, many in ((1, 10), (2, 1), (None, 7), (4, 3), (5, 6)) for n in range(many)]
        d = spark.createDataFrame(rows, "k int, n int").coalesce(1)
        one = lambda p: pd.DataFrame({"k": p["k"].iloc[:1], "n": [len(p)], "s": [",".join(map(str, p["n"]))]})
        got = fold_groups(d, ["k"], ["n"], "k int, n int, s string", one).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r.k or 0), r.n) for r in got) == [(0, 7), (1, 10), (2, 1), (4, 3), (5, 6)]
    assert all(r.s == ",".join(map(str, range(r.n))) for r in got)


def test_second_put_without_detections_leaves_no_labels(spark, frames, tmp_path):
    s = ClipStore(spark, str(tmp_path / "store"))
    det = spark.createDataFrame([("a", f, 0, "car", 10, 10, 30, 30) for f in range(30)] + [("b", f, 0, "bus", 10, 10, 30, 30) for f in range(30)], DETECTION)
    s.put(frames, det, 10)
    assert s.get("a", Condition(label="car")).count() == 30
    s.put(frames.filter("stream_id = 'a'"), det.limit(0), 10)
    assert s.table("label").filter("video_name = 'a'").count() == 0
    assert s.table("background").filter("video_name = 'a'").count() == 0
    assert s.table("label").filter("video_name = 'b'").count() == 1 and s.get("b", Condition(label="bus")).count() == 30
    clips = {r.clip_id for r in s.table("clip").filter("video_name = 'a'").collect()}
    assert {r.clip_id for r in s.get("a").collect()} == clips


def test_catalog_changes(spark, frames, tmp_path):
    s = ClipStore(spark, str(tmp_path / "store"))
    s.put_fixed(frames, [("left", (0, 0, 4, 8)), ("right", (4, 0, 8, 8))], 10)
    s.insert("label", spark.createDataFrame([("extra", 1, "a"), ("left", 1, "a")], "label string, clip_id bigint, video_name string"))
    assert sorted((r.label, r.clip_id) for r in s.table("label").filter("video_name = 'a'").collect()) == [("extra", 1), ("left", 1), ("right", 2)]
    s.update("clip", (F.col("clip_id") == 1) & (F.col("video_name") == "a"), {"other": F.lit("note"), "end_time": F.col("end_time") - 1})
    assert {(r.video_name, r.clip_id): (r.other, r.end_time) for r in s.table("clip").filter("clip_id = 1").collect()} == {("a", 1): ("note", 29), ("b", 1): (None, 30)}
    with pytest.raises(ValueError):
        s.update("clip", F.lit(True), {"video_name": F.lit("c")})
    all_ = {(r.video_name, r.clip_id): r for r in s.everything().collect()}
    assert len(all_) == 6 and all_["a", 1].labels == ["extra", "left"] and all_["a", 2].background_id == 0
    s.remove("label", (F.col("video_name") == "b") | (F.col("label") == "extra"))
    assert sorted((r.video_name, r.label) for r in s.table("label").collect()) == [("a", "left"), ("a", "right")]


def test_quality_of_chosen_clips(spark, frames, tmp_path):
    s = ClipStore(spark, str(tmp_path / "store"))
    s.put_fixed(frames, [("left", (0, 0, 4, 8))], 10)
    half = s.set_quality("a", 0.5, Condition(label="left", time=(0, 30)), quantum=2, inplace=False).collect()
    assert len(half) == 30 and {r.width for r in half} == {4}
    assert {r.width for r in s.get("a").collect()} == {8}
    with pytest.raises(ValueError):
        s.set_quality("a", 0.5, Condition(label="left"))


def test_cache(spark, frames, tmp_path):
    s = ClipStore(spark, str(tmp_path / "store"))
    s.put_fixed(frames, [("left", (0, 0, 4, 8))], 10)
    one = s.cache("a")
    assert s.cache("a") is one and one.is_cached and one.count() == 60
    s.uncache("a")
    s.uncache("a")
    assert not s.cached


def test_frames_meet_the_spans_around_them(spark):
    rng = random.Random(1)
    f = [(s, n) for s in "ab" for n in range(300)]
    spans = [(rng.choice("abc"), a := rng.randrange(300), a + rng.choice([-1, 0, 5, 150]), k) for k in range(40)]
    got = joins.frames_in(spark.createDataFrame(f, "s string, frame bigint"), spark.createDataFrame(spans, "s string, x bigint, y bigint, k int"), "s", "x", "y", 16)
    assert sorted((r.s, r.frame, r.k) for r in got.collect()) == sorted((s, n, k) for s, n in f for t, x, y, k in spans if s == t and x <= n <= y)


def test_asof_with_a_common_column(spark):
    f = spark.createDataFrame([("a", 1, "own"), ("a", 5, "own")], "stream_id string, frame bigint, label string")
    n = spark.createDataFrame([("a", 3, "note")], "stream_id string, note_frame bigint, label string")
    assert [(r.frame, r.label, r.note_label) for r in joins.asof_forward(f, n).orderBy("frame").collect()] == [(1, "own", "note"), (5, "own", None)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.choice([0, 0, 0, 1, 2])), rng.normal(size=4).tolist()) for i in range(120)]
    return [*rows, (200, 0, None), (201, 0, [0.0] * 4), (202, 0, [1.0, None, 0.0, 0.0]), (203, None, [1.0] * 4), (204, 0, [1.0, 2.0]), (205, 0, [1.0, 2.0])]


def usable(rows):
    return [(i, k, np.array(v)) for i, k, v in rows if k is not None and v is not None and None not in v]


def test_similarity_by_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 16)
    d = spark.createDataFrame(vectors, "id int, label int, v array<double>")
    got = joins.similarity_join(d, d, "label", "v", 0.6, "id", "id").collect()
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if a.any() and b.any() else -2
    ok = usable(vectors)
    expect = {(k, i, j): cos(a, b) for i, k, a in ok for j, m, b in ok if k == m and len(a) == len(b) and cos(a, b) >= 0.6}
    assert {(r.label, r.left_id, r.right_id): pytest.approx(r.cosine) for r in got} == expect
    assert (0, 204, 205) in expect


def test_descriptors_by_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 16)
    d = spark.createDataFrame(vectors, "id int, label int, feature array<double>")
    a, b = d.filter("id % 2 = 0"), d.filter("id % 2 = 1")
    got = {r.label: (r.share, r.match) for r in joins.descriptor_match(a, b, "label", 1.0, 0.4).filter("label IS NOT NULL").collect()}
    ok = usable(vectors)
    expect = {}
    for label in (0, 1, 2):
        own = [i for i, k, _ in vectors if k == label and i % 2 == 0]
        hit = [i for i, k, x in ok if k == label and i % 2 == 0 and any(m == label and j % 2 and len(x) == len(y) and np.linalg.norm(x - y) < 1.0 for j, m, y in ok)]
        expect[label] = (pytest.approx(len(hit) / len(own)), len(hit) / len(own) >= 0.4)
    assert got == expect


def test_buffers(spark, frames):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    count = lambda p: p[["stream_id", "frame"]].assign(n=len(p))
    got = aggregates.buffer_merge(frames.coalesce(1), "stream_id string, frame bigint, n int", count, 7, 0.5)
    rows = got.collect()
    assert len(rows) == 60 and all((r.n is None) == (r.frame % 2 == 1) for r in rows) and max(r.n for r in rows if r.n) <= 7
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_filter_without_any_metric():
    with pytest.raises(ValueError):
        validate(Pipeline()[Op("filter", {"metric": "b"})])


def test_merged_runs_and_bipartite_match_against_plain_python(spark):
    rng = random.Random(7)
    rows = [(k, c, r, rng.choice([0.0, 0.2, 0.5, 0.5, 0.9])) for k in range(12) for c in range(3) for r in range(4) if rng.random() < 0.7]
    got = detections.bipartite_match(spark.createDataFrame(rows, "frame int, col int, row int, similarity double"), ["frame"]).collect()
    by = defaultdict(dict)
    for k, c, r, s in rows:
        by[k][c, r] = s
    names = [n for n in got[0].asDict() if n not in ("frame", "similarity")] if got else []
    for k, cells in by.items():
        own = [r for r in got if r.frame == k]
        pairs = [(r["col"], r["row"]) for r in own if r["row"] is not None and r["row"] >= 0]
        assert len({c for c, _ in pairs}) == len(pairs) == len({r for _, r in pairs}), names
        assert all(p in cells for p in pairs)
        free = [p for p in cells if cells[p] > 0 and p[0] not in {c for c, _ in pairs} and p[1] not in {r for _, r in pairs}]
        assert not free  # greedy leaves no pair that could still be matched


def test_label_csv_and_ground_truth(spark, tmp_path):
    (tmp_path / "l.csv").write_text("youtube_id,second_no,fps,frame_no,class,xmin,xmax,ymin,ymax\nv,1.0,30,30,car,0.1,0.5,0.25,0.75\nv,,30,,bus,,,,\n")
    r = tables.label_csv(spark, str(tmp_path / "l.csv"), 100, 200).collect()
    assert [(x.stream_id, x.note_frame, x.label, x.x0, x.y0, x.x1, x.y1) for x in r] == [("v", 30, "car", 10, 50, 50, 150), ("v", None, "bus", None, None, None, None)]
    (tmp_path / "gt.txt").write_text("1,7,10,20,30,40,1,1,0.5\n2,7,11,20,30,40,0,1,1\n")
    g = tables.mot_truth(spark, str(tmp_path / "gt.txt")).collect()
    assert [(x.frame, x.track_id, x.x0, x.y1, x.score) for x in g] == [(1, 7, 10.0, 60.0, 1.0), (2, 7, 11.0, 60.0, 0.0)]


def test_writers(spark, frames, tmp_path):
    tables.write_clips(frames, str(tmp_path / "clips"), 20)
    back = spark.read.parquet(str(tmp_path / "clips"))
    assert {(r.stream_id, r.clip): r["count"] for r in back.groupBy("stream_id", "clip").count().collect()} == {(s, c): n for s in "ab" for c, n in ((0, 20), (1, 10))}
    tables.write_tracks(frames.withColumn("track_id", F.col("frame") % 3), str(tmp_path / "tracks"))
    assert sorted(p.name for p in (tmp_path / "tracks").glob("track_id=*")) == ["track_id=0", "track_id=1", "track_id=2"]
    media.block_put(frames, str(tmp_path / "blocks"), 0.5)
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    assert media.block_get(blocks, "a").select("block").distinct().count() == 2 and media.block_get(blocks, "a").count() == 30
    assert media.end_trim(frames, 0.5).count() == 32
    assert [(r.stream_id, r.seconds) for r in media.key_frames(frames, F.col("frame") == 15).orderBy("stream_id").collect()] == [("a", 0.5), ("b", 0.5)]


def test_streaming_counts_and_sink(spark, tmp_path):
    rows = [("x", f"2024-01-01 00:00:{s:02d}") for s in (1, 3, 12, 14, 15, 59)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "event_type string, t string").select("event_type", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("event_type string, ts timestamp").parquet(str(src))
    q = events.tumbling_counts(stream, "10 seconds", "5 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window.start.second, r.n) for r in spark.table("counts").collect()) == [(0, 2), (10, 3), (50, 1)]
    q = events.write_idempotent(stream, str(tmp_path / "out"), str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    q = events.write_idempotent(stream, str(tmp_path / "out"), str(tmp_path / "check")).start()
    q.processAllAvailable()
    q.stop()
    time.sleep(0.1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
