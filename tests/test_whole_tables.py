"""Registered queries without SQL take every row of their tables."""

import random
from collections import defaultdict

import pandas as pd
import pytest

from frameloom.catalogue import QUERIES
from frameloom.operators.crops import cluster


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


def suppress(rows, most=None):
    """Rows (score, box, ...) by falling score and rising box."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[0], *r[1:])):
        if (most is None or len(kept) < most) and all(iou(r[1], k[1]) <= 0.5 for k in kept):
            kept.append(r)
    return kept


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """A lineitem table with frames and streams far behind the first ones; (path, detections)."""
    r = random.Random(3)
    rows = [(r.choice([1, 20, 21, 700]), r.choice([5, 3999, 4000, 90000, 90001]), r.randrange(1, 7), r.choice("ANR"), r.randrange(1, 400), float(r.randrange(8, 50)), r.randrange(11) / 100) for _ in range(600)]
    d = tmp_path_factory.mktemp("whole")
    names = ["l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_quantity", "l_discount"]
    pd.DataFrame(rows, columns=names).astype({"l_linenumber": "int32"}).to_parquet(d / "lineitem.parquet", index=False)
    return str(d), [(s, f, i, label, (p % 100, i * 10, p % 100 + int(q), i * 10 + int(q)), score) for s, f, i, label, p, q, score in rows]


def test_nms_of_all_frames(spark, lines):
    groups = defaultdict(list)
    for s, f, i, label, box, score in lines[1]:
        groups[s, label].append((score, box, f, i))
    expect = sorted((s, label, f, i, score, *box) for (s, label), g in groups.items() for score, box, f, i in suppress(g))
    assert sorted(tuple(r) for r in QUERIES["q_nms"](spark, lines[0]).collect()) == expect
    assert max(r[2] for r in expect) > 4000


def test_multiclass_nms_of_all_frames(spark, lines):
    groups = defaultdict(lambda: defaultdict(list))
    for s, _, _, label, (x0, y0, x1, y1), score in lines[1]:
        box = (min(x0, 100), min(y0, 80), min(x1, 100), min(y1, 80))
        if score > 0.03 and box[0] < box[2] and box[1] < box[3]:
            groups[s][label].append((score, box))
    expect = []
    for s, by in groups.items():
        kept = [(-score, label, box) for label, g in by.items() for score, box in suppress(g, 20)]
        expect += [(s, label, -score, *box) for score, label, box in sorted(kept)[:30]]
    got = QUERIES["q_multiclass_nms"](spark, lines[0]).select("stream_id", "label", "score", "x0", "y0", "x1", "y1")
    assert sorted(tuple(r) for r in got.collect()) == sorted(expect)


def test_batch_crops_of_all_streams(spark, lines):
    groups = defaultdict(list)
    for s, f, i, label, box, _ in lines[1]:
        groups[str(s), f // 500].append((f, i, label, box))
    expect = [(s, n, k, label, *box) for (s, n), g in groups.items() for k, (label, box) in enumerate(cluster([(f, label, box) for f, _, label, box in sorted(g)]))]
    assert sorted(tuple(r) for r in QUERIES["q_batch_crops"](spark, lines[0]).collect()) == sorted(expect)
    assert {"21", "700"} <= {r[0] for r in expect}


def test_video_match_of_all_tiles(spark, tmp_path):
    """Tiles behind vec_id 420 decide: label 0 matches by them only, label 1 fails by them only."""
    rows = []
    for label, early, late in ((0, -1.0, 1.0), (1, 1.0, -1.0)):
        for v in (*range(label * 21, label * 21 + 21), *range(420 + label * 210, 630 + label * 210)):
            sign = (early if v < 420 else late) if v % 3 == 2 else 1.0
            rows.append((v, label, [sign, 0.5]))
    pd.DataFrame(rows, columns=["vec_id", "label", "embedding"]).to_parquet(tmp_path / "embeddings.parquet", index=False)

    def match(own):
        sides = defaultdict(list)
        for v, _, e in own:
            sides[v % 3, v // 3 % 7].append(e)
        best = []
        for f in (0, 1):
            cos = [(a[0] * b[0] + a[1] * b[1]) / (1.25) for t in range(7) for a in sides[f, t] for b in sides[2, t]]
            best.append(sum(cos) / len(cos))
        return max(best) >= 0.2

    expect = {label: match([r for r in rows if r[1] == label]) for label in (0, 1)}
    assert expect == {0: True, 1: False}
    assert {r.label: r.match for r in QUERIES["q_video_match"](spark, str(tmp_path)).collect()} == expect
