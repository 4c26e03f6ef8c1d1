"""Ordered folds over many small groups: right, and without a call for each."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from frameloom.operators import crops, detections
from frameloom.operators.crops import cluster, similar

GROUPS = 60_000
#: One call of a pandas step for each group takes several times as long.
SECONDS = 25


@pytest.fixture(scope="module")
def boxes(spark):
    """Three boxes a batch of 10 frames, four batches a stream; some boxes are too small."""
    d = spark.range(GROUPS * 3).select((F.col("id") % (GROUPS // 4)).alias("stream_id"), F.expr(f"id div {GROUPS // 4}").alias("k"), F.abs(F.hash("id")).alias("r"))
    x, y = (F.col("r") % 3).cast("int"), F.expr("cast(r div 8 % 2 as int)")
    w, h = F.expr("cast(9 + r div 16 % 3 + 20 * (r div 64 % 2) as int)"), F.lit(30)
    d = d.select("stream_id", (F.col("k") % 4 * 10 + F.expr("k div 4")).alias("frame"), F.lit(0).alias("idx"), F.when(F.col("r") % 5 > 0, "a").otherwise("b").alias("label"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    d = d.cache()
    rows = sorted(tuple(r) for r in d.collect())
    return d, rows


def timed(df):
    began = time.perf_counter()
    rows = [tuple(r) for r in df.collect()]
    assert time.perf_counter() - began < SECONDS
    return sorted(rows)


def plain_crops(rows):
    groups = defaultdict(list)
    for s, f, _, label, *box in rows:
        groups[str(s), f // 10].append((f, label, tuple(box)))
    return {g: cluster(own) for g, own in groups.items()}


def test_batch_crops_of_many_batches(boxes):
    expect = sorted((*g, k, label, *box) for g, own in plain_crops(boxes[1]).items() for k, (label, box) in enumerate(own))
    assert timed(crops.batch_crops(boxes[0], 10)) == expect
    assert len({r[:2] for r in expect}) > GROUPS * 0.9


@pytest.fixture(scope="module")
def pairs(spark):
    d = spark.range(GROUPS * 6).select((F.col("id") % GROUPS).alias("frame"), F.expr(f"id div {GROUPS} % 2").alias("col"), F.expr(f"id div {GROUPS} div 2").alias("row"), (F.abs(F.hash("id")) % 5 / 4.0).alias("similarity"))
    return d.cache(), sorted(tuple(r) for r in d.collect())


def test_bipartite_match_of_many_frames(pairs):
    got, took = {}, set()
    for f, c, r, s in sorted(pairs[1], key=lambda x: (x[0], -x[3], x[2], x[1])):
        got.setdefault((f, c), -1)
        if s > 0 and got[f, c] < 0 and (f, r) not in took:
            got[f, c] = r
            took.add((f, r))
    assert timed(detections.bipartite_match(pairs[0], ["frame"])) == sorted((*k, r) for k, r in got.items())


def test_bipartite_match_of_one_large_frame(spark):
    d = spark.range(120 * 130).select(F.lit(None).cast("string").alias("frame"), F.expr("id div 130").alias("col"), (F.col("id") % 130).alias("row"), F.abs(F.hash("id")).cast("double").alias("similarity"))
    got, took = {}, set()
    for _, c, r, _ in sorted(d.collect(), key=lambda x: (-x[3], x[2], x[1])):
        if c not in got and r not in took:
            got[c] = r
            took.add(r)
    assert {r["col"]: r["row"] for r in detections.bipartite_match(d, ["frame"]).collect()} == got and len(got) == 120


def plain_runs(by_batch):
    out, state, number, last = [], None, -1, None
    for s, b in sorted(by_batch):
        if s != last:
            last, state, number = s, None, -1
        own = by_batch[s, b]
        merged = None if state is None else similar(state, own)
        number, state = (number + 1, own) if merged is None else (number, merged)
        out.append((s, b, number))
    return sorted(out)


def test_merge_runs_of_many_batches(boxes):
    c = crops.union_crops(boxes[0], 10)
    groups = {(r.stream_id, r.batch): [(r.label, (r.x0, r.y0, r.x1, r.y1))] for r in c.collect()}
    expect = sorted((str(s), b, n) for s, b, n in plain_runs(groups))
    assert timed(crops.merge_runs(c, c, "union")) == expect
    assert 1 < len(expect) / sum(n == 0 for _, _, n in expect) < 4


def test_merge_runs_with_batches_of_their_own(boxes, spark):
    """Batches without crops come in between, crops of other batches don't count."""
    few = boxes[0].filter("stream_id < 40")
    c = crops.batch_crops(few, 10)
    batches = spark.range(40 * 6).select(F.expr("cast(id div 6 as string)").alias("stream_id"), (F.col("id") % 6).alias("batch")).filter("batch <> 1")
    known = plain_crops([r for r in boxes[1] if r[0] < 40])
    groups = {(r.stream_id, r.batch): known.get((r.stream_id, r.batch), []) for r in batches.collect()}
    assert sorted(tuple(r) for r in crops.merge_runs(c, batches.union(batches)).collect()) == plain_runs(groups)


def test_merge_runs_of_a_null_stream(spark):
    """The crops of a stream without a name are compared too."""
    c = spark.createDataFrame([(None, 0, "a", 0, 0, 50, 50), (None, 1, "a", 200, 0, 250, 50)], "stream_id string, batch bigint, label string, x0 int, y0 int, x1 int, y1 int")
    assert [r.run for r in crops.merge_runs(c, c).orderBy("batch").collect()] == [0, 1]
