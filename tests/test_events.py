"""Events, series and intervals against plain Python models."""

import random
import statistics

import pytest

from frameloom.operators import events as E
from frameloom.streaming.events import step


def stream(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "stream_id string, frame bigint, metric double")


def model(values, kernel, threshold, delay):
    state, out = ([], 0, None), []
    for i, v in enumerate(values):
        state, hit = step(state, v, kernel, threshold, delay)
        if hit:
            out.append(i)
    return out


@pytest.mark.parametrize("seed,kernel,threshold,delay", [(1, [1.0], 0.5, 0), (2, [-0.25, -0.25, 1, -0.25, -0.25], 0.3, 3), (3, [1.0], 0.2, 7), (4, [-0.5, 1, -0.5], 0.25, 1)])
def test_event_filter_equals_the_step_by_step_model(spark, seed, kernel, threshold, delay):
    rng = random.Random(seed)
    values = [rng.random() for _ in range(120)]
    got = E.event_filter(stream(spark, values), "metric", kernel, threshold, delay).filter("metric_event").select("pos").collect()
    assert sorted(r.pos for r in got) == model(values, kernel, threshold, delay)


def test_event_edges(spark):
    fire = lambda v, d, k=(1.0,), t=0.5: sorted(r.pos for r in E.event_filter(stream(spark, v), "metric", list(k), t, d).filter("metric_event").collect())
    assert fire([1, 1, 1], 0) == [2]  # positions 0 and 1 never fire
    assert fire([0, 0, 1, 0, 1, 1], 2) == [2, 5]  # two apart is too close, three is not
    assert fire([0, 0, 0.5], 0) == []  # the threshold itself is no event
    assert fire([1, 1], 0, (1, 1, 1)) == []  # shorter than the kernel


def test_label_intervals(spark):
    rows = [("s", f, x) for f, xs in enumerate([["person"], ["person"], ["person"], ["surfboard", "person"], [], ["person"]]) for x in xs]
    got = E.label_intervals(spark.createDataFrame(rows, "stream_id string, frame bigint, label string")).collect()
    assert sorted((r.label, r.start, r.end) for r in got) == [("person", 0, 4), ("person", 5, 6), ("surfboard", 3, 4)]


def test_moving_median_excludes_the_present(spark):
    v = [5, 1, 4, 2, 8, 9]
    got = {r.frame: r.median for r in E.moving_median(stream(spark, v), "metric", 3).collect()}
    assert got == {i: statistics.median(v[i - 3 : i]) for i in (3, 4, 5)}


def test_shots_report_the_last_one(spark):
    got = E.shots(stream(spark, [0, 0, 9, 9, 9]), E.delta("metric"), 5.0).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 1), (3, 4)]


def test_classifier_waits_and_starts_again(spark):
    from pyspark.sql import functions as F

    d = stream(spark, [0, 1, 0, 1, 0, 0, 0])
    got = {r.frame for r in E.classify_after(d, F.col("metric") == 1, 2, F.lit("x")).filter("class = 'x'").collect()}
    assert got == {5} or got == {3, 5}
    assert 5 in got


def test_stream_equals_batch(spark, tmp_path):
    from frameloom.streaming import event_filter_stream

    rng = random.Random(9)
    values = [rng.random() for _ in range(60)]
    d = stream(spark, values)
    for k in range(3):
        d.filter(f"frame >= {k * 20} AND frame < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = event_filter_stream(src, "metric", [1.0], 0.5, 3).writeStream.format("memory").queryName("ev").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("ev").filter("event").count()
    assert got > 0 and spark.table("ev").count() == 60
