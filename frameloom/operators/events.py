"""Metrics, kernel events, time series, label intervals and shots over streams.

Streams are rows with (stream_id, frame); every ordered operator sorts by frame
inside its stream. Order-dependent state is kept as short as it can be: the
refractory fold runs per burst of candidates, not per stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.functions import boxes as B

STREAM, FRAME = "stream_id", "frame"


def ordered(*keys: str):
    return W.partitionBy(*(keys or (STREAM,))).orderBy(FRAME)


def activity_metric(frames: DataFrame, name: str, region: tuple[int, int, int, int], label: str = "object") -> DataFrame:
    """Count of boxes with the label that the region contains; the region is moved
    by the frame's origin if there is one. Column ``bounding_boxes`` is an array."""
    r = B.box(*region)
    if "origin" in frames.columns:
        r = B.shift(r, F.coalesce("origin.x", F.lit(0)), F.coalesce("origin.y", F.lit(0)))
    inside = F.filter("bounding_boxes", lambda b: (b["label"] == label) & B.contains(r, b))
    return frames.withColumn(name, F.coalesce(F.size(inside), F.lit(0)).cast("bigint"))


def activity_metric_rows(frames: DataFrame, detections: DataFrame, name: str, region: tuple[int, int, int, int], label: str) -> DataFrame:
    """The same from one row per detection; frames without a hit count 0."""
    hits = detections.filter((F.col("label") == label) & B.contains(B.box(*region), F.struct(*B.SIDES)))
    n = hits.groupBy(STREAM, FRAME).agg(F.count("*").alias(name))
    return frames.join(n, [STREAM, FRAME], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def positions(frames: DataFrame, name: str = "pos") -> DataFrame:
    return frames.withColumn(name, F.row_number().over(ordered()).cast("bigint") - 1)


def event_candidates(frames: DataFrame, metric: str, kernel: list[float], threshold: float) -> DataFrame:
    """``pos``, ``response`` (kernel over the last values, oldest first) and
    ``candidate``: enough values and a response above the threshold."""
    w, k = ordered(), len(kernel)
    response = None
    for j, c in enumerate(kernel):
        term = F.lit(float(c)) * F.lag(metric, k - 1 - j).over(w)
        response = term if response is None else response + term
    f = positions(frames).withColumn("response", response)
    enough = (F.col("pos") >= k - 1) & (F.col("response") > threshold)
    return f.withColumn("candidate", F.coalesce(enough, F.lit(False)))


def refractory(candidates: DataFrame, delay: int) -> DataFrame:
    """(stream_id, pos) of the candidates that fire: position 2 or later, and more
    than ``delay`` after the last that fired.

    A candidate more than ``delay`` behind the previous one fires whatever came
    before, so it opens a burst; the greedy fold runs inside bursts.
    """
    c = candidates.filter("candidate AND pos >= 2").select(STREAM, "pos")
    w = W.partitionBy(STREAM).orderBy("pos")
    c = c.withColumn("opens", F.coalesce(F.col("pos") - F.lag("pos").over(w) > delay, F.lit(True)))
    c = c.withColumn("burst", F.sum(F.col("opens").cast("int")).over(w))
    bursts = c.groupBy(STREAM, "burst").agg(F.sort_array(F.collect_list("pos")).alias("all"))
    none = F.array().cast("array<bigint>")
    fired = F.aggregate(
        "all", F.struct(none.alias("hits"), F.lit(None).cast("bigint").alias("last")),
        lambda s, p: F.when(s["last"].isNull() | (p > s["last"] + delay), F.struct(F.concat(s["hits"], F.array(p)).alias("hits"), p.alias("last"))).otherwise(s),
        lambda s: s["hits"],
    )
    return bursts.select(STREAM, F.explode(fired).alias("pos"))


def event_filter(frames: DataFrame, metric: str, kernel: list[float], threshold: float, delay: int = 0) -> DataFrame:
    """``frames`` with ``<metric>_event``: the kernel's response exceeds the
    threshold and the refractory delay since the last event has passed."""
    c = event_candidates(frames, metric, kernel, threshold)
    hits = refractory(c, delay).withColumn("_hit", F.lit(True))
    out = c.join(hits, [STREAM, "pos"], "left").withColumn(f"{metric}_event", F.coalesce("_hit", F.lit(False)))
    return out.drop("_hit", "candidate")


def classify_after(frames: DataFrame, trigger: Column, delay: int, classify: Column, name: str = "class") -> DataFrame:
    """``delay`` frames after the last trigger the frame is classified, else the
    column is null; a later trigger starts the wait again."""
    last = F.last(F.when(trigger, F.col(FRAME)), ignorenulls=True).over(ordered())
    return frames.withColumn("_last", last).withColumn(name, F.when(F.col(FRAME) == F.col("_last") + delay, classify)).drop("_last")


def vehicle_type(ranked: Column) -> Column:
    """'VAN', 'CAR' or 'None' from labels by falling rank: the first that says."""
    kind = lambda x: F.when(F.lower(x).contains("van"), "VAN").when(F.lower(x).contains("car"), "CAR")
    return F.coalesce(F.get(F.filter(F.transform(ranked, kind), lambda x: x.isNotNull()), F.lit(0)), F.lit("None"))


def moving_median(frames: DataFrame, metric: str, k: int, name: str = "median") -> DataFrame:
    """Median of the previous k values, this one excluded; NaN counts as missing;
    rows start at position k."""
    w = ordered().rowsBetween(-k, -1)
    x = F.when(~F.isnan(metric), F.col(metric))
    return positions(frames).withColumn(name, F.percentile(x, F.lit(0.5)).over(w)).filter(F.col("pos") >= k)


def moving_std(frames: DataFrame, metric: str, k: int, name: str = "std") -> DataFrame:
    """Population deviation of the previous k values."""
    return positions(frames).withColumn(name, F.stddev_pop(metric).over(ordered().rowsBetween(-k, -1))).filter(F.col("pos") >= k)


def _blocks(frames: DataFrame, metric: str, step: int, window: int) -> DataFrame:
    """(stream_id, block, peak): maxima of complete blocks of the smoothed series."""
    s = moving_median(frames, metric, window, "smooth").withColumn("i", F.col("pos") - window)
    b = s.groupBy(STREAM, F.floor(F.col("i") / step).alias("block")).agg(F.max("smooth").alias("peak"), F.count("*").alias("n"))
    return b.filter(F.col("n") == step).drop("n")


def thresh_finder(frames: DataFrame, metric: str, step: int, window: int, threshold: float) -> DataFrame:
    """(stream_id, place) of blocks from the second on that stay at or below the threshold."""
    b = _blocks(frames, metric, step, window).filter((F.col("block") >= 1) & (F.col("peak") <= threshold))
    return b.select(STREAM, (F.col("block") * step + window).alias("place"))


def peak_finder(frames: DataFrame, metric: str, step: int, window: int, compat: bool = False) -> DataFrame:
    """(stream_id, place): the block before beats this one and the one two back.
    ``compat``: block 1 compares with the stream's last block in place of block -1."""
    w = W.partitionBy(STREAM).orderBy("block")
    b = _blocks(frames, metric, step, window)
    b = b.withColumn("p1", F.lag("peak", 1).over(w)).withColumn("p2", F.lag("peak", 2).over(w))
    if compat:
        last = F.last("peak").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        b = b.withColumn("p2", F.when(F.col("block") == 1, last).otherwise(F.col("p2")))
    b = b.filter((F.col("p1") > F.col("peak")) & (F.col("p1") > F.col("p2")))
    return b.select(STREAM, (F.col("block") * step + window).alias("place"))


def label_intervals(labels: DataFrame) -> DataFrame:
    """(stream_id, label, start, end) of maximal runs of frames; end is exclusive."""
    d = labels.select(STREAM, FRAME, "label").distinct()
    run = F.col(FRAME) - F.row_number().over(W.partitionBy(STREAM, "label").orderBy(FRAME))
    out = d.withColumn("run", run).groupBy(STREAM, "label", "run").agg(F.min(FRAME).alias("start"), (F.max(FRAME) + 1).alias("end"))
    return out.drop("run")


def running_box(tracks: DataFrame, *keys: str) -> DataFrame:
    """Each track's box grown over the frames so far."""
    w = W.partitionBy(*keys).orderBy(FRAME).rangeBetween(W.unboundedPreceding, W.currentRow)
    agg = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    return tracks.withColumns({f"run_{c}": f(c).over(w) for c, f in agg.items()})


def shots(frames: DataFrame, change: Column, threshold: float, skip: int = 1) -> DataFrame:
    """(stream_id, shot, start, end, frames): a new shot after each frame whose
    change exceeds the threshold at a position divisible by ``skip``; the cutting
    frame is in no shot, the last shot is reported."""
    p = positions(frames).withColumn("cut", F.coalesce((change > threshold) & (F.col("pos") % skip == 0), F.lit(False)))
    p = p.withColumn("shot", F.sum(F.col("cut").cast("bigint")).over(ordered()))
    kept = p.filter(~F.col("cut")).groupBy(STREAM, "shot")
    return kept.agg(F.min(FRAME).alias("start"), F.max(FRAME).alias("end"), F.count("*").alias("frames"))


def delta(metric: str) -> Column:
    """Absolute change against the stream's previous frame."""
    return F.abs(F.col(metric) - F.lag(metric).over(ordered()))


def segments_by_flag(frames: DataFrame, flag: Column, name: str = "segment") -> DataFrame:
    """Number of the segment that starts at each flagged frame."""
    return frames.withColumn(name, F.sum(flag.cast("bigint")).over(ordered()))
