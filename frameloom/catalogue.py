"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom import catalog as K
from frameloom.adapters import CLIPS, DETECTIONS, FRAMES, clip_labels, clips, detections, frames, table
from frameloom.functions import boxes as B
from frameloom.operators import aggregates as A
from frameloom.operators import crops as C
from frameloom.operators import detections as D
from frameloom.operators import events as E
from frameloom.operators import joins as J
from frameloom.operators import maps as M
from frameloom.operators import slicing as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql is not None:
            SQL[f"q_{f.__name__}"] = sql
        return f

    return add


KERNEL, THRESHOLD, DELAY = [-0.25, -0.25, 1.0, -0.25, -0.25], 20.0, 5
_DOT = " + ".join(f"{c} * lag(metric, {4 - j}) OVER w" for j, c in enumerate(KERNEL))
CANDIDATES = f"{FRAMES}, k AS (SELECT *, frame AS pos, {_DOT} AS response FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame)), cand AS (SELECT *, coalesce(pos >= 4 AND response > {THRESHOLD}, false) AS candidate FROM k)"
HITS = (
    f"WITH RECURSIVE {CANDIDATES}, g AS (SELECT stream_id, pos FROM cand WHERE candidate AND pos >= 2),"
    f" nx AS (SELECT a.stream_id, a.pos, min(b.pos) AS nxt FROM g a LEFT JOIN g b ON a.stream_id = b.stream_id AND b.pos > a.pos + {DELAY} GROUP BY ALL),"
    " hit AS (SELECT stream_id, min(pos) AS pos FROM g GROUP BY ALL UNION ALL SELECT nx.stream_id, nx.nxt FROM hit JOIN nx ON hit.stream_id = nx.stream_id AND hit.pos = nx.pos WHERE nx.nxt IS NOT NULL),"
    " ev AS (SELECT cand.*, hit.pos IS NOT NULL AS metric_event FROM cand LEFT JOIN hit ON cand.stream_id = hit.stream_id AND cand.pos = hit.pos)"
)


def _events(spark, d):
    return E.event_filter(frames(spark, d), "metric", KERNEL, THRESHOLD, DELAY)


@query(f"{HITS} SELECT 'metric_event_True' AS key, count(*) AS n FROM ev WHERE metric_event HAVING count(*) > 0")
def event_filter_count(spark, d):
    return A.count_keys(_events(spark, d), ["metric_event"])


@query(f"WITH {CANDIDATES} SELECT stream_id, frame, round(response, 6) AS response, candidate FROM cand")
def event_candidates(spark, d):
    return E.event_candidates(frames(spark, d), "metric", KERNEL, THRESHOLD).select("stream_id", "frame", F.round("response", 6).alias("response"), "candidate")


@query(f"{HITS} SELECT stream_id, CAST(frame // 30 AS BIGINT) AS at, metric FROM ev WHERE metric_event")
def event_get(spark, d):
    return A.get_rows(_events(spark, d), "metric_event", 30.0).select("stream_id", "at", "metric")


@query(f"{HITS}, x AS (SELECT stream_id, label, metric_event, CAST(frame % 3 AS BIGINT) AS third FROM ev) SELECT key, count(*) AS n FROM (SELECT 'label_' || label AS key FROM x UNION ALL SELECT 'metric_event_True' FROM x WHERE metric_event UNION ALL SELECT 'third_' || third FROM x WHERE third <> 0) GROUP BY key")
def multi_key_count(spark, d):
    return A.count_keys(_events(spark, d).withColumn("third", F.col("frame") % 3), ["label", "metric_event", "third"])


@query(f"WITH {DETECTIONS} SELECT stream_id, frame, count(*) FILTER (WHERE label = 'A' AND x0 >= 10 AND y0 >= 10 AND x1 <= 90 AND y1 <= 80) AS inside FROM d GROUP BY stream_id, frame")
def activity_metric(spark, d):
    det = detections(spark, d)
    return E.activity_metric_rows(det.select("stream_id", "frame").distinct(), det, "inside", (10, 10, 90, 80), "A")


@query(f"WITH {DETECTIONS} SELECT stream_id, frame, count(*) FILTER (WHERE label = 'N' AND x0 >= 5 AND y0 >= 5 AND x1 <= 85 AND y1 <= 75) AS inside FROM d GROUP BY stream_id, frame")
def activity_metric_arrays(spark, d):
    det = detections(spark, d).groupBy("stream_id", "frame").agg(F.collect_list(F.struct("label", *B.SIDES)).alias("bounding_boxes"))
    det = det.withColumn("origin", F.struct(F.lit(5).alias("x"), F.lit(5).alias("y")))
    return E.activity_metric(det, "inside", (10, 10, 90, 80), "N").select("stream_id", "frame", "inside")


@query(
    f"WITH {DETECTIONS} SELECT stream_id, frame, idx, x0 - 5 AS sx, x0 + 3 AS tx, y1 + 4 AS ty, abs((x1 - x0) * (y1 - y0)) AS area, CAST(trunc(x0 / 2.0) AS INTEGER) AS lo, x1 * 2 AS hi, x0 - 2 AS px, y1 + 2 AS py,"
    " x0 >= 20 AND x1 <= 80 AND y0 >= 20 AND y1 <= 80 AS inside, x1 >= 20 AND x0 <= 80 AND y1 >= 20 AND y0 <= 80 AS touches, greatest(0, least(x1, 80) - greatest(x0, 20)) * greatest(0, least(y1, 80) - greatest(y0, 20)) AS common,"
    " least(x0, 20) AS ux, greatest(y1, 80) AS uy, (y1 - y0) AS h, greatest(least(x0, 80), 20) AS cx, (x0 - 20) * (x0 - 20) + (y0 - 20) * (y0 - 20) + (x1 - 80) * (x1 - 80) + (y1 - 80) * (y1 - 80) AS sq,"
    " round(greatest(0, least(x1, 80) - greatest(x0, 20)) * greatest(0, least(y1, 80) - greatest(y0, 20)) / CAST((x1 - x0) * (y1 - y0) + 3600 - greatest(0, least(x1, 80) - greatest(x0, 20)) * greatest(0, least(y1, 80) - greatest(y0, 20)) AS DOUBLE), 9) AS iou FROM d"
)
def box_algebra(spark, d):
    b, w = F.struct(*B.SIDES), B.box(20, 20, 80, 80)
    return detections(spark, d).select(
        "stream_id", "frame", "idx", B.shift(b, 5, 5)["x0"].alias("sx"), B.x_translate(b, 3)["x0"].alias("tx"), B.y_translate(b, 4)["y1"].alias("ty"), B.area(b).alias("area"),
        B.spread(b, 2)["x0"].alias("lo"), B.spread(b, 2)["x1"].alias("hi"), B.pad(b, 2)["x0"].alias("px"), B.pad(b, 2)["y1"].alias("py"), B.contains(w, b).alias("inside"), B.intersects(w, b).alias("touches"),
        B.intersect_area(w, b).alias("common"), B.union_box(w, b)["x0"].alias("ux"), B.union_box(w, b)["y1"].alias("uy"), B.height_width(b)["height"].alias("h"), B.clip_to(b, w)["x0"].alias("cx"),
        B.square_distance(b, w).alias("sq"), F.round(B.iou(b, w), 9).alias("iou"),
    )


@query(f"WITH {DETECTIONS} SELECT stream_id, frame, idx, 100.0 - x1 AS flip_x, 80.0 - y1 AS flip_y, 100.0 - x1 AS rot_y, round((x0 - 20) / 60.0, 9) AS rel, round(x0 / 100.0, 9) AS norm, round(((x0 + x1) / 2.0 - 50) / 60.0, 9) AS enc, round(sqrt(((x0 + x1) / 2.0 - 50) ** 2 + ((y0 + y1) / 2.0 - 50) ** 2 + (x1 - x0 - 60) ** 2 + (y1 - y0 - 60) ** 2), 6) AS rmse FROM d")
def box_conventions(spark, d):
    b, w = F.struct(*B.SIDES), B.fbox(20, 20, 80, 80)
    fb = B.fbox(*B.SIDES)
    return detections(spark, d).select(
        "stream_id", "frame", "idx", B.flip_left_right(b, 100.0)["x0"].alias("flip_x"), B.flip_up_down(b, 80.0)["y0"].alias("flip_y"), B.rotate_90(b, 100.0)["y0"].alias("rot_y"),
        F.round(B.change_frame(b, w)["x0"], 9).alias("rel"), F.round(B.normalized(b, 80, 100)["x0"], 9).alias("norm"), F.round(B.encode_anchor(fb, w)["x"], 9).alias("enc"), F.round(B.box_rmse(fb, w), 6).alias("rmse"),
    )


@query(f"WITH {DETECTIONS} SELECT stream_id, label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM d GROUP BY ALL")
def box_union_agg(spark, d):
    return detections(spark, d).groupBy("stream_id", "label").agg(*B.union_of(F.struct(*B.SIDES)))


_IOU = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query(f"WITH {DETECTIONS} SELECT a.frame, a.idx AS a_idx, b.idx AS b_idx, round({_IOU} / CAST((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU} AS DOUBLE), 9) AS iou, round({_IOU} / CAST((b.x1 - b.x0) * (b.y1 - b.y0) AS DOUBLE), 9) AS ioa FROM d a JOIN d b ON a.frame = b.frame AND (a.idx < b.idx) AND {_IOU} > 0")
def box_iou_pairs(spark, d):
    det = detections(spark, d).select("frame", "idx", F.struct(*B.SIDES).alias("b"))
    a, b = det.alias("a"), det.alias("b")
    x, y = F.col("a.b"), F.col("b.b")
    j = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.idx") < F.col("b.idx")) & (B.intersect_area(x, y) > 0))
    return j.select(F.col("a.frame").alias("frame"), F.col("a.idx").alias("a_idx"), F.col("b.idx").alias("b_idx"), F.round(B.iou(x, y), 9).alias("iou"), F.round(B.ioa(x, y), 9).alias("ioa"))


_WIN = "x1 >= 20 AND x0 <= 60 AND y1 >= 20 AND y0 <= 60"
_CLIPPED = "greatest(least(x0, 60), 20) AS x0, greatest(least(y0, 60), 20) AS y0, greatest(least(x1, 60), 20) AS x1, greatest(least(y1, 60), 20) AS y1"


@query(f"WITH {DETECTIONS} SELECT stream_id, frame, idx, label, score, CAST(greatest(least(x0, 60), 20) - 20 AS INTEGER) AS x0, CAST(greatest(least(y0, 60), 20) - 20 AS INTEGER) AS y0, CAST(greatest(least(x1, 60), 20) - 20 AS INTEGER) AS x1, CAST(greatest(least(y1, 60), 20) - 20 AS INTEGER) AS y1 FROM d WHERE {_WIN}")
def crop_boxes(spark, d):
    return M.crop_boxes(detections(spark, d), 20, 20, 60, 60)


@query(f"WITH {DETECTIONS} SELECT stream_id, frame, idx, label, score, CAST(x0 * 0.5 AS DOUBLE) AS x0, CAST(y0 * 0.5 AS DOUBLE) AS y0, CAST(x1 * 0.5 AS DOUBLE) AS x1, CAST(y1 * 0.5 AS DOUBLE) AS y1 FROM d")
def resize_boxes(spark, d):
    return M.resize_boxes(detections(spark, d), 0.5)


@query(f"WITH {DETECTIONS}, e AS (SELECT stream_id, frame, idx, label, score, {_CLIPPED} FROM d) SELECT * FROM e WHERE (x1 - x0) * (y1 - y0) <> 0")
def clip_to_window(spark, d):
    return D.clip_to_window(detections(spark, d), (20, 20, 60, 60))


@query(f"WITH {DETECTIONS} SELECT * FROM d WHERE x0 >= 10 AND y0 >= 10 AND x1 <= 90 AND y1 <= 70")
def prune_outside(spark, d):
    return D.prune_outside(detections(spark, d), (10, 10, 90, 70))


@query(f"WITH {DETECTIONS} SELECT * FROM d WHERE NOT (x0 >= 40 OR x1 <= 20 OR y0 >= 40 OR y1 <= 20)")
def prune_completely_outside(spark, d):
    return D.prune_outside(detections(spark, d), (20, 20, 40, 40), completely=True)


@query(f"WITH {DETECTIONS} SELECT * FROM d WHERE x1 - x0 >= 15 AND y1 - y0 >= 15")
def prune_small(spark, d):
    return D.prune_small(detections(spark, d), 15)


@query(f"WITH {DETECTIONS} SELECT a.* FROM d a WHERE a.label = 'A' AND EXISTS (SELECT 1 FROM d b WHERE b.label = 'R' AND b.frame = a.frame AND {_IOU} >= 0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0)))")
def prune_non_overlapping(spark, d):
    det = detections(spark, d)
    return D.prune_non_overlapping(det.filter("label = 'A'"), det.filter("label = 'R'"), ["frame"], 0.3)


@query(f"WITH {DETECTIONS} SELECT * FROM d WHERE label IN ('A', 'R') AND score >= 0.05")
def allowed_labels(spark, d):
    return S.allowed_labels(detections(spark, d), ["A", "R"], 0.05)


@query(f"WITH {FRAMES} SELECT * FROM f WHERE frame BETWEEN 10 AND 30")
def cut(spark, d):
    return S.cut(frames(spark, d), 10, 30)


@query(f"WITH {FRAMES} SELECT * FROM f WHERE frame BETWEEN 10 AND 30 AND frame > 10")
def cut_compat(spark, d):
    return S.cut(frames(spark, d), 10, 30, compat=True)


@query(f"WITH {FRAMES} SELECT * FROM f WHERE frame < 25")
def limit_frames(spark, d):
    return S.limit_frames(frames(spark, d), 25)


@query(f"WITH {FRAMES} SELECT * FROM f WHERE frame % 4 = 0")
def sample(spark, d):
    return S.sample(frames(spark, d), 0.25)


@query(f"WITH {FRAMES} SELECT * FROM f WHERE (stream_id * 7919 + (frame // 20) * 104729) % 1000003 * 31337 % 10000 < 3000")
def sample_clip(spark, d):
    return S.sample_clip(frames(spark, d), 20, 0.3)


@query(f"WITH {DETECTIONS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY stream_id ORDER BY frame) AS k FROM d) SELECT a.stream_id, a.frame, a.idx, a.label, a.x0, a.y0, a.x1, a.y1, a.score FROM k a WHERE a.k = 1 OR EXISTS (SELECT 1 FROM k b WHERE b.stream_id = a.stream_id AND b.k = a.k - 1 AND (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) < 400)")
def keypoint_filter(spark, d):
    return M.keypoint_filter_rows(detections(spark, d), 20)


_VEC = f"{FRAMES}, v AS (SELECT stream_id, frame, coalesce(lag(metric) OVER w, metric) AS x0, CAST(coalesce(lag(frame) OVER w, 0) AS DOUBLE) AS y0, metric AS x1, CAST(frame AS DOUBLE) AS y1 FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame)), l AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM v)"


@query(f"WITH {_VEC} SELECT stream_id, frame, round(len, 6) AS speed, round(CASE WHEN len = 0 THEN 0 ELSE acos((x1 - x0) / len) END, 6) AS direction FROM l")
def speed_direction(spark, d):
    w = W.partitionBy("stream_id").orderBy("frame")
    v = F.struct(F.coalesce(F.lag("metric").over(w), F.col("metric")).alias("x0"), F.coalesce(F.lag("frame").over(w), F.lit(0)).cast("double").alias("y0"), F.col("metric").alias("x1"), F.col("frame").cast("double").alias("y1"))
    f = frames(spark, d).withColumn("motion_vectors", F.array(v))
    out = M.direction(M.speed(f))
    return out.select("stream_id", "frame", F.round(F.get("speed", F.lit(0)), 6).alias("speed"), F.round(F.get("direction", F.lit(0)), 6).alias("direction"))


@query(f"WITH {DETECTIONS} SELECT stream_id, CAST(frame // 500 AS BIGINT) AS buffer, label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM d GROUP BY ALL")
def buffer_label_union(spark, d):
    return A.label_union(detections(spark, d), 500)


@query(f"WITH {FRAMES} SELECT stream_id, CAST(frame // 16 AS BIGINT) AS buffer, count(*) AS n, round(sum(metric), 6) AS total FROM f WHERE frame % 2 = 0 GROUP BY ALL")
def buffer_reduce(spark, d):
    return A.buffer_reduce(frames(spark, d), 16, {"n": F.count("*"), "total": F.round(F.sum("metric"), 6)}, sampling=0.5)


@query(f"WITH {FRAMES} SELECT stream_id, frame, max(label) OVER (PARTITION BY stream_id, frame // 16) AS tag FROM f")
def batch_tag(spark, d):
    return A.batch_tag(frames(spark, d), 16, F.max("label")).select("stream_id", "frame", "tag")


@query(f"WITH {FRAMES} SELECT stream_id, frame, round(median(metric) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) AS median FROM f QUALIFY frame >= 5")
def moving_median(spark, d):
    return E.moving_median(frames(spark, d), "metric", 5).select("stream_id", "frame", F.round("median", 9).alias("median"))


@query(f"WITH {FRAMES} SELECT stream_id, frame, round(stddev_pop(metric) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS std FROM f QUALIFY frame >= 5")
def moving_std(spark, d):
    return E.moving_std(frames(spark, d), "metric", 5).select("stream_id", "frame", F.round("std", 6).alias("std"))


_SMOOTH = f"{FRAMES}, s AS (SELECT stream_id, frame, median(metric) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m FROM f QUALIFY frame >= 5), b AS (SELECT stream_id, (frame - 5) // 4 AS block, max(m) AS peak FROM s GROUP BY ALL HAVING count(*) = 4)"


@query(f"WITH {_SMOOTH} SELECT stream_id, CAST(block * 4 + 5 AS BIGINT) AS place FROM b WHERE block >= 1 AND peak <= 40")
def thresh_finder(spark, d):
    return E.thresh_finder(frames(spark, d), "metric", 4, 5, 40.0)


@query(f"WITH {_SMOOTH} SELECT stream_id, CAST(block * 4 + 5 AS BIGINT) AS place FROM (SELECT *, lag(peak, 1) OVER w AS p1, lag(peak, 2) OVER w AS p2 FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY block)) WHERE p1 > peak AND p1 > p2")
def peak_finder(spark, d):
    return E.peak_finder(frames(spark, d), "metric", 4, 5)


@query("WITH l AS (SELECT DISTINCT conv_id AS stream_id, turn AS frame, role AS label FROM conversations), r AS (SELECT *, frame - row_number() OVER (PARTITION BY stream_id, label ORDER BY frame) AS run FROM l) SELECT stream_id, label, min(frame) AS start, max(frame) + 1 AS \"end\" FROM r GROUP BY stream_id, label, run")
def label_intervals(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("frame"), F.col("role").alias("label"))
    return E.label_intervals(c)


@query(f"WITH {FRAMES}, r AS (SELECT *, frame - row_number() OVER (PARTITION BY stream_id, label ORDER BY frame) AS run FROM f) SELECT stream_id, label, min(frame) AS start, max(frame) + 1 AS \"end\" FROM r GROUP BY stream_id, label, run")
def label_intervals_events(spark, d):
    return E.label_intervals(frames(spark, d))


@query(f"WITH {DETECTIONS} SELECT stream_id, label, frame, idx, min(x0) OVER w AS run_x0, min(y0) OVER w AS run_y0, max(x1) OVER w AS run_x1, max(y1) OVER w AS run_y1 FROM d WINDOW w AS (PARTITION BY stream_id, label ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_box(spark, d):
    return E.running_box(detections(spark, d), "stream_id", "label").select("stream_id", "label", "frame", "idx", "run_x0", "run_y0", "run_x1", "run_y1")


@query(f"WITH {FRAMES}, x AS (SELECT *, coalesce(abs(metric - lag(metric) OVER w) > 60 AND frame % 2 = 0, false) AS cut FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame)), y AS (SELECT *, CAST(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS shot FROM x) SELECT stream_id, shot, min(frame) AS start, max(frame) AS \"end\", count(*) AS frames FROM y WHERE NOT cut GROUP BY stream_id, shot")
def shots(spark, d):
    return E.shots(frames(spark, d), E.delta("metric"), 60.0, 2)


@query(f"WITH {FRAMES}, t AS (SELECT *, max(CASE WHEN label = 'purchase' THEN frame END) OVER (PARTITION BY stream_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS last FROM f) SELECT stream_id, frame, CASE WHEN frame = last + 2 THEN label END AS class FROM t")
def classify_after(spark, d):
    return E.classify_after(frames(spark, d), F.col("label") == "purchase", 2, F.col("label")).select("stream_id", "frame", "class")


@query(f"WITH {FRAMES} SELECT stream_id, frame, CAST(sum(CAST(label = 'click' AS INTEGER)) OVER (PARTITION BY stream_id ORDER BY frame) AS BIGINT) AS segment FROM f")
def key_frame_segments(spark, d):
    return E.segments_by_flag(frames(spark, d), F.col("label") == "click").select("stream_id", "frame", "segment")


_HEAD = 'stream_id, min(frame) AS start, max(frame) AS "end", array_to_string(list_sort(list(DISTINCT label)), \',\') AS labels, count(*) AS boxes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1'


def _flat(h: DataFrame) -> DataFrame:
    return h.withColumn("labels", F.array_join("label_set", ",")).drop("label_set")


@query(f"WITH {DETECTIONS} SELECT {_HEAD} FROM d GROUP BY stream_id")
def header(spark, d):
    return _flat(A.headers(detections(spark, d), "stream_id"))


@query(f"WITH {DETECTIONS} SELECT {_HEAD} FROM d WHERE frame >= 1000 AND frame < 3000 GROUP BY stream_id")
def cut_header(spark, d):
    return _flat(A.cut_header(detections(spark, d), 1000, 3000, "stream_id"))


@query(f"WITH {DETECTIONS} SELECT {_HEAD} FROM d WHERE {_WIN} GROUP BY stream_id")
def crop_header(spark, d):
    return _flat(A.crop_header(detections(spark, d), (20, 20, 60, 60), "stream_id"))


@query(f"WITH {CLIPS} SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM lb WHERE lb.clip_id = c.clip_id AND lb.video_name = c.video_name AND lb.label IN ('purchase', 'error'))")
def condition_label(spark, d):
    return K.Condition(label=["purchase", "error"]).clips(clips(spark, d), clip_labels(spark, d))


_CB = "greatest(0, least(origin_x + width, 60) - greatest(origin_x, 10)) * greatest(0, least(origin_y + height, 50) - greatest(origin_y, 5))"


@query(f"WITH {CLIPS} SELECT * FROM c WHERE (origin_x >= 10 AND origin_y >= 5 AND origin_x + width <= 60 AND origin_y + height <= 50) OR {_CB} / CAST(width * height AS DOUBLE) >= 0.7")
def condition_crop(spark, d):
    return K.Condition(crop=(10, 5, 60, 50)).clips(clips(spark, d), clip_labels(spark, d))


@query(f"WITH {CLIPS} SELECT c.* FROM c WHERE start_time >= 20 AND EXISTS (SELECT 1 FROM lb WHERE lb.clip_id = c.clip_id AND lb.video_name = c.video_name AND lb.label = 'view')")
def condition_custom(spark, d):
    return K.Condition(label="view", custom=lambda c: c.filter("start_time >= 20")).clips(clips(spark, d), clip_labels(spark, d))


@query(f"WITH {CLIPS} SELECT * FROM c WHERE (start_time > 25 AND start_time < 70) OR (end_time > 25 AND end_time < 70)")
def time_filter(spark, d):
    return clips(spark, d).filter(S.time_filter(F.col("start_time"), F.col("end_time"), 25, 70))


@query(f"WITH {CLIPS} SELECT * FROM c WHERE (start_time > 25 AND start_time < 30) OR (end_time > 25 AND end_time < 30) OR (start_time <= 25 AND end_time >= 30)")
def time_filter_enclosing(spark, d):
    return K.Condition(time=(25, 30)).clips(clips(spark, d), clip_labels(spark, d))


@query(f"WITH {CLIPS} SELECT clip_id, video_name, least(end_time - 1, 70) - greatest(start_time, 25) + 1 > 1 AS overlaps FROM c")
def overlap(spark, d):
    o = S.overlap(F.col("start_time"), F.col("end_time") - 1, F.lit(25), F.lit(70))
    return clips(spark, d).select("clip_id", "video_name", o.alias("overlaps"))


@query(f"WITH {CLIPS} SELECT video_name, clip_id, array_contains(list(label), 'view') AS has_view, max(start_time) <= 30 AS before, max(end_time) > 40 AS after FROM c JOIN lb USING (clip_id, video_name) GROUP BY ALL")
def header_predicates(spark, d):
    h = clips(spark, d).join(clip_labels(spark, d).groupBy("clip_id", "video_name").agg(F.collect_set("label").alias("label_set")), ["clip_id", "video_name"])
    return h.select("video_name", "clip_id", S.has_label("view", F.col("label_set")).alias("has_view"), S.starts_before(30, F.col("start_time")).alias("before"), S.ends_after(40, F.col("end_time")).alias("after"))


@query(f"WITH {FRAMES}, r AS (SELECT stream_id, min(frame) AS start, max(frame) + 1 AS \"end\" FROM f GROUP BY ALL), g AS (SELECT *, unnest(generate_series(start, \"end\" - 1, 15)) AS clip_start FROM r) SELECT stream_id, start, \"end\", clip_start, least(clip_start + 14, \"end\") AS clip_end FROM g")
def clip_boundaries(spark, d):
    r = frames(spark, d).groupBy("stream_id").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end"))
    return S.clip_boundaries(r, 15)


@query(f"WITH {CLIPS}, g AS (SELECT video_name, clip_id, start_time AS start, end_time - 1 AS \"end\", unnest(generate_series(start_time // 15, (end_time - 1) // 15)) AS idx FROM c) SELECT video_name, clip_id, start, \"end\", CAST(idx AS BIGINT) AS idx, CAST(greatest(start, idx * 15) AS BIGINT) AS part_start, CAST(least(\"end\", idx * 15 + 14) AS BIGINT) AS part_end FROM g")
def clip_split(spark, d):
    c = clips(spark, d).select("video_name", "clip_id", F.col("start_time").alias("start"), (F.col("end_time") - 1).alias("end"))
    return J.clip_split(c, 15)


@query(f"WITH {CLIPS}, i AS (SELECT CAST(stream_id AS VARCHAR) AS video_name, label, min(frame) AS s, max(frame) AS e FROM f GROUP BY ALL) SELECT i.video_name, label, clip_id, CAST(greatest(s, start_time) AS BIGINT) AS common FROM i JOIN c ON i.video_name = c.video_name AND greatest(s, start_time) <= least(e, end_time - 1)")
def interval_join(spark, d):
    i = frames(spark, d).groupBy(F.col("stream_id").cast("string").alias("video_name"), "label").agg(F.min("frame").alias("start"), F.max("frame").alias("end"))
    c = clips(spark, d).select("video_name", "clip_id", F.col("start_time").alias("start"), (F.col("end_time") - 1).alias("end"))
    j = J.interval_join(i, c, ["video_name"], 32)
    return j.select("video_name", F.col("l.label").alias("label"), F.col("r.clip_id").alias("clip_id"), F.greatest("l.start", "r.start").alias("common"))


@query(f"WITH {CLIPS} SELECT b.clip_id AS background_id, a.clip_id, a.video_name FROM c a JOIN c b ON a.video_name = b.video_name AND b.is_background AND NOT a.is_background AND b.clip_id = (a.clip_id // 3) * 3")
def background_link(spark, d):
    c = clips(spark, d)
    back = c.filter("is_background").select("video_name", F.col("clip_id").alias("background_id"))
    front = c.filter("NOT is_background").withColumn("background_id", F.floor(F.col("clip_id") / 3) * 3)
    return front.join(back, ["video_name", "background_id"]).select("background_id", "clip_id", "video_name")


@query(f"WITH {CLIPS}, k AS (SELECT * FROM c), x AS (SELECT *, coalesce(abs(start_time - lag(end_time) OVER w) > 5, true) AS far FROM k WINDOW w AS (PARTITION BY video_name ORDER BY start_time, clip_id)) SELECT video_name, clip_id, CAST(sum(CAST(far AS INTEGER)) OVER (PARTITION BY video_name ORDER BY start_time, clip_id) AS BIGINT) AS chain FROM x")
def contiguity(spark, d):
    return K.contiguity(clips(spark, d)).select("video_name", "clip_id", "chain")


@query(f"WITH {FRAMES}, n AS (SELECT stream_id, frame AS note_frame, min(label) AS note FROM f WHERE label = 'purchase' OR frame % 10 = 3 GROUP BY ALL) SELECT f.stream_id, f.frame, n.note_frame, n.note FROM f ASOF LEFT JOIN n ON f.stream_id = n.stream_id AND f.frame <= n.note_frame")
def asof_label(spark, d):
    f = frames(spark, d)
    notes = f.filter("label = 'purchase' OR frame % 10 = 3").select("stream_id", F.col("frame").alias("note_frame"), F.col("label").alias("note"))
    return J.asof_forward(f, notes).select("stream_id", "frame", "note_frame", "note")


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(f"SELECT a.label, a.vec_id AS left_id, b.vec_id AS right_id, round({_COS}, 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} >= 0.4")
def similarity_join(spark, d):
    e = table(spark, d, "embeddings")
    j = J.similarity_join(e, e, "label", "embedding", 0.4, "vec_id", "vec_id")
    return j.filter("left_id < right_id").withColumn("cosine", F.round("cosine", 4))


@query("WITH a AS (SELECT * FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT * FROM embeddings WHERE vec_id % 2 = 1), h AS (SELECT a.label, a.vec_id, coalesce(bool_or(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) < 1.1), false) AS hit FROM a LEFT JOIN b ON a.label = b.label GROUP BY ALL) SELECT label, round(avg(CAST(hit AS INTEGER)), 6) AS share, avg(CAST(hit AS INTEGER)) >= 0.3 AS match FROM h GROUP BY label")
def descriptor_match(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("feature"))
    return J.descriptor_match(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), "label", 1.1, 0.3).withColumn("share", F.round("share", 6))


@query(f"WITH t AS (SELECT label, vec_id % 3 AS frame, vec_id // 3 % 7 AS tile, embedding FROM embeddings), p AS (SELECT a.label, a.frame AS fa, b.frame AS fb, avg({_COS}) AS m FROM t a JOIN t b ON a.label = b.label AND a.tile = b.tile AND a.frame < 2 AND b.frame = 2 GROUP BY ALL) SELECT label, max(m) >= 0.2 AS match FROM p GROUP BY label")
def video_match(spark, d):
    e = table(spark, d, "embeddings")
    t = e.select("label", (F.col("vec_id") % 3).alias("frame"), (F.floor(F.col("vec_id") / 3) % 7).alias("tile"), F.col("embedding").alias("feature"))
    return J.video_match(t.filter("frame < 2"), t.filter("frame = 2"), "label", 0.2)


_FILES = "v AS (SELECT video_name AS video_ref, CAST(sum(CAST(height AS BIGINT) * width) AS BIGINT) AS area, count(*) AS n, max(end_time) AS last_accessed FROM c GROUP BY ALL), z AS (SELECT *, area * 10 AS size FROM v)"


def _files(spark, d):
    c = clips(spark, d).withColumnRenamed("video_name", "video_ref").withColumn("last_accessed", F.col("end_time"))
    return A.usage(c).withColumn("size", F.col("area") * 10)


@query(f"WITH {CLIPS}, {_FILES} SELECT video_ref, area, n, last_accessed FROM z")
def usage(spark, d):
    return _files(spark, d).drop("size")


@query(f"WITH {CLIPS}, {_FILES} SELECT video_ref, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(size) OVER (ORDER BY last_accessed DESC, video_ref ROWS UNBOUNDED PRECEDING) AS running FROM z) WHERE running <= 200000")
def cache_lru(spark, d):
    return A.cache_lru(_files(spark, d), 200000).select("video_ref", "running")


@query(f"WITH {CLIPS}, {_FILES} SELECT video_ref, round(benefit, 6) AS benefit, CAST(running AS BIGINT) AS running FROM (SELECT *, (1.0 - area / 5000.0) * n AS benefit, sum(size) OVER (ORDER BY (1.0 - area / 5000.0) * n DESC, video_ref ROWS UNBOUNDED PRECEDING) AS running FROM z WHERE (1.0 - area / 5000.0) * n > 0) WHERE running <= 200000")
def cache_benefit(spark, d):
    return A.cache_benefit(_files(spark, d), 200000, 5000.0).select("video_ref", F.round("benefit", 6).alias("benefit"), "running")


@query(f"WITH {FRAMES} SELECT stream_id, frame, label, metric, CASE WHEN label = 'click' THEN 0 ELSE 1 END AS clip_seq FROM f WHERE label IN ('click', 'view')")
def union_streams(spark, d):
    f = frames(spark, d)
    return S.chain(f.filter("label = 'click'"), f.filter("label = 'view'"))


@query(f"WITH {CLIPS} SELECT clip_id, video_name FROM lb WHERE label = 'view' INTERSECT SELECT clip_id, video_name FROM lb WHERE label = 'click'")
def label_intersect(spark, d):
    lb = clip_labels(spark, d)
    of = lambda x: lb.filter(F.col("label") == x).select("clip_id", "video_name")
    return S.set_operation("intersect", of("view"), of("click"))


_RANKED = "r AS (SELECT lang, d.doc_id, CAST(n_chars % 997 AS DOUBLE) / 997 AS score, CAST(quality AS DOUBLE) AS hit FROM documents d JOIN labels USING (doc_id)), t AS (SELECT lang, sum(hit) AS n_truth FROM r GROUP BY lang)"
_CURVE = f"{_RANKED}, w AS (SELECT *, sum(hit) OVER o AS tp, sum(CAST(hit = 0 AS INTEGER)) OVER o AS fp, row_number() OVER o AS k FROM r WINDOW o AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)), pr AS (SELECT lang, doc_id, k, tp / (tp + fp) AS precision, tp / n_truth AS recall FROM w JOIN t USING (lang) WHERE n_truth > 0)"


def _ranked(spark, d):
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return r.select("lang", "doc_id", ((F.col("n_chars") % 997).cast("double") / 997).alias("score"), F.col("quality").cast("double").alias("hit"))


def _curve(spark, d):
    r = _ranked(spark, d)
    return D.precision_recall(r, ["lang"], r.groupBy("lang").agg(F.sum("hit").alias("n_truth")), "doc_id")


@query(f"WITH {_CURVE} SELECT lang, doc_id, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr")
def precision_recall(spark, d):
    return _curve(spark, d).select("lang", "doc_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_AP = f"{_CURVE}, e AS (SELECT *, max(precision) OVER (PARTITION BY lang ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS env, recall - coalesce(lag(recall) OVER (PARTITION BY lang ORDER BY k), 0) AS step FROM pr), ap AS (SELECT lang, sum(env * step) AS ap FROM e GROUP BY lang)"


@query(f"WITH {_AP} SELECT lang, round(ap, 9) AS ap FROM ap")
def average_precision(spark, d):
    return D.average_precision(_curve(spark, d), ["lang"]).select("lang", F.round("ap", 9).alias("ap"))


@query(f"WITH {_AP} SELECT round(avg(ap), 9) AS map FROM ap")
def mean_ap(spark, d):
    return D.mean_ap(D.average_precision(_curve(spark, d), ["lang"])).select(F.round("map", 9).alias("map"))


@query(f"WITH {_RANKED}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) - 1 AS r FROM r) SELECT round(sum(hit) / 100.0, 9) AS recall, CAST(median(r) FILTER (WHERE hit > 0) AS DOUBLE) AS median_rank FROM k WHERE r < 10")
def recall_at_k(spark, d):
    return D.recall_at_k(_ranked(spark, d), "lang", 10, 100, "doc_id").withColumn("recall", F.round("recall", 9))


@query(f"WITH {_RANKED}, i AS (SELECT lang, doc_id % 20 AS image, bool_or(hit > 0) AS has_truth, bool_or(hit > 0 AND score > 0.5) AS correct FROM r GROUP BY ALL) SELECT lang, round(count(*) FILTER (WHERE has_truth AND correct) / CAST(count(*) FILTER (WHERE has_truth) AS DOUBLE), 9) AS corloc FROM i GROUP BY lang")
def corloc(spark, d):
    r = _ranked(spark, d)
    i = r.groupBy("lang", (F.col("doc_id") % 20).alias("image")).agg(F.max(F.col("hit") > 0).alias("has_truth"), F.max((F.col("hit") > 0) & (F.col("score") > 0.5)).alias("correct"))
    return D.corloc(i, "lang").withColumn("corloc", F.round("corloc", 9))


_DT = f"{DETECTIONS}, p AS (SELECT frame, idx, x0, y0, x1, y1, min(score) AS score FROM d WHERE stream_id % 2 = 0 GROUP BY ALL), dt AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY idx, x0, y0, x1, y1) AS det_id FROM p), h AS (SELECT frame, idx, x0, y0, x1, y1, min(score) > 0.08 AS difficult FROM d WHERE stream_id % 2 = 1 GROUP BY ALL), gt AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY idx, x0, y0, x1, y1) AS gt_id FROM h)"


def _sides(spark, d):
    det = detections(spark, d)
    key = lambda n: F.row_number().over(W.partitionBy("frame").orderBy("idx", *B.SIDES)).alias(n)
    # what follows goes by frame: one exchange of each side
    a = det.filter("stream_id % 2 = 0").repartition("frame").groupBy("frame", "idx", *B.SIDES).agg(F.min("score").alias("score"))
    b = det.filter("stream_id % 2 = 1").repartition("frame").groupBy("frame", "idx", *B.SIDES).agg((F.min("score") > 0.08).alias("difficult"))
    return a.select("frame", key("det_id"), *B.SIDES, "score"), b.select("frame", key("gt_id"), *B.SIDES, "difficult")


_PAIR = f"m AS (SELECT a.frame, a.det_id, a.score, b.gt_id, b.difficult, {_IOU} / CAST((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU} AS DOUBLE) AS iou FROM dt a JOIN gt b ON a.frame = b.frame)"


@query(f"WITH {_DT}, {_PAIR}, best AS (SELECT *, row_number() OVER (PARTITION BY frame, det_id ORDER BY iou DESC, gt_id) AS k FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY frame, gt_id, iou >= 0.3 ORDER BY score DESC, det_id) AS j FROM best WHERE k = 1) SELECT dt.frame, CAST(dt.det_id AS INTEGER) AS det_id, dt.score, CASE WHEN coalesce(iou < 0.3, true) THEN 'fp' WHEN difficult THEN 'ignored' WHEN j = 1 THEN 'tp' ELSE 'fp' END AS status FROM dt LEFT JOIN o USING (frame, det_id)")
def true_positives(spark, d):
    a, b = _sides(spark, d)
    return D.true_positives(a, b, ["frame"], 0.3).select("frame", "det_id", "score", "status")


@query(f"WITH {_DT}, {_PAIR} SELECT frame, CAST(det_id AS INTEGER) AS col, CAST(CASE WHEN iou < 0.1 THEN -1 WHEN iou < 0.3 THEN -2 ELSE gt_id END AS INTEGER) AS \"row\" FROM m QUALIFY row_number() OVER (PARTITION BY frame, det_id ORDER BY iou DESC, gt_id) = 1")
def argmax_match(spark, d):
    a, b = _sides(spark, d)
    j = a.select("frame", F.col("det_id").alias("col"), F.struct(*B.SIDES).alias("a")).join(b.select("frame", F.col("gt_id").alias("row"), F.struct(*B.SIDES).alias("b")), "frame")
    sim = j.select("frame", "col", "row", B.iou(F.col("a"), F.col("b")).alias("similarity"))
    return D.argmax_match(sim, ["frame"], 0.3, 0.1)


@query()
def bipartite_match(spark, d):
    a, b = _sides(spark, d)
    j = a.select("frame", F.col("det_id").alias("col"), F.struct(*B.SIDES).alias("a")).join(b.select("frame", F.col("gt_id").alias("row"), F.struct(*B.SIDES).alias("b")), "frame")
    return D.bipartite_match(j.select("frame", "col", "row", B.iou(F.col("a"), F.col("b")).alias("similarity")), ["frame"])


@query(f"WITH {_DT}, j AS (SELECT a.frame, a.det_id, b.x0, b.y0, b.x1, b.y1, b.score FROM dt a JOIN dt b ON a.frame = b.frame AND {_IOU} / CAST((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU} AS DOUBLE) > 0.2) SELECT frame, CAST(det_id AS INTEGER) AS det_id, round(sum(score * x0) / nullif(sum(score), 0), 6) AS x0, round(sum(score * y1) / nullif(sum(score), 0), 6) AS y1, round(avg(score), 6) AS score FROM j GROUP BY frame, det_id")
def box_voting(spark, d):
    a, _ = _sides(spark, d)
    return D.box_voting(a, a, ["frame"], 0.2).select("frame", "det_id", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"), F.round("score", 6).alias("score"))


@query(f"WITH {DETECTIONS}, g AS (SELECT DISTINCT stream_id FROM d), u AS (SELECT stream_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM d WHERE label = 'A' AND score > 0.09 GROUP BY ALL) SELECT stream_id, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(x1, 1) AS x1, coalesce(y1, 1) AS y1 FROM g LEFT JOIN u USING (stream_id)")
def coverage_box(spark, d):
    det = detections(spark, d)
    return D.coverage_box(det.filter("label = 'A' AND score > 0.09"), det.select("stream_id").distinct(), ["stream_id"])


@query(f"WITH {DETECTIONS} SELECT label, CAST(sum(CASE WHEN score > 0.08 THEN 0.0 WHEN idx = 1 THEN 0.5 ELSE 1.0 END) AS DOUBLE) AS n_truth, count(DISTINCT frame) AS n_images FROM d GROUP BY label")
def truth_statistics(spark, d):
    t = detections(spark, d).select("label", F.col("frame").alias("image"), (F.col("score") > 0.08).alias("difficult"), (F.col("idx") == 1).alias("group_of"))
    return D.truth_statistics(t, ["label"], 0.5)


@query()
def nms(spark, d):
    return D.nms(detections(spark, d), ["stream_id", "label"], 0.5, order=[*B.SIDES, "frame", "idx"]).select("stream_id", "label", "frame", "idx", "score", *B.SIDES)


@query()
def multiclass_nms(spark, d):
    return D.multiclass_nms(detections(spark, d), ["stream_id"], 0.03, 0.5, 20, 30, (0, 0, 100, 80))


@query(f"WITH {DETECTIONS} SELECT stream_id, frame, idx, label, score, x0, y0, x1, y1 FROM d WHERE score > 0.04 QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, frame, idx, label, x0, y0, x1, y1) <= 5")
def top_k(spark, d):
    det = D.filter_scores(detections(spark, d), 0.04)
    return D.top_k(det, ["stream_id"], 5, F.col("score").desc(), *[F.col(c) for c in ("frame", "idx", "label", *B.SIDES)])


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey > 0 AND n_nationkey <= 15")
def label_map(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("display_name"), F.col("n_nationkey").alias("seq"))
    return D.label_map(n, 15)


@query("WITH e AS (SELECT n_name AS label, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region), a AS (SELECT label, parent AS ancestor FROM e UNION SELECT label, label FROM e UNION SELECT parent, parent FROM e UNION SELECT a.label, b.parent FROM e a JOIN e b ON a.parent = b.label) SELECT s_suppkey AS image, a.ancestor AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN a ON a.label = n_name")
def label_hierarchy(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("label"), F.col("r_name").alias("parent"))
    edges = edges.unionByName(r.select(F.col("r_name").alias("label"), F.lit("WORLD").alias("parent")))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return D.expand_boxes(s.select(F.col("s_suppkey").alias("image"), F.col("n_name").alias("label")), edges)


@query("WITH t AS (SELECT user_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, event_type FROM events), r AS (SELECT *, (ms - min(ms) OVER (PARTITION BY user_id)) / CAST(1000 AS DOUBLE) AS s, (max(ms) OVER (PARTITION BY user_id) - min(ms) OVER (PARTITION BY user_id)) / CAST(1000 AS DOUBLE) AS z FROM t) SELECT CAST(user_id AS VARCHAR) AS youtube_id, round(s, 3) AS second_no, event_type AS class, round(z, 3) AS last_second FROM r")
def raw_label_etl(spark, d):
    from frameloom.sources import raw_label_etl as etl

    e = table(spark, d, "events")
    raw = e.select(F.col("user_id").cast("string").alias("youtube_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("event_type").alias("class_name"), *[F.lit(0.0).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])
    return etl(raw, 30).select("youtube_id", F.round("second_no", 3).alias("second_no"), "class", F.round("last_second", 3).alias("last_second"))


@query(f"WITH {DETECTIONS} SELECT stream_id, CAST(frame // 500 AS BIGINT) AS batch, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, 'foreground' AS label FROM d GROUP BY ALL")
def union_crops(spark, d):
    return C.union_crops(detections(spark, d), 500)


@query(f"WITH {DETECTIONS}, b AS (SELECT *, CAST(frame // 500 AS BIGINT) AS batch FROM d) SELECT stream_id, batch, frame, idx, label, x0, y0, x1, y1, score FROM b QUALIFY frame = min(frame) OVER (PARTITION BY stream_id, batch)")
def first_frame_crops(spark, d):
    return C.first_frame_crops(detections(spark, d), 500)


@query()
def batch_crops(spark, d):
    return C.batch_crops(detections(spark, d), 500)


@query()
def merge_runs(spark, d):
    det = detections(spark, d).select("stream_id", "frame", *B.SIDES)
    c = C.union_crops(det.repartition("stream_id"), 500)
    return C.merge_runs(c, c, "union")


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey AS bits FROM orders) SELECT CAST(a.id AS BIGINT) AS id, CAST(bit_count(a.bits) AS BIGINT) AS area, CAST(bit_count(a.bits & 255) AS BIGINT) AS common, round(bit_count(a.bits & 255) / CAST(8 + bit_count(a.bits) - bit_count(a.bits & 255) AS DOUBLE), 9) AS iou FROM o a")
def masks(spark, d):
    m, k = F.array("o_custkey"), F.array(F.lit(255).cast("bigint"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), B.mask_area(m).alias("area"), B.mask_intersection(m, k).alias("common"), F.round(B.mask_iou(m, k), 9).alias("iou"))


@query(f"WITH {DETECTIONS} SELECT stream_id, frame, idx, CAST(x0 * 2.0 AS DOUBLE) AS sx, CAST(greatest(least(x0, 60), 20) AS INTEGER) AS cx, CASE WHEN x0 BETWEEN 20 AND 60 AND y0 BETWEEN 20 AND 60 THEN CAST(x0 AS DOUBLE) END AS px, CAST(100.0 - x1 AS DOUBLE) AS fx FROM d")
def keypoints(spark, d):
    k = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    first, w = lambda c: F.get(c, F.lit(0))["x"], B.box(20, 20, 60, 60)
    return detections(spark, d).select("stream_id", "frame", "idx", first(B.keypoints_scale(k, 2.0, 2.0)).alias("sx"), first(B.keypoints_clip(k, w)).alias("cx"), F.nanvl(first(B.keypoints_prune(k, w)), F.lit(None).cast("double")).alias("px"), first(B.keypoints_flip(k, [1, 0], 50.0)).alias("fx"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS video_name, CAST(o_custkey % 1000 AS BIGINT) AS elapsed FROM orders")
def put_log(spark, d):
    o = table(spark, d, "orders")
    return A.put_log(o.select(F.col("o_orderkey").cast("string").alias("video_name"), F.lit(5).cast("bigint").alias("start_time"), (F.col("o_custkey") % 1000 + 5).alias("end_time")))


@query("SELECT d.doc_id, text FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1")
def text_output(spark, d):
    """Texts as a reader of frames would give them, kept beside their labels."""
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id").select("doc_id", "text")
