"""Detection analytics: suppression, voting, matching, evaluation, label maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.operators.fold import coded, fold_arrays, fold_groups


def boxed() -> Column:
    return F.struct(*B.SIDES)


def _iou_matrix(a: np.ndarray, b: np.ndarray, plus: float = 0.0) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    side = np.maximum(hi - lo + plus, 0)
    inter = side[..., 0] * side[..., 1]
    size = lambda r: np.abs((r[:, 2] - r[:, 0] + plus) * (r[:, 3] - r[:, 1] + plus))
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter, dtype=float), where=union > 0)


def _keep(boxes: np.ndarray, threshold: float, most: int | None, plus: float, strict: bool) -> list[int]:
    """Greedy suppression of boxes in score order: indices that stay."""
    kept: list[int] = []
    for i in range(len(boxes)):
        if most is not None and len(kept) >= most:
            break
        o = _iou_matrix(boxes[i : i + 1], boxes[kept], plus)[0] if kept else np.zeros(0)
        if not ((o >= threshold) if strict else (o > threshold)).any():
            kept.append(i)
    return kept


def nms(detections: DataFrame, by: list[str], threshold: float, max_output: int | None = None, order: list[str] | None = None, plus: float = 0.0, strict: bool = False) -> DataFrame:
    """Greedy non-maximum suppression in each group: by falling score (ties by
    ``order``) a box stays unless its IoU with one that stays is above the
    threshold (at or above, if ``strict``)."""
    tie = order or [*B.SIDES]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if threshold >= 1.0:
            return p.head(max_output) if max_output is not None else p
        return p.iloc[_keep(p[list(B.SIDES)].to_numpy(float), threshold, max_output, plus, strict)]

    schema = ", ".join(f"{n} {t}" for n, t in detections.dtypes)
    return fold_groups(detections, by, [F.col("score").desc(), *tie], schema, run)


def multiclass_nms(detections: DataFrame, by: list[str], score: float, threshold: float, per_class: int, total: int | None = None, window: tuple | None = None, label: str = "label") -> DataFrame:
    """Score filter, optional clipping to a window, suppression per class, then
    the ``total`` best of each group."""
    d = detections.filter(F.col("score") > score)
    if window:
        c = B.clip_to(boxed(), B.box(*window))
        d = d.withColumn("_b", c).withColumns({s: F.col(f"_b.{s}") for s in B.SIDES}).drop("_b").filter(B.area(boxed()) > 0)
    d = nms(d, [*by, label], threshold, per_class)
    if total is None:
        return d
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), label, *B.SIDES)
    return d.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= total).drop("_k")


def objectness_nms(detections: DataFrame, by: list[str], confidence: float, threshold: float) -> DataFrame:
    """Rows (centre x, y, w, h, objectness, classes array): corners, best class,
    suppression per class with +1 areas; survivors' overlaps are below the threshold."""
    d = detections.filter(F.col("objectness") >= confidence)
    best = F.array_max("classes")
    d = d.withColumn("_b", B.from_centre("x", "y", "w", "h")).withColumn("class_score", best).withColumn("class", (F.array_position("classes", best) - 1).cast("int"))
    d = d.select(*by, "class", "class_score", F.col("objectness"), (F.col("objectness") * F.col("class_score")).alias("score"), *[F.col(f"_b.{s}").alias(s) for s in B.SIDES])
    return nms(d, [*by, "class"], threshold, plus=1.0, strict=True)


def box_voting(selected: DataFrame, pool: DataFrame, by: list[str], threshold: float, key: str = "det_id") -> DataFrame:
    """Each selected box moved to the score-weighted mean of the pool boxes with
    an IoU above the threshold; its score is their plain mean."""
    p = pool.select(*by, boxed().alias("_p"), F.col("score").alias("_s"))
    j = selected.select(*by, key, boxed().alias("_b")).join(p, by).filter(B.iou(F.col("_b"), F.col("_p")) > threshold)
    mean = [F.try_divide(F.sum(F.col("_s") * F.col(f"_p.{s}")), F.sum("_s")).alias(s) for s in B.SIDES]
    return j.groupBy(*by, key).agg(*mean, F.avg("_s").alias("score"))


def refine_boxes(pool: DataFrame, by: list[str], nms_threshold: float, vote_threshold: float, max_output: int, key: str = "det_id") -> DataFrame:
    return box_voting(nms(pool, by, nms_threshold, max_output), pool, by, vote_threshold, key)


def clip_to_window(d: DataFrame, window: tuple, drop_empty: bool = True) -> DataFrame:
    out = d.withColumn("_b", B.clip_to(boxed(), B.box(*window))).withColumns({s: F.col(f"_b.{s}") for s in B.SIDES}).drop("_b")
    return out.filter(B.area(boxed()) > 0) if drop_empty else out


def prune_outside(d: DataFrame, window: tuple, completely: bool = False) -> DataFrame:
    """Without boxes that reach outside the window, or that are fully outside."""
    w = B.box(*window)
    return d.filter(~B.outside(boxed(), w)) if completely else d.filter(B.contains(w, boxed()))


def prune_non_overlapping(a: DataFrame, b: DataFrame, by: list[str], least: float) -> DataFrame:
    """Rows of a whose greatest IoA over the boxes of b reaches ``least``."""
    other = b.select(*[F.col(k).alias(f"_{k}") for k in by], boxed().alias("_o"))
    same = [F.col(k) == F.col(f"_{k}") for k in by]
    reach = F.coalesce(B.ioa(F.col("_o"), boxed()), F.lit(0.0)) >= least
    return a.join(other, [*same, reach], "left_semi")


def prune_small(d: DataFrame, side: float) -> DataFrame:
    return d.filter((F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side))


def filter_scores(d: DataFrame, above: float) -> DataFrame:
    return d.filter(F.col("score") > above)


def sort_by_field(d: DataFrame, field: str, descending: bool = True) -> DataFrame:
    c = F.col(field)
    return d.orderBy(c.desc() if descending else c.asc(), *B.SIDES)


def top_k(d: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return d.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def gather(d: DataFrame, indices: DataFrame, by: list[str], index: str = "idx") -> DataFrame:
    """Rows by index, in the multiplicity of ``indices`` (by, idx)."""
    return indices.join(d, [*by, index])


def pad_or_clip(d: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """Exactly n rows per group: the first n, padded with zero boxes."""
    k = d.withColumn("slot", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("slot") <= n)
    slots = d.select(*by).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    zero = {c: 0 for c, t in k.dtypes if t in ("int", "bigint", "double", "float") and c not in [*by, "slot"]}
    return slots.join(k, [*by, "slot"], "left").fillna(zero)


def coverage_box(d: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Box around each group's boxes; (0, 0, 1, 1) for groups without any."""
    out = groups.join(d.groupBy(*by).agg(*B.union_of(boxed())), by, "left")
    return out.fillna({"x0": 0, "y0": 0, "x1": 1, "y1": 1})


def random_box(d: DataFrame, groups: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """One box of each group, chosen by a seeded hash of its coordinates, with
    ``valid``; groups without any get -1s."""
    pick = F.min_by(boxed(), F.struct(F.xxhash64(F.lit(seed), *by, *B.SIDES), *B.SIDES)).alias("_b")
    out = groups.join(d.groupBy(*by).agg(pick), by, "left").withColumn("valid", F.col("_b").isNotNull())
    return out.withColumns({s: F.coalesce(F.col(f"_b.{s}"), F.lit(-1)) for s in B.SIDES}).drop("_b")


# matching


def argmax_match(sim: DataFrame, by: list[str], matched: float, unmatched: float | None = None, between_negative: bool = True, force: bool = False) -> DataFrame:
    """(by, col, row): each column's most similar row; -1 below ``unmatched``, -2
    between the thresholds (exchanged without ``between_negative``). ``force``:
    each row's best column takes that row. ``sim``: by, row, col, similarity."""
    low = matched if unmatched is None else unmatched
    below, between = (-1, -2) if between_negative else (-2, -1)
    s = F.col("similarity")
    best = sim.groupBy(*by, "col").agg(F.max_by("row", F.struct("similarity", -F.col("row"))).alias("row"), F.max("similarity").alias("similarity"))
    out = best.select(*by, "col", F.when(s < low, below).when(s < matched, between).otherwise(F.col("row")).alias("row"))
    if not force:
        return out
    forced = sim.groupBy(*by, "row").agg(F.max_by("col", F.struct("similarity", -F.col("col"))).alias("col")).groupBy(*by, "col").agg(F.min("row").alias("_forced"))
    return out.join(forced, [*by, "col"], "left").select(*by, "col", F.coalesce("_forced", "row").alias("row"))


def bipartite_match(sim: DataFrame, by: list[str]) -> DataFrame:
    """(by, col, row): greedy one-to-one pairs by falling similarity (ties by row,
    col); columns left over get -1."""
    cols = [*by, "col", "row"]
    kinds = dict(sim.dtypes)

    def run(b: pa.RecordBatch, starts: np.ndarray) -> dict[str, pa.Array]:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b.num_rows)))
        (col, cols_of), (row, rows_of) = coded(b.column("col")), coded(b.column("row"))
        # each group's columns and rows get numbers of their own
        _, head, col = np.unique(group * (len(cols_of) + 1) + col, return_index=True, return_inverse=True)
        row = np.unique(group * (len(rows_of) + 1) + row, return_inverse=True)[1]
        at, taken = [-1] * len(head), bytearray(len(row))
        some = np.flatnonzero(pc.fill_null(pc.greater(b.column("similarity"), 0), False).to_numpy(zero_copy_only=False) & ~np.isnan(b.column("similarity").cast(pa.float64()).to_numpy(zero_copy_only=False)))
        for i, r, c in zip(some.tolist(), row[some].tolist(), col[some].tolist(), strict=True):
            if at[c] < 0 and not taken[r]:
                at[c], taken[r] = i, 1
        at = np.array(at, np.int64)
        match = b.column("row").take(pa.array(np.maximum(at, 0)))
        out = {c: b.column(c).take(pa.array(head)) for c in [*by, "col"]}
        return out | {"row": pc.if_else(pa.array(at >= 0), match, pa.scalar(-1, match.type))}

    order = [F.col("similarity").desc(), "row", "col"]
    return fold_arrays(sim, by, order, ", ".join(f"`{c}` {kinds[c]}" for c in cols), run)


def true_positives(detections: DataFrame, truth: DataFrame, by: list[str], threshold: float, key: str = "det_id") -> DataFrame:
    """(by, key, score, status, gt_id) with status tp, fp or ignored.

    Each detection takes the truth of greatest IoU (ties: smaller gt_id); at or
    above the threshold it is ignored for a difficult truth, true for the first
    detection of that truth by falling score, else false. Truths marked group_of
    only take detections left over, by intersection over the detection; these are
    ignored (see ``group_of_weights``).
    """
    t = truth.filter(~F.coalesce("group_of", F.lit(False))) if "group_of" in truth.columns else truth
    hard = F.coalesce("difficult", F.lit(False)) if "difficult" in truth.columns else F.lit(False)
    g = t.select(*by, "gt_id", boxed().alias("_g"), hard.alias("_hard"))
    d = detections.select(*by, key, "score", boxed().alias("_d"))
    pair = d.join(g, by).withColumn("iou", F.coalesce(B.iou(F.col("_d"), F.col("_g")), F.lit(0.0)))
    best = pair.groupBy(*by, key, "score").agg(F.max_by(F.struct("gt_id", "iou", "_hard"), F.struct("iou", -F.col("gt_id"))).alias("m"))
    first = F.row_number().over(W.partitionBy(*by, "m.gt_id", F.col("m.iou") >= threshold).orderBy(F.col("score").desc(), key))
    hit = F.col("m.iou") >= threshold
    s = best.withColumn("_k", first).select(*by, key, F.when(hit & F.col("m._hard"), "ignored").when(hit & (F.col("_k") == 1), "tp").otherwise("fp").alias("status"), F.when(hit, F.col("m.gt_id")).alias("gt_id"))
    out = detections.select(*by, key, "score").join(s, [*by, key], "left").withColumn("status", F.coalesce("status", F.lit("fp")))
    if "group_of" in truth.columns:
        crowd = truth.filter("group_of").select(*by, boxed().alias("_g"))
        left = out.filter("status = 'fp'").select(*by, key).join(d, [*by, key]).join(crowd, by).filter(B.ioa(F.col("_g"), F.col("_d")) >= threshold)
        out = out.join(left.select(*by, key).distinct().withColumn("_in", F.lit(True)), [*by, key], "left")
        out = out.withColumn("status", F.when(F.col("_in"), "ignored").otherwise(F.col("status"))).drop("_in")
    return out


def group_of_weights(detections: DataFrame, truth: DataFrame, by: list[str], threshold: float, weight: float) -> DataFrame:
    """Each group-of truth with detections inside: one entry, the greatest score, ``weight``."""
    crowd = truth.filter("group_of").select(*by, "gt_id", boxed().alias("_g"))
    j = detections.select(*by, "score", boxed().alias("_d")).join(crowd, by).filter(B.ioa(F.col("_g"), F.col("_d")) >= threshold)
    return j.groupBy(*by, "gt_id").agg(F.max("score").alias("score")).withColumn("weight", F.lit(weight))


def precision_recall(ranked: DataFrame, by: list[str], total: DataFrame, tie: str = "det_id") -> DataFrame:
    """Running precision and recall by falling score. ``ranked``: by, score, hit
    (0, 1 or a weight); ``total``: by, n_truth. Groups without truth give none."""
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    tp = F.sum("hit").over(w)
    fp = F.sum((F.col("hit") == 0).cast("double")).over(w)
    r = ranked.withColumns({"tp": tp.cast("double"), "fp": fp, "k": F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), tie))})
    r = r.join(total.filter("n_truth > 0"), by)
    return r.select(*by, tie, "k", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("n_truth")).alias("recall"))


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap): precision made non-increasing from the right, summed over recall."""
    right = W.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    left = W.partitionBy(*by).orderBy("k")
    c = curve.withColumn("envelope", F.max("precision").over(right)).withColumn("step", F.col("recall") - F.coalesce(F.lag("recall").over(left), F.lit(0.0)))
    return c.groupBy(*by).agg(F.sum(F.col("envelope") * F.col("step")).alias("ap"))


def mean_ap(ap: DataFrame) -> DataFrame:
    """Mean over classes, NaN left out."""
    return ap.agg(F.avg(F.when(~F.isnan("ap"), F.col("ap"))).alias("map"))


def corloc(images: DataFrame, by: str) -> DataFrame:
    """Images with a right detection over images with truth: ``images`` has
    (by, image, has_truth, correct)."""
    n = F.sum(F.col("has_truth").cast("double"))
    k = F.sum((F.col("has_truth") & F.col("correct")).cast("double"))
    return images.groupBy(by).agg(F.coalesce(F.try_divide(k, n), F.lit(float("nan"))).alias("corloc"))


def recall_at_k(ranked: DataFrame, image: str, k: int, n_truth: int, tie: str = "det_id") -> DataFrame:
    """recall: hits among the first k of each image over all truths; median_rank:
    median 0-based rank of those hits."""
    w = W.partitionBy(image).orderBy(F.col("score").desc(), tie)
    r = ranked.withColumn("_r", F.row_number().over(w) - 1).filter(F.col("_r") < k)
    return r.agg((F.sum("hit") / F.lit(float(n_truth))).alias("recall"), F.percentile(F.when(F.col("hit") > 0, F.col("_r")), F.lit(0.5)).alias("median_rank"))


def truth_statistics(truth: DataFrame, by: list[str], weight: float = 1.0) -> DataFrame:
    """(by, n_truth, n_images): difficult ones don't count but mark their image;
    group-of ones count ``weight``."""
    hard, crowd = F.coalesce("difficult", F.lit(False)), F.coalesce("group_of", F.lit(False))
    n = F.sum(F.when(hard, 0.0).when(crowd, weight).otherwise(1.0))
    return truth.groupBy(*by).agg(n.alias("n_truth"), F.count_distinct("image").alias("n_images"))


def relation_boxes(relations: DataFrame, phrase: bool) -> DataFrame:
    """Relations (subject, object structs): as they are, or as one box around both."""
    if not phrase:
        return relations
    around = B.union_box(F.col("subject"), F.col("object"))
    return relations.withColumn("_b", around).withColumns({s: F.col(f"_b.{s}") for s in B.SIDES}).drop("_b", "subject", "object")


def relation_similarity(a: Column, b: Column) -> Column:
    """A relation is as similar as the worse of its two boxes."""
    return F.least(B.iou(a["subject"], b["subject"]), B.iou(a["object"], b["object"]))


# label maps


def label_map(items: DataFrame, most: int) -> DataFrame:
    """(id, name) with 0 < id <= most: the first item of an id, its display name if it has one."""
    first = F.row_number().over(W.partitionBy("id").orderBy("seq"))
    ok = items.filter((F.col("id") > 0) & (F.col("id") <= most)).withColumn("_k", first).filter("_k = 1")
    return ok.select("id", F.coalesce("display_name", "name").alias("name"))


def fill_gaps(labels: DataFrame, most: int) -> DataFrame:
    """Every id from 1 to most, with its number as the name where there is none."""
    ids = labels.sparkSession.range(1, most + 1)
    return ids.join(labels, "id", "left").select("id", F.coalesce("name", F.col("id").cast("string")).alias("name"))


def ancestors(edges: DataFrame) -> DataFrame:
    """(label, ancestor) closure of (label, parent), each label its own ancestor.
    Rounds double the reach, so their number is the logarithm of the depth."""
    nodes = edges.select(F.explode(F.array("label", "parent")).alias("label")).distinct()
    reach = nodes.select("label", F.col("label").alias("ancestor")).unionByName(edges.select("label", F.col("parent").alias("ancestor"))).distinct()
    n = -1
    while (m := reach.count()) != n:
        n = m
        up = reach.select(F.col("label").alias("ancestor"), F.col("ancestor").alias("further"))
        reach = reach.join(up, "ancestor").select("label", F.col("further").alias("ancestor")).distinct()
    return reach


def expand_boxes(boxes: DataFrame, edges: DataFrame) -> DataFrame:
    """Box rows once for each ancestor of their label, itself included."""
    up = ancestors(edges)
    j = boxes.join(up, "label", "left")
    return j.withColumn("label", F.coalesce("ancestor", "label")).drop("ancestor")


def expand_image_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels seen (confidence 1) expand to ancestors, others to descendants."""
    up = ancestors(edges)
    down = up.select(F.col("ancestor").alias("label"), F.col("label").alias("ancestor"))
    way = lambda d, t: d.join(t, "label", "left").withColumn("label", F.coalesce("ancestor", "label")).drop("ancestor")
    return way(labels.filter("confidence = 1"), up).unionByName(way(labels.filter("confidence <> 1"), down)).distinct()


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(box rows, image-label rows) of a mixed annotation table."""
    return rows.filter("confidence IS NULL"), rows.filter("x0 IS NULL")


def mask_nms(masks: DataFrame, by: list[str], threshold: float, key: str = "det_id", mask: str = "mask") -> DataFrame:
    """Suppression by mask IoU (arrays of longs), as ``nms`` does by boxes."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        bits = [np.asarray(m, np.int64).view(np.uint64) for m in p[mask]]
        for i, m in enumerate(bits):
            for j in kept:
                both = int(np.bitwise_count(m & bits[j]).sum())
                union = int(np.bitwise_count(m | bits[j]).sum())
                if union and both / union > threshold:
                    break
            else:
                kept.append(i)
        return p.iloc[kept]

    schema = ", ".join(f"{n} {t}" for n, t in masks.dtypes)
    return fold_groups(masks, by, [F.col("score").desc(), key], schema, run)


def evaluate(detections: DataFrame, truth: DataFrame, threshold: float = 0.5, label: str = "label", image: str = "image", key: str = "det_id", weight: float = 1.0) -> DataFrame:
    """(label, ap, corloc, n_truth) of boxes by class and image; ``mean_ap`` sums up.

    ``truth`` may have ``difficult`` and ``group_of``; ignored detections don't
    count. Classes without a countable truth have no row.
    """
    for c in ("difficult", "group_of"):
        if c not in truth.columns:
            truth = truth.withColumn(c, F.lit(False))
    total = truth_statistics(truth.withColumnRenamed(image, "image"), [label], weight)
    found = true_positives(detections, truth, [label, image], threshold, key)
    ranked = found.filter("status <> 'ignored'").select(label, F.concat_ws("/", F.col(image), F.col(key)).alias(key), "score", (F.col("status") == "tp").cast("double").alias("hit"))
    if weight:
        extra = group_of_weights(detections, truth, [label, image], threshold, weight)
        ranked = ranked.unionByName(extra.select(label, F.concat_ws("/", F.lit("group"), F.col(image), F.col("gt_id")).alias(key), "score", F.col("weight").alias("hit")))
    ap = average_precision(precision_recall(ranked, [label], total.select(label, "n_truth"), key), [label])
    right = found.filter("status = 'tp'").select(label, image).distinct().withColumn("correct", F.lit(True))
    images = truth.select(label, image).distinct().join(right, [label, image], "left")
    loc = corloc(images.select(label, F.lit(True).alias("has_truth"), F.coalesce("correct", F.lit(False)).alias("correct")), label)
    counted = total.filter("n_truth > 0")
    return counted.join(ap, label, "left").join(loc, label, "left").select(label, F.coalesce("ap", F.lit(0.0)).alias("ap"), "corloc", "n_truth")
