"""One-to-one matching of detections with ground truth, by rank windows over the pairs of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as B

THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


def candidate_pairs(dets: DataFrame, gts: DataFrame, least: float, same_class: bool, strict: bool = False) -> DataFrame:
    """``det_id, conf, cls, gt_id, gt_cls, image_id, iou`` of the pairs at or over ``least`` (over it, if ``strict``)."""
    g = gts.select(F.col("image_id").alias("g_image"), "gt_id", F.col("cls").alias("gt_cls"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    on = F.col("image_id") == F.col("g_image")
    if same_class:
        on = on & (F.col("cls") == F.col("gt_cls"))
    pairs = dets.join(g, on & B.overlap(B.box(), B.box("g"))).withColumn("iou", B.iou(B.box("g"), B.box()))
    pairs = pairs.where(F.col("iou") > least if strict else F.col("iou") >= least)
    return pairs.select("image_id", "det_id", "conf", "cls", "gt_id", "gt_cls", "iou")


def claims(pairs: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """``det_id, cls, gt_id, thrs`` of ``image_id, det_id, conf, cls, gt_id, iou``: the evaluator's matches within a
    class, with the thresholds at which each stands; ``iou`` may be any similarity.

    Each detection keeps its best truth, whatever the threshold; of the detections that claim a truth, the most
    confident one that reaches a threshold gets it there. So a detection holds the thresholds up to its own overlap
    that no more confident claim reaches. Both windows keep the join's partitioning by image and class.
    """
    own = Window.partitionBy("image_id", "cls", "det_id").orderBy(F.desc("iou"), "gt_id")
    claim = Window.partitionBy("image_id", "cls", "gt_id").orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, -1)
    best = pairs.withColumn("rk", F.row_number().over(own)).where("rk = 1").withColumn("held", F.coalesce(F.max("iou").over(claim), F.lit(0.0)))
    won = F.filter(F.array(*map(F.lit, thresholds)), lambda t: (F.col("iou") >= t) & (F.col("held") < t))
    return best.select("det_id", "cls", "gt_id", won.alias("thrs")).where(F.size("thrs") > 0)


def matched_thresholds(dets: DataFrame, gts: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """:func:`claims` over the boxes of an image and class that overlap enough."""
    return claims(candidate_pairs(dets, gts, thresholds[0], same_class=True), thresholds)


def match_evaluation(dets: DataFrame, gts: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """``det_id, thr, gt_id``: the matches of :func:`matched_thresholds`, a row for each threshold."""
    return matched_thresholds(dets, gts, thresholds).select("det_id", F.explode("thrs").alias("thr"), "gt_id")


def true_positives(dets: DataFrame, gts: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """``det_id, image_id, cls, conf, thr, tp`` for every detection and threshold."""
    hit = matched_thresholds(dets, gts, thresholds).select("det_id", "thrs")
    rows = dets.select("det_id", "image_id", "cls", "conf").join(hit, "det_id", "left")
    grid = rows.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("thr"))
    return grid.withColumn("tp", F.coalesce(F.array_contains("thrs", F.col("thr")), F.lit(False))).drop("thrs")


def match_confusion(dets: DataFrame, gts: DataFrame, conf: float = 0.25, iou: float = 0.45) -> DataFrame:
    """``det_id, cls, gt_id, gt_cls, iou``: class-agnostic matches over ``iou``; of rivals the largest overlap wins."""
    pairs = candidate_pairs(dets.where(F.col("conf") > conf), gts, iou, same_class=False, strict=True)
    own = Window.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "gt_id")
    claim = Window.partitionBy("image_id", "gt_id").orderBy(F.desc("iou"), "det_id")
    first = pairs.withColumn("rk", F.row_number().over(own)).where("rk = 1")
    return first.withColumn("rk", F.row_number().over(claim)).where("rk = 1").drop("rk")


def confusion_matrix(dets: DataFrame, gts: DataFrame, n_classes: int, conf: float = 0.25, iou: float = 0.45) -> DataFrame:
    """``pred, truth, n``: cells of the matrix with a background class numbered ``n_classes``."""
    matched = match_confusion(dets, gts, conf, iou)
    cells = matched.select(F.col("cls").alias("pred"), F.col("gt_cls").alias("truth"))
    missed = gts.join(matched.select("gt_id"), "gt_id", "left_anti").select(F.lit(n_classes).alias("pred"), F.col("cls").alias("truth"))
    spare = dets.where(F.col("conf") > conf).join(matched.select("det_id"), "det_id", "left_anti").select(F.col("cls").alias("pred"), F.lit(n_classes).alias("truth"))
    return cells.unionByName(missed).unionByName(spare).groupBy("pred", "truth").agg(F.count("*").alias("n"))


def near_duplicate_tracks(a: DataFrame, b: DataFrame, apart: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """The rows of both track lists (track_id, image_id, age, x1..y2) left after the shorter-lived of each close pair goes."""
    o = b.select(*[F.col(c).alias(f"o_{c}") for c in b.columns])
    close = a.join(o, (F.col("image_id") == F.col("o_image_id")) & B.overlap(B.box(), B.box("o_")) & (1 - B.iou(B.box(), B.box("o_")) < apart))
    gone_b = close.where("age > o_age").select(F.col("o_track_id").alias("track_id")).distinct()
    gone_a = close.where("age <= o_age").select("track_id").distinct()
    return a.join(gone_a, "track_id", "left_anti"), b.join(gone_b, "track_id", "left_anti")


def merged_pools(tracked: DataFrame, lost: DataFrame, refound: DataFrame, apart: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """``(tracked, lost)`` after refound tracks join the one and leave the other, without near duplicates between them."""
    key = "track_id"
    more = tracked.unionByName(refound.join(tracked.select(key), key, "left_anti").select(tracked.columns))
    fewer = lost.join(more.select(key), key, "left_anti").select(lost.columns)
    return near_duplicate_tracks(more, fewer, apart)
