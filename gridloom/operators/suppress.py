"""Suppression of overlapping candidates: greedy, fast, class-aware, rotated, and the whole post-processing.

All of them work per image (and class), so they shuffle once by that key. Greedy suppression folds the boxes of one image
and class, in order of confidence, inside a higher-order function; the number of boxes it folds is bounded by ``max_nms``.
Fast suppression is an anti join of ranked boxes and needs no bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions.boxes import Box


def ranked(df: DataFrame, keys: list[str], out: str = "rk") -> DataFrame:
    """``out``: place by falling confidence within ``keys``; ``det_id`` breaks ties."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("conf"), "det_id")))


def top_k(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    return ranked(df, keys).where(F.col("rk") <= k).drop("rk")


def filter_classes(df: DataFrame, classes: list[int] | None) -> DataFrame:
    return df if classes is None else df.where(F.col("cls").isin(classes))


def fast_nms(df: DataFrame, threshold: float, keys: list[str] = ["image_id", "cls"], similarity: Callable[..., Column] | None = None, near: Callable[..., Column] | None = None) -> DataFrame:
    """Boxes that no better-placed box of their group (kept or not) reaches ``threshold`` with.

    ``similarity`` takes the column prefixes of the two boxes; by default the plain ratio. ``near`` is a cheap test that
    every pair over the threshold passes.
    """
    sim = similarity or (lambda p, q: B.iou(B.box(p), B.box(q)))
    near = near or (lambda p, q: B.overlap(B.box(p), B.box(q)))
    rows = ranked(df, keys)
    other = rows.select(*[F.col(c).alias(f"o_{c}") for c in rows.columns])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"o_{k}"))
    better = (F.col("o_rk") < F.col("rk")) & near("", "o_") & (sim("", "o_") >= threshold)
    return rows.join(other, same & better, "left_anti").drop("rk")


def greedy_nms(df: DataFrame, threshold: float, keys: list[str] = ["image_id", "cls"], max_nms: int = 30000) -> DataFrame:
    """Greedy suppression: a box stays unless a box that stays and is better placed overlaps it by more than ``threshold``."""
    best = top_k(df, keys, max_nms)
    item = F.struct((-F.col("conf")).alias("neg"), "det_id", "x1", "y1", "x2", "y2")
    groups = best.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    corner = lambda s: Box(s["x1"], s["y1"], s["x2"], s["y2"])
    none = F.slice("items", 1, 0)

    def step(kept: Column, b: Column) -> Column:
        beaten = F.exists(kept, lambda k: B.overlap(corner(k), corner(b)) & (B.iou(corner(k), corner(b), eps=0) > threshold))
        return F.when(beaten, kept).otherwise(F.array_append(kept, b))

    kept = groups.select(*keys, F.explode(F.aggregate("items", none, step)).alias("b"))
    return kept.select(*keys, "b.det_id", (-F.col("b.neg")).alias("conf"), "b.x1", "b.y1", "b.x2", "b.y2")


def non_max_suppression(
    df: DataFrame,
    conf: float = 0.25,
    iou: float = 0.45,
    classes: list[int] | None = None,
    agnostic: bool = False,
    max_nms: int = 30000,
    max_det: int = 300,
    labels: DataFrame | None = None,
) -> DataFrame:
    """Confidence and class filters, the top ``max_nms`` of an image, greedy suppression, the top ``max_det``.

    ``labels`` (det_id, image_id, cls, x1..y2) are appended with confidence one before suppression.
    """
    rows = filter_classes(df.where(F.col("conf") > conf), classes).select("det_id", "image_id", "cls", "conf", "x1", "y1", "x2", "y2")
    if labels is not None:
        rows = rows.unionByName(labels.withColumn("conf", F.lit(1.0)).select(rows.columns))
    rows = top_k(rows, ["image_id"], max_nms)
    if agnostic:
        kept = greedy_nms(rows, iou, ["image_id"], max_nms).join(rows.select("det_id", "cls"), "det_id")
    else:
        kept = greedy_nms(rows, iou, ["image_id", "cls"], max_nms)
    return top_k(kept, ["image_id"], max_det)


def best_class(df: DataFrame, scores: str, conf: float, multi_label: bool = False) -> DataFrame:
    """Candidates with an array of class scores as rows of one class: the best one, or all above ``conf``."""
    rows = df.where(F.array_max(scores) > conf)
    if multi_label:
        return rows.select("*", F.posexplode(scores).alias("cls", "conf")).where(F.col("conf") > conf)
    return rows.withColumn("conf", F.array_max(scores)).withColumn("cls", F.array_position(scores, F.col("conf")).cast("int") - 1)


def end_to_end(df: DataFrame, conf: float, classes: list[int] | None, max_det: int, order: str = "det_id") -> DataFrame:
    """Already suppressed rows: filters, then the first ``max_det`` of an image in input order."""
    rows = filter_classes(df.where(F.col("conf") > conf), classes)
    return rows.withColumn("rk", F.row_number().over(Window.partitionBy("image_id").orderBy(order))).where(F.col("rk") <= max_det).drop("rk")


def merge_tiles(df: DataFrame, name: str = "tile", iou: float = 0.3) -> DataFrame:
    """Detections of tiles named ``<image>__<size>__<x>___<y>`` moved to their image and suppressed there (fast)."""
    part = lambda k: F.regexp_extract(name, r"^(.*)__(\d+)__(\d+)___(\d+)$", k)
    dx, dy = part(3).cast("double"), part(4).cast("double")
    moved = df.withColumn("image_id", part(1)).withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy})
    return fast_nms(moved, iou)


def recovered(df: DataFrame, conf: float, strict: float, loose: float, apart: float) -> DataFrame:
    """Boxes that loose suppression keeps and that overlap none of those strict suppression keeps by ``apart`` or more."""
    kept = non_max_suppression(df, conf, strict)
    more = non_max_suppression(df, conf, loose)
    other = kept.select(F.col("image_id").alias("o_image_id"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    hit = (F.col("image_id") == F.col("o_image_id")) & B.overlap(B.box(), B.box("o_")) & (B.iou(B.box(), B.box("o_")) >= apart)
    return more.join(other, hit, "left_anti")
