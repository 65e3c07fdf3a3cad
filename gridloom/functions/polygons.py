"""Polygons as ``array<struct<x, y>>`` columns and fixed polygons as lists of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.boxes import Box

Points = list[tuple[float, float]]


def points(pairs: list[tuple[Column, Column]]) -> Column:
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in pairs))


def _fold_xy(poly: Column, f) -> tuple[Column, Column]:
    return f(F.transform(poly, lambda p: p["x"])), f(F.transform(poly, lambda p: p["y"]))


def polygon_box(poly: Column) -> Box:
    lo, hi = _fold_xy(poly, F.array_min), _fold_xy(poly, F.array_max)
    return Box(lo[0], lo[1], hi[0], hi[1])


def clip_points(poly: Column, w: float, h: float) -> Column:
    def one(p: Column) -> Column:
        x, y = (F.least(F.greatest(p[n], F.lit(0.0)), F.lit(float(m))) for n, m in (("x", w), ("y", h)))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(poly, one)


def affine_points(poly: Column, m: list[list[float]]) -> Column:
    """Points mapped by a 3x3 matrix (with the perspective division)."""

    def one(p: Column) -> Column:
        x, y, z = (p["x"] * r[0] + p["y"] * r[1] + r[2] for r in m)
        return F.struct((x / z).alias("x"), (y / z).alias("y"))

    return F.transform(poly, one)


def contains(poly: Points, x: Column, y: Column, inclusive: bool) -> Column:
    """Whether (x, y) lies in a fixed polygon; points on its boundary count as ``inclusive`` says.

    A ray-crossing test per edge, built as one expression, so it stays inside generated code and can be pushed into a
    join condition.
    """
    inside, edge = F.lit(False), F.lit(False)
    for (ax, ay), (bx, by_) in zip(poly, poly[1:] + poly[:1]):
        ax, ay, bx, by_ = float(ax), float(ay), float(bx), float(by_)
        cross = (x - ax) * (by_ - ay) - (y - ay) * (bx - ax)
        edge = edge | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by_), max(ay, by_)))
        if ay != by_:
            # The edge reaches over the point's height, and its place there is right of the point.
            side = cross < 0 if by_ > ay else cross > 0
            hit = ((y >= min(ay, by_)) & (y < max(ay, by_))) & side
            inside = inside != hit
    return (inside | edge) if inclusive else (inside & ~edge)


def contains_column(poly: Column, x: Column, y: Column, inclusive: bool = False) -> Column:
    """As :func:`contains`, for a polygon that is a column."""
    n = F.size(poly)

    def walk(acc: Column, i: Column) -> Column:
        a, b = F.element_at(poly, i), F.element_at(poly, F.when(i == n, 1).otherwise(i + 1))
        cross = (x - a["x"]) * (b["y"] - a["y"]) - (y - a["y"]) * (b["x"] - a["x"])
        lo, hi = F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])
        on = (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(lo, hi)
        side = F.when(b["y"] > a["y"], cross < 0).otherwise(cross > 0)
        hit = (y >= lo) & (y < hi) & side
        return F.struct((acc["odd"] != hit).alias("odd"), (acc["on"] | on).alias("on"))

    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))
    out = F.aggregate(F.sequence(F.lit(1), n), start, walk)
    return (out["odd"] | out["on"]) if inclusive else (out["odd"] & ~out["on"])


def _turn(ax, ay, bx, by_, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax))


def crosses(p: tuple[Column, Column], q: tuple[Column, Column], line: Points) -> Column:
    """Whether the segment from ``p`` to ``q`` meets the fixed segment ``line``; touching counts."""
    (ax, ay), (bx, by_) = [(F.lit(float(x)), F.lit(float(y))) for x, y in line]
    d1, d2 = _turn(ax, ay, bx, by_, *p), _turn(ax, ay, bx, by_, *q)
    d3, d4 = _turn(*p, *q, ax, ay), _turn(*p, *q, bx, by_)

    def within(u, v, w) -> Column:
        return w[0].between(F.least(u[0], v[0]), F.greatest(u[0], v[0])) & w[1].between(F.least(u[1], v[1]), F.greatest(u[1], v[1]))

    a, b = (ax, ay), (bx, by_)
    proper = (d1 * d2 < 0) & (d3 * d4 < 0)
    touch = ((d1 == 0) & within(a, b, p)) | ((d2 == 0) & within(a, b, q)) | ((d3 == 0) & within(p, q, a)) | ((d4 == 0) & within(p, q, b))
    return proper | touch


def with_visible_box(df: DataFrame, poly: str, w: float, h: float) -> DataFrame:
    """``df`` with x1, y1, x2, y2: the box of the part of the polygon column inside the image.

    Points inside, crossings of the image's borders and image corners inside the polygon count; a polygon wholly inside
    keeps its own box, and one wholly outside (or without points) has a box of zeros. The points seen are a column of
    their own before the box is taken, so they are computed once.
    """
    w, h = float(w), float(h)
    n = F.size(poly)
    inside = F.filter(poly, lambda p: p["x"].between(0.0, w) & p["y"].between(0.0, h))

    def meets(i: Column) -> Column:
        a, b = F.element_at(poly, i), F.element_at(poly, F.when(i == n, 1).otherwise(i + 1))
        out = []
        for axis, other, bound, limit in (("x", "y", 0.0, h), ("x", "y", w, h), ("y", "x", 0.0, w), ("y", "x", h, w)):
            t = F.try_divide(F.lit(bound) - a[axis], b[axis] - a[axis])
            z = a[other] + t * (b[other] - a[other])
            at = F.struct(F.lit(bound).alias("x"), z.alias("y")) if axis == "x" else F.struct(z.alias("x"), F.lit(bound).alias("y"))
            out.append(F.when(t.between(0.0, 1.0) & z.between(0.0, limit), at))
        return F.array_compact(F.array(*out))

    edges = F.flatten(F.transform(F.sequence(F.lit(1), n), meets))
    corner = [
        F.when(contains_column(F.col(poly), F.lit(x), F.lit(y), True), F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")))
        for x, y in ((0.0, 0.0), (w, 0.0), (0.0, h), (w, h))
    ]
    some = F.coalesce(n > 0, F.lit(False))
    whole = F.struct(*polygon_box(F.col(poly)).named())
    out = df.withColumn("_whole", F.when(some, whole)).withColumn("_seen", F.when(some, F.concat(inside, edges, F.array_compact(F.array(*corner)))))
    all_in = (F.col("_whole.x1") >= 0) & (F.col("_whole.y1") >= 0) & (F.col("_whole.x2") <= w) & (F.col("_whole.y2") <= h)
    part = F.struct(*polygon_box(F.col("_seen")).named())
    out = out.withColumn("_box", F.when(all_in, F.col("_whole")).otherwise(part))
    names = ("x1", "y1", "x2", "y2")
    return out.withColumns({n: F.coalesce(F.col(f"_box.{n}"), F.lit(0.0)) for n in names}).drop("_whole", "_seen", "_box")


def with_resampled(df: DataFrame, poly: str, n: int, out: str) -> DataFrame:
    """``df`` with ``out``: ``n`` points at equal steps along the closed polygon (vertices stay if there is room)."""
    from gridloom.functions.shapes import resampled

    df = df.withColumn("_path", resampled(n)(F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])))
    return df.withColumn(out, F.zip_with("_path.x", "_path.y", lambda x, y: F.struct(x.alias("x"), y.alias("y")))).drop("_path")
