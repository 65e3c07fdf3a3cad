import numpy as np
import pytest
from gridloom.functions import boxes as B
from gridloom.functions import oriented as O
from gridloom.functions import polygons as P
from gridloom.operators import export, match, suppress
from pyspark.sql import functions as F

DET = "det_id long, image_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize(
    "points,want",
    [
        ([(10, 10), (50, 20), (30, 60)], (10, 10, 50, 60)),  # inside
        ([(-20, -20), (60, -20), (60, 60), (-20, 60)], (0, 0, 60, 60)),  # over a corner
        ([(-10, 40), (30, 40), (30, 80), (-10, 80)], (0, 40, 30, 80)),  # over an edge
        ([(-50, -50), (150, -50), (150, 150), (-50, 150)], (0, 0, 100, 100)),  # around the image
        ([(200, 200), (250, 200), (250, 250)], (0, 0, 0, 0)),  # outside
        ([(0, 0), (100, 0), (100, 100), (0, 100)], (0, 0, 100, 100)),  # along the edges
        ([], (0, 0, 0, 0)),
    ],
)
def test_visible_box(spark, points, want):
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in points],)], "poly array<struct<x:double,y:double>>")
    row = P.with_visible_box(df, "poly", 100, 100).first()
    assert (row["x1"], row["y1"], row["x2"], row["y2"]) == want


def test_point_in_polygon_boundary(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    df = spark.createDataFrame([(5.0, 5.0), (0.0, 5.0), (10.0, 10.0), (11.0, 5.0)], "x double, y double")
    poly = P.points([(F.lit(float(a)), F.lit(float(b))) for a, b in square])
    x, y = F.col("x"), F.col("y")
    for inclusive, want in ((False, [True, False, False, False]), (True, [True, True, True, False])):
        got = df.select(P.contains(square, x, y, inclusive).alias("a"), P.contains_column(poly, x, y, inclusive).alias("b")).collect()
        assert [r["a"] for r in got] == want and [r["b"] for r in got] == want


def test_concave_polygon_against_crossings(spark):
    poly = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10)]
    rng = np.random.default_rng(2)
    pts = [(float(x), float(y)) for x, y in rng.uniform(-1, 11, (200, 2))]
    got = [r[0] for r in spark.createDataFrame(pts, "x double, y double").select(P.contains(poly, F.col("x"), F.col("y"), False)).collect()]

    def force(x, y):
        hits = 0
        for (ax, ay), (bx, by_) in zip(poly, poly[1:] + poly[:1]):
            if (ay > y) != (by_ > y):
                hits += ax + (y - ay) * (bx - ax) / (by_ - ay) > x
        return hits % 2 == 1

    assert got == [force(*p) for p in pts]


def test_fast_and_greedy_suppression_differ(spark):
    rows = [(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (2, 1, 0, 0.8, 4.0, 0.0, 14.0, 10.0), (3, 1, 0, 0.7, 8.0, 0.0, 18.0, 10.0), (4, 1, 1, 0.6, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, DET)
    ids = lambda d: sorted(r["det_id"] for r in d.collect())
    assert ids(suppress.greedy_nms(df, 0.3)) == [1, 3, 4]
    assert ids(suppress.fast_nms(df, 0.3)) == [1, 4]
    assert ids(suppress.non_max_suppression(df, 0.25, 0.3, classes=[1])) == [4]
    assert ids(suppress.non_max_suppression(df, 0.25, 0.3, agnostic=True)) == [1, 3]


def test_the_two_matchers_differ(spark):
    gts = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], "gt_id long, image_id long, cls int, x1 double, y1 double, x2 double, y2 double")
    dets = spark.createDataFrame([(1, 1, 0, 0.9, 0.0, 0.0, 10.0, 13.0), (2, 1, 0, 0.5, 0.0, 0.0, 10.0, 10.0)], DET)
    assert [r["det_id"] for r in match.match_evaluation(dets, gts, [0.5]).collect()] == [1]  # the most confident
    assert [r["det_id"] for r in match.match_confusion(dets, gts).collect()] == [2]  # the largest overlap


def test_probiou_of_equal_boxes(spark):
    o = O.Obb(*(F.lit(v) for v in (10.0, 10.0, 8.0, 4.0, 0.5)))
    far = O.Obb(*(F.lit(v) for v in (500.0, 10.0, 8.0, 4.0, 0.5)))
    row = spark.range(1).select(O.probiou(o, o).alias("same"), O.probiou(o, far).alias("far")).first()
    assert row["same"] > 0.99 and row["far"] < 1e-3


def test_enclosing_box(spark):
    pts = P.points([(F.lit(float(x)), F.lit(float(y))) for x, y in ((2, 1), (4, 3), (2, 5), (0, 3))])
    assert tuple(spark.range(1).select(pts.alias("p")).select(*P.polygon_box(F.col("p")).named()).first()) == (0, 1, 4, 5)


def test_mask_rle_round_trip(spark):
    rng = np.random.default_rng(3)
    masks = {k: np.flatnonzero(rng.random(400) < p) for k, p in ((1, 0.5), (2, 0.02), (3, 0.95), (4, 1.1))}
    rows = [(k, int(x)) for k, v in masks.items() for x in v]
    got = export.run_lengths(spark.createDataFrame(rows, "mask_id long, place int"), 400)
    for r in got.select("mask_id", "counts", export.rle_string(F.col("counts")).alias("rle")).collect():
        counts = r["counts"]
        on = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
        assert np.flatnonzero(on).tolist() == masks[r["mask_id"]].tolist()
        back, p = [], 0  # the public decoding rule of compact run lengths
        while p < len(r["rle"]):
            x, k, more = 0, 0, True
            while more:
                c = ord(r["rle"][p]) - 48
                x |= (c & 31) << (5 * k)
                more = bool(c & 32)
                p += 1
                k += 1
                if not more and c & 16:
                    x |= -1 << (5 * k)
            back.append(x + (back[-2] if len(back) > 2 else 0))
        assert back == counts


def test_box_round_trips(spark):
    df = spark.createDataFrame([(1.0, 2.0, 11.0, 22.0)], "x1 double, y1 double, x2 double, y2 double")
    for fmt in ("xywh", "ltwh"):
        assert tuple(df.select(*B.convert(B.convert(B.box(), "xyxy", fmt), fmt, "xyxy").named()).first()) == (1.0, 2.0, 11.0, 22.0)
