"""Queries of oriented exports, polygon tiles, prototype masks, hyper-parameter sampling and motion filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import boxes as B
from gridloom.functions import oriented as O
from gridloom.operators.datasets import hash_order
from gridloom.plans.views import DETECTIONS, GT, ctes, detections, ground_truth, read
from gridloom.streaming.tracking import Motion, measure

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _obb() -> O.Obb:
    c = B.xyxy2xywh(B.box())
    return O.Obb(c.a, c.b, c.c, c.d, F.col("conf") * 2 - 0.5)


@query("k7_obb_json", ctes(DETECTIONS, "SELECT det_id, image_id, cls category_id, round((x1+x2)/2,3) cx, round((y1+y2)/2,3) cy, round(conf*2-5e-1,3) r, round((x1+x2)/2+(x2-x1)/2*cos(conf*2-5e-1)-(y2-y1)/2*sin(conf*2-5e-1),3) px FROM detections"))
def k7(spark, d):
    """Records of oriented boxes: the box, its angle and its first corner."""
    o = _obb()
    return detections(spark, d).select("det_id", "image_id", F.col("cls").alias("category_id"), F.round(o.x, 3).alias("cx"), F.round(o.y, 3).alias("cy"), F.round(o.r, 3).alias("r"), F.round(O.corners(o)[0][0], 3).alias("px"))


@query("k9_keypoint_json", ctes(DETECTIONS, "SELECT det_id, '[' || x1 || ',' || y1 || ',2.0,' || x2 || ',' || y2 || ',1.0]' keypoints FROM detections"))
def k9(spark, d):
    b = B.box()
    return detections(spark, d).select("det_id", F.to_json(F.array(b.a, b.b, F.lit(2.0), b.c, b.d, F.lit(1.0))).alias("keypoints"))


@query("k10_dota_lines", ctes(DETECTIONS, "SELECT det_id, cls, 'P' || image_id || ' ' || printf('%.4f', conf) || ' ' || printf('%.1f %.1f', x1, y1) line FROM detections"))
def k10(spark, d):
    """Lines of the per-class task files (written with ``partitionBy("cls").text``)."""
    text = F.concat_ws(" ", F.concat(F.lit("P"), F.col("image_id").cast("string")), F.format_string("%.4f", "conf"), F.format_string("%.1f", "x1"), F.format_string("%.1f", "y1"))
    return detections(spark, d).select("det_id", "cls", text.alias("line"))


def clipped_area(points: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Area of a convex polygon inside a box: it is cut by one side of the box after another."""
    p = [tuple(q) for q in points]
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for a, b in zip(p, p[1:] + p[:1]):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if (da >= 0) != (db >= 0):
                t = da / (da - db)
                out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
        p = out
        if not p:
            return 0.0
    x, y = np.array(p).T
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


@F.pandas_udf(T.DoubleType())
def polygon_iof(coords: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """Share of a convex polygon's area that lies in a box."""
    out = []
    for c, *box in zip(coords, x1, y1, x2, y2):
        p = np.asarray(c, float).reshape(-1, 2)
        whole = clipped_area(p, (-1e18, -1e18, 1e18, 1e18))
        out.append(clipped_area(p, tuple(box)) / whole if whole > 0 else 0.0)
    return pd.Series(out)


@query("j8_polygon_iof", ctes(DETECTIONS, "SELECT det_id, round((least(x2,300e0)-least(x1,300e0))*(least(y2,300e0)-least(y1,300e0))/((x2-x1)*(y2-y1)),6) iof FROM detections WHERE x1<300 AND y1<300"))
def j8(spark, d):
    """Boxes as polygons against one window; the overlap test comes first, so only those that meet it reach Python."""
    b = B.box()
    ring = F.array(b.a, b.b, b.c, b.b, b.c, b.d, b.a, b.d)
    near = detections(spark, d).where("x1 < 300 and y1 < 300")
    zero, top = F.lit(0.0), F.lit(300.0)
    return near.select("det_id", F.round(polygon_iof(ring, zero, zero, top, top), 6).alias("iof"))


@query("r6_prototype_masks", "SELECT vec_id, count(*) n FROM (SELECT vec_id, r, list_sum(list_transform(range(8), lambda k: embedding[r*8+k+1]::DOUBLE*embedding[56+k+1]::DOUBLE)) s FROM embeddings, (SELECT unnest(range(7)) r)) WHERE round(s,9)>0 AND r>=vec_id%3 AND r<7-vec_id%2 GROUP BY vec_id")
def r6(spark, d):
    """Seven prototype places times the vector's last eight values as coefficients; places over zero in a crop, counted."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("r"))
    part = F.slice("embedding", F.col("r") * 8 + 1, F.lit(8))
    s = F.aggregate(F.zip_with(part, F.slice("embedding", 57, 8), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    crop = (F.col("r") >= F.col("vec_id") % 3) & (F.col("r") < 7 - F.col("vec_id") % 2)
    return v.where((F.round(s, 9) > 0) & crop).groupBy("vec_id").agg(F.count("*").alias("n"))


_CORNERS = [("x1", "y1"), ("x1", "y2"), ("x2", "y1"), ("x2", "y2")]
#: A track's box some frames ago lies so far from its box, and so do all corners.
_PAST = "(g.gt_id%7-3)*4", "(g.gt_id%5-2)*4"
_unit_sql = lambda x, y, k: f"({k})/(sqrt(({x})*({x})+({y})*({y}))+1e-5)"
_turn = lambda x, y: (f"acos(greatest(-1e0,least(1e0,{_unit_sql(*_PAST, _PAST[0])}*{_unit_sql(f'd.{x}-g.{x}+{_PAST[0]}', f'd.{y}-g.{y}+{_PAST[1]}', f'd.{x}-g.{x}+{_PAST[0]}')}"  # noqa: E731
                      f"+{_unit_sql(*_PAST, _PAST[1])}*{_unit_sql(f'd.{x}-g.{x}+{_PAST[0]}', f'd.{y}-g.{y}+{_PAST[1]}', f'd.{y}-g.{y}+{_PAST[1]}')})))")  # fmt: skip


@query("m19_corner_angle_cost", ctes(DETECTIONS, GT, f"SELECT det_id, gt_id, round(conf*({'+'.join(_turn(x, y) for x, y in _CORNERS)})/4/{math.pi!r},6) cost FROM detections d JOIN gt g ON g.image_id=d.image_id AND g.cls=d.cls"))
def m19(spark, d):
    """Mean angle between the way that each corner of a track has gone and the way to that corner of a detection, times the score."""
    g = ground_truth(spark, d).select("image_id", "cls", "gt_id", *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    way = ((F.col("gt_id") % 7 - 3) * 4, (F.col("gt_id") % 5 - 2) * 4)
    cost = B.corner_angle(B.box("g"), way, B.box()) * F.col("conf")
    return detections(spark, d).join(g, ["image_id", "cls"]).select("det_id", "gt_id", F.round(cost, 6).alias("cost"))


_hash60 = lambda v: f"('0x' || substr(md5(({v})::VARCHAR),1,15))::BIGINT"


@query("t13_weighted_parents", f"""WITH b AS (SELECT p_brand, sum(p_size) s FROM part GROUP BY 1), c AS (SELECT p_brand, s, sum(s) OVER (ORDER BY p_brand) hi FROM b),
  w AS (SELECT i::BIGINT draw, {_hash60('i')}%(SELECT sum(s) FROM b)::BIGINT AS pick FROM (SELECT unnest(range(10)) i)) SELECT draw, p_brand FROM w JOIN c ON pick>=hi-s AND pick<hi""")
def t13(spark, d):
    """Ten draws of brands, weighed by their parts' sizes: cumulative weights joined with fixed pseudo-random points."""
    w = Window.orderBy("p_brand")  # a few brands
    per = read(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("s"))
    cum = per.withColumn("hi", F.sum("s").over(w)).withColumn("lo", F.col("hi") - F.col("s"))
    total = per.agg(F.sum("s").alias("total"))
    draws = spark.range(10).join(total, F.lit(True)).select(F.col("id").alias("draw"), (hash_order(F.col("id")) % F.col("total")).alias("at"))
    return draws.join(F.broadcast(cum), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("draw", "p_brand")


_normal = f"sqrt(ln(({_hash60('p_partkey')}%1000003+1)/1000004e0)*-2)*cos(({_hash60('p_partkey*31+7')}%1000003+1)/1000004e0*{2 * math.pi!r})"


@query("t14_mutation", f"SELECT p_partkey, round(greatest(900e0,least(2e3,p_retailprice*greatest(25e-2,least(4e0,exp({_normal}*2e-1))))),5) AS value FROM part")
def t14(spark, d):
    """Values times a log-normal factor (by a fixed hash), the factor in [0.25, 4], the result in its bounds, 5 digits."""
    u = (hash_order(F.col("p_partkey")) % 1_000_003 + 1) / 1_000_004.0
    v = (hash_order(F.col("p_partkey") * 31 + 7) % 1_000_003 + 1) / 1_000_004.0
    normal = F.sqrt(F.log(u) * -2) * F.cos(v * (2 * math.pi))
    factor = F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.exp(normal * 0.2)))
    return read(spark, d, "part").select("p_partkey", F.round(F.greatest(F.lit(900.0), F.least(F.lit(2000.0), F.col("p_retailprice") * factor)), 5).alias("value"))


def _filtered(kind: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, motion = None, None
        for b in batches:
            out = []
            for t, f, x1, y1, x2, y2 in b.itertuples(index=False, name=None):
                z = measure(np.array([x1, y1, x2, y2]), kind)
                if t != track:
                    track, motion, far = t, Motion(z, kind), 0.0
                else:
                    motion.predict()
                    far = motion.distance(z)
                    motion.update(z)
                out.append((t, f, motion.x[0], motion.x[1], far))
            yield pd.DataFrame(out, columns=["track_id", "frame_no", "cx", "cy", "gate"])

    return run


def _motion(spark, d, kind: bool) -> DataFrame:
    from gridloom.plans.tracking import streams

    rows = streams(spark, d).select(F.floor(F.col("det_id") / 100).alias("track_id"), "frame_no", "x1", "y1", "x2", "y2")
    ordered = rows.repartition("track_id").sortWithinPartitions("track_id", "frame_no")
    got = ordered.mapInPandas(_filtered(kind), "track_id long, frame_no long, cx double, cy double, gate double")
    return got.select("track_id", "frame_no", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "gate")])


QUERIES["m12_motion_filter_aspect"] = lambda s, d: _motion(s, d, True)
QUERIES["m13_motion_filter_size"] = lambda s, d: _motion(s, d, False)
QUERIES["m14_gating_distance"] = lambda s, d: _motion(s, d, True).where("gate <= 9.4877")
