"""Queries of the box, oriented-box, keypoint and polygon functions over the derived detections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import oriented as O
from gridloom.functions import polygons as P
from gridloom.plans.views import DETECTIONS, GT, ctes, detections, ground_truth, read

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, columns, sql: str | None, frame=detections, keys=("det_id",), view: str = DETECTIONS, table: str = "detections") -> None:
    """Register a projection: ``columns()`` gives the Spark columns, ``sql`` the same as a DuckDB select list."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir).select(*keys, *columns())

    QUERIES[name] = query
    if sql:
        ORACLES[name] = ctes(view, f"SELECT {', '.join(keys)}, {sql} FROM {table}")


C = ("cx", "cy", "w", "h")
L = ("l", "t", "w", "h")
_add("f01_xyxy2xywh", lambda: B.xyxy2xywh(B.box()).named(*C), "(x1+x2)/2 cx, (y1+y2)/2 cy, x2-x1 w, y2-y1 h")
_add("f02_xywh2xyxy", lambda: B.xywh2xyxy(B.xyxy2xywh(B.box())).named(),
     "(x1+x2)/2-(x2-x1)/2 x1, (y1+y2)/2-(y2-y1)/2 y1, (x1+x2)/2+(x2-x1)/2 x2, (y1+y2)/2+(y2-y1)/2 y2")
_add("f03_xywhn2xyxy", lambda: [F.round(c, 6).alias(n) for c, n in zip(B.xywhn2xyxy(B.xyxy2xywhn(B.box(), 640, 600), 640, 600, 3, 5), ("x1", "y1", "x2", "y2"))],
     "round(x1+3,6) x1, round(y1+5,6) y1, round(x2+3,6) x2, round(y2+5,6) y2")
_add("f04_xyxy2xywhn", lambda: B.xyxy2xywhn(B.box(), 600, 560, True, 0.5).named(*C),
     "(least(x1,5.995e2)+least(x2,5.995e2))/2/600e0 cx, (least(y1,5.595e2)+least(y2,5.595e2))/2/560e0 cy, (least(x2,5.995e2)-least(x1,5.995e2))/600e0 w, (least(y2,5.595e2)-least(y1,5.595e2))/560e0 h")
_add("f05_xywh2ltwh", lambda: B.xywh2ltwh(B.xyxy2xywh(B.box())).named(*L), "(x1+x2)/2-(x2-x1)/2 l, (y1+y2)/2-(y2-y1)/2 t, x2-x1 w, y2-y1 h")
_add("f06_xyxy2ltwh", lambda: B.xyxy2ltwh(B.box()).named(*L), "x1 l, y1 t, x2-x1 w, y2-y1 h")
_add("f07_ltwh2xywh", lambda: B.ltwh2xywh(B.xyxy2ltwh(B.box())).named(*C), "x1+(x2-x1)/2 cx, y1+(y2-y1)/2 cy, x2-x1 w, y2-y1 h")
_add("f08_ltwh2xyxy", lambda: B.ltwh2xyxy(B.xyxy2ltwh(B.box())).named(), "x1, y1, x1+(x2-x1) x2, y1+(y2-y1) y2")


def _obb(shift: float = 0.0) -> O.Obb:
    """An oriented box of the detection, turned by its confidence."""
    c = B.xyxy2xywh(B.box())
    return O.Obb(c.a + shift, c.b + shift, c.c, c.d, F.col("conf") * 3 - 0.5)


OBB = "obb AS (SELECT *, (x1+x2)/2 ox, (y1+y2)/2 oy, x2-x1 ow, y2-y1 oh, conf*3-5e-1 r FROM detections)"
OBB_CORNERS = """oc AS (SELECT det_id, image_id, cls, conf,
  ox+ow/2*cos(r)+(-oh/2*sin(r)) px1, oy+ow/2*sin(r)+oh/2*cos(r) py1, ox+ow/2*cos(r)-(-oh/2*sin(r)) px2, oy+ow/2*sin(r)-oh/2*cos(r) py2,
  ox-ow/2*cos(r)-(-oh/2*sin(r)) px3, oy-ow/2*sin(r)-oh/2*cos(r) py3, ox-ow/2*cos(r)+(-oh/2*sin(r)) px4, oy-ow/2*sin(r)+oh/2*cos(r) py4 FROM obb)"""
_obb_view = f"{DETECTIONS}, {OBB}, {OBB_CORNERS}"
_add("f09_xywhr2corners", lambda: [F.round(v, 4).alias(f"p{a}{i + 1}") for i, p in enumerate(O.corners(_obb())) for v, a in zip(p, "xy")],
     ", ".join(f"round(p{a}{i},4) p{a}{i}" for i in range(1, 5) for a in "xy"), view=_obb_view, table="oc")
_add("f11_regularize_rboxes", lambda: [F.round(v, 6).alias(n) for v, n in zip(O.regularize(_obb())[2:], ("w", "h", "r"))],
     f"round(CASE WHEN r-floor(r/{math.pi!r})*{math.pi!r} >= {math.pi / 2!r} THEN oh ELSE ow END,6) w, round(CASE WHEN r-floor(r/{math.pi!r})*{math.pi!r} >= {math.pi / 2!r} THEN ow ELSE oh END,6) h, round(r-floor(r/{math.pi / 2!r})*{math.pi / 2!r},6) r",
     view=_obb_view, table="obb")
_add("f12_scale_boxes", lambda: B.scale_boxes(B.box(), (640, 640), (1080, 1920)).named(),
     ", ".join(f"least(greatest(({v}-{p})/({640 / 1920!r}::DOUBLE),0e0),{m}e0) {v}" for v, p, m in (("x1", 0, 1920), ("y1", 140, 1080), ("x2", 0, 1920), ("y2", 140, 1080))))
_add("f13_scale_coords", lambda: [(v / F.lit(m)).alias(n) for v, m, n in zip(B.scale_boxes(B.box(), (640, 640), (1080, 1920))[:2], (1920.0, 1080.0), ("xn", "yn"))],
     ", ".join(f"least(greatest(({v}-{p})/({640 / 1920!r}::DOUBLE),0e0),{m}e0)/{m}e0 {n}" for v, p, m, n in (("x1", 0, 1920, "xn"), ("y1", 140, 1080, "yn"))))
_add("f14_clip_boxes", lambda: B.clip(B.box(), 320, 300).named(), "least(x1,320e0) x1, least(y1,300e0) y1, least(x2,320e0) x2, least(y2,300e0) y2")


def _quad() -> "F.Column":
    """The detection as a polygon of its four oriented corners."""
    return P.points(O.corners(_obb()))


_pts = ", ".join(f"{{'x': px{i}, 'y': py{i}}}" for i in range(1, 5))
_add("f15_clip_coords", lambda: [F.round(F.element_at(P.clip_points(_quad(), 320, 300), i + 1)[a], 4).alias(f"p{a}{i + 1}") for i in range(4) for a in "xy"],
     ", ".join(f"round(least(greatest(p{a}{i},0e0),{m}e0),4) p{a}{i}" for i in range(1, 5) for a, m in (("x", 320), ("y", 300))), view=_obb_view, table="oc")


def _f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = detections(spark, sf_dir).select("det_id", _quad().alias("poly"))
    return P.with_visible_box(quads, "poly", 320, 300).select("det_id", *[F.round(n, 3).alias(n) for n in ("x1", "y1", "x2", "y2")])


QUERIES["f16_segment2box"] = _f16


def _visible_sql() -> str:
    """Points of the quadrilaterals inside 320 x 300, crossings of its borders, and its corners inside the quadrilateral."""
    rows = [f"SELECT det_id, px{i} x, py{i} y FROM oc WHERE px{i} BETWEEN 0 AND 320 AND py{i} BETWEEN 0 AND 300" for i in range(1, 5)]
    for i in range(1, 5):
        k = i % 4 + 1
        for bound, limit in ((0, 300), (320, 300)):
            rows.append(f"SELECT det_id, {bound}e0, y FROM (SELECT det_id, t, py{i}+t*(py{k}-py{i}) y FROM (SELECT *, ({bound}-px{i})/nullif(px{k}-px{i},0) t FROM oc)) WHERE t BETWEEN 0 AND 1 AND y BETWEEN 0 AND {limit}")
        for bound, limit in ((0, 320), (300, 320)):
            rows.append(f"SELECT det_id, x, {bound}e0 FROM (SELECT det_id, t, px{i}+t*(px{k}-px{i}) x FROM (SELECT *, ({bound}-py{i})/nullif(py{k}-py{i},0) t FROM oc)) WHERE t BETWEEN 0 AND 1 AND x BETWEEN 0 AND {limit}")
    for x, y in ((0, 0), (320, 0), (0, 300), (320, 300)):
        turns = [f"sign(({x}-px{i})*(py{i % 4 + 1}-py{i})-({y}-py{i})*(px{i % 4 + 1}-px{i}))" for i in range(1, 5)]
        rows.append(f"SELECT det_id, {x}e0, {y}e0 FROM oc WHERE greatest({','.join(turns)})<=0 OR least({','.join(turns)})>=0")
    return " UNION ALL ".join(rows)


_whole = lambda f, a: f"{f}({','.join(f'p{a}{i}' for i in range(1, 5))})"
ORACLES["f16_segment2box"] = ctes(_obb_view, f"seen AS ({_visible_sql()})", "sb AS (SELECT det_id, min(x) x1, min(y) y1, max(x) x2, max(y) y2 FROM seen GROUP BY det_id)",
    f"SELECT oc.det_id, round(CASE WHEN i THEN {_whole('least', 'x')} ELSE coalesce(x1,0) END,3) x1, round(CASE WHEN i THEN {_whole('least', 'y')} ELSE coalesce(y1,0) END,3) y1, "
    f"round(CASE WHEN i THEN {_whole('greatest', 'x')} ELSE coalesce(x2,0) END,3) x2, round(CASE WHEN i THEN {_whole('greatest', 'y')} ELSE coalesce(y2,0) END,3) y2 "
    f"FROM (SELECT *, {_whole('least', 'x')}>=0 AND {_whole('least', 'y')}>=0 AND {_whole('greatest', 'x')}<=320 AND {_whole('greatest', 'y')}<=300 i FROM oc) oc LEFT JOIN sb USING (det_id)")  # fmt: skip
_add("f17_segments2boxes", lambda: [F.round(v, 4).alias(n) for v, n in zip(B.xyxy2xywh(P.polygon_box(_quad())), C)],
     "round((least(px1,px2,px3,px4)+greatest(px1,px2,px3,px4))/2,4) cx, round((least(py1,py2,py3,py4)+greatest(py1,py2,py3,py4))/2,4) cy, round(greatest(px1,px2,px3,px4)-least(px1,px2,px3,px4),4) w, round(greatest(py1,py2,py3,py4)-least(py1,py2,py3,py4),4) h",
     view=_obb_view, table="oc")


def _f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = detections(spark, sf_dir).select("det_id", _quad().alias("poly"))
    points = P.with_resampled(quads, "poly", 16, "path").select("det_id", F.posexplode("path").alias("k", "p"))
    return points.select("det_id", "k", (F.round("p.x", 3) + 0.0).alias("x"), (F.round("p.y", 3) + 0.0).alias("y"))  # no minus zero


QUERIES["f18_resample_segments"] = _f18
_lerp = lambda a: "CASE s WHEN 0 THEN p{0}1+(p{0}2-p{0}1)*f WHEN 1 THEN p{0}2+(p{0}3-p{0}2)*f WHEN 2 THEN p{0}3+(p{0}4-p{0}3)*f ELSE p{0}4+(p{0}1-p{0}4)*f END".format(a)
ORACLES["f18_resample_segments"] = ctes(_obb_view, """steps AS (SELECT CAST(row_number() OVER (ORDER BY t)-1 AS INT) k, CAST(least(floor(t),3) AS INT) s, t-least(floor(t),3) f FROM
  (SELECT unnest(range(11))*4e-1 t UNION ALL SELECT unnest(range(5))*1e0))""", f"SELECT det_id, k, round({_lerp('x')},3)+0e0 x, round({_lerp('y')},3)+0e0 y FROM oc CROSS JOIN steps")
_add("f19_make_divisible", lambda: [B.make_divisible(F.col("x2"), 32).alias("w32"), B.make_divisible(F.col("y2"), 32).alias("h32")], "CAST(ceil(x2/32)*32 AS BIGINT) w32, CAST(ceil(y2/32)*32 AS BIGINT) h32")
_add("f20_clean_str", lambda: [B.clean_str(F.col("text")).alias("clean")], "regexp_replace(text, '" + B.SPECIAL + "', '_', 'g') clean",
     frame=lambda s, d: read(s, d, "documents"), keys=("doc_id",), view="one AS (SELECT 1)", table="documents")
_add("f21_box_area", lambda: [B.area(B.box()).alias("area")], "(x2-x1)*(y2-y1) area")
_add("f22_format_convert", lambda: [*B.convert(B.convert(B.box(), "xyxy", "ltwh"), "ltwh", "xywh").named(*C)], "(x1+(x1+(x2-x1)))/2 cx, (y1+(y1+(y2-y1)))/2 cy, x1+(x2-x1)-x1 w, y1+(y2-y1)-y1 h")
_add("f23_scale_offset", lambda: B.shift(B.scale(B.box(), 2.0, 0.5), 7.0, -3.0).named(), "x1*2+7 x1, y1*5e-1-3 y1, x2*2+7 x2, y2*5e-1-3 y2")
_add("f24_normalize", lambda: [*B.Box(F.col("x1") / 640.0, F.col("y1") / 600.0, F.col("x2") / 640.0, F.col("y2") / 600.0).named()], "x1/640 x1, y1/600 y1, x2/640 x2, y2/600 y2")
_add("f25_add_padding", lambda: B.shift(B.box(), 16.0, 24.0).named(), "x1+16 x1, y1+24 y1, x2+16 x2, y2+24 y2")
_add("f26_flip", lambda: [*B.flip_lr(B.box(), 640).named("lx1", "ly1", "lx2", "ly2"), *B.flip_ud(B.box(), 600).named("ux1", "uy1", "ux2", "uy2")],
     "640-x2 lx1, y1 ly1, 640-x1 lx2, y2 ly2, x1 ux1, 600-y2 uy1, x2 ux2, 600-y1 uy2")
_add("f27_clip_instances", lambda: [*B.clip(B.box(), 320, 300).named(), F.when((F.col("x1") > 320) | (F.col("y1") > 300), 0).otherwise(2).alias("visibility")],
     "least(x1,320e0) x1, least(y1,300e0) y1, least(x2,320e0) x2, least(y2,300e0) y2, CASE WHEN x1>320 OR y1>300 THEN 0 ELSE 2 END visibility")
M = [[0.9, 0.1, 5.0], [-0.1, 1.1, -7.0], [0.0, 0.0, 1.0]]
_mx = [f"({x}*9e-1+{y}*1e-1+5)" for x, y in (("x1", "y1"), ("x2", "y2"), ("x1", "y2"), ("x2", "y1"))]
_my = [f"({x}*-1e-1+{y}*1.1e0+-7)" for x, y in (("x1", "y1"), ("x2", "y2"), ("x1", "y2"), ("x2", "y1"))]
_add("f28_apply_bboxes", lambda: [F.round(v, 6).alias(n) for v, n in zip(B.affine_box(B.box(), M), ("x1", "y1", "x2", "y2"))],
     f"round(least({','.join(_mx)}),6) x1, round(least({','.join(_my)}),6) y1, round(greatest({','.join(_mx)}),6) x2, round(greatest({','.join(_my)}),6) y2")
_sx = [f"(px{i}*9e-1+py{i}*1e-1+5)" for i in range(1, 5)]
_sy = [f"(px{i}*-1e-1+py{i}*1.1e0+-7)" for i in range(1, 5)]
_add("f29_apply_segments", lambda: [F.round(v, 4).alias(n) for v, n in zip(P.polygon_box(P.affine_points(_quad(), M)), ("x1", "y1", "x2", "y2"))],
     f"round(least({','.join(_sx)}),4) x1, round(least({','.join(_sy)}),4) y1, round(greatest({','.join(_sx)}),4) x2, round(greatest({','.join(_sy)}),4) y2", view=_obb_view, table="oc")


def _f30():
    p = F.element_at(P.affine_points(P.points([(F.col("x1"), F.col("y1"))]), M), 1)
    out = (p["x"] < 0) | (p["y"] < 0) | (p["x"] > 320) | (p["y"] > 300)
    return [F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), F.when(out, 0).otherwise(2).alias("visibility")]


_add("f30_apply_keypoints", _f30, f"round({_mx[0]},6) x, round({_my[0]},6) y, CASE WHEN {_mx[0]}<0 OR {_my[0]}<0 OR {_mx[0]}>320 OR {_my[0]}>300 THEN 0 ELSE 2 END visibility")


def _f31():
    got = B.letterbox(F.col("p_size") * 24.0 + 100, F.col("p_size") * 32.0 + 640)
    return [F.round(v, 9).alias(n) if n == "ratio" else v.cast("int").alias(n) for n, v in got.items()]


_lb = """SELECT p_partkey, round(r,9) ratio, CAST(uw AS INT) new_w, CAST(uh AS INT) new_h,
  CAST(round_even((640-uh)/2-1e-1,0) AS INT) pad_top, CAST(round_even((640-uh)/2+1e-1,0) AS INT) pad_bottom,
  CAST(round_even((640-uw)/2-1e-1,0) AS INT) pad_left, CAST(round_even((640-uw)/2+1e-1,0) AS INT) pad_right
FROM (SELECT *, round_even(w*r,0) uw, round_even(h*r,0) uh FROM (SELECT *, least(640/h, 640/w) r FROM
  (SELECT p_partkey, p_size*24e0+100 h, p_size*32e0+640 w FROM part)))"""
_add("f31_letterbox_params", _f31, None, frame=lambda s, d: read(s, d, "part"), keys=("p_partkey",))
ORACLES["f31_letterbox_params"] = _lb
_add("f32_enclosing_box", lambda: [F.round(v, 4).alias(n) for v, n in zip(O.enclosing(_obb()), ("x1", "y1", "x2", "y2"))],
     "round(least(px1,px2,px3,px4),4) x1, round(least(py1,py2,py3,py4),4) y1, round(greatest(px1,px2,px3,px4),4) x2, round(greatest(py1,py2,py3,py4),4) y2", view=_obb_view, table="oc")
_add("f33_obb_accessors", lambda: [F.round(v / m, 6).alias(f"p{a}{i + 1}n") for i, p in enumerate(O.corners(_obb())) for v, a, m in zip(p, "xy", (640.0, 600.0))],
     ", ".join(f"round(p{a}{i}/{m}e0,6) p{a}{i}n" for i in range(1, 5) for a, m in (("x", 640), ("y", 600))), view=_obb_view, table="oc")
_add("f34_pose_angle", lambda: [F.round(O.pose_angle((F.col("x1"), F.col("y1")), (F.col("x2"), F.lit(300.0)), (F.col("x1") + 50, F.col("y2"))), 5).alias("angle")],
     f"round(CASE WHEN a<=180 THEN a ELSE 360-a END,5) angle", view=f"{DETECTIONS}, pa AS (SELECT det_id, abs((atan2(y2-300e0,(x1+50)-x2)-atan2(y1-300e0,x1-x2))*180/{math.pi!r}) a FROM detections)", table="pa")
_add("f35_uncrop_boxes", lambda: B.shift(B.box(), 100.0, 50.0).named(), "x1+100 x1, y1+50 y1, x2+100 x2, y2+50 y2")
_crop, _img = (100, 50, 500, 450), (0, 0, 640, 600)
_add("f36_near_crop_edge", lambda: [B.near_crop_edge(B.box(), _crop, _img).alias("near")],
     "(" + " OR ".join(f"(abs({v}+{o}-{c})<=20 AND NOT abs({v}+{o}-{i})<=20)" for v, o, c, i in zip(("x1", "y1", "x2", "y2"), (100, 50, 100, 50), _crop, _img)) + ") near")
_add("f37_snap_to_border", lambda: B.snap_to_border(B.box(), 640, 600).named(),
     "CASE WHEN x1<20 THEN 0e0 ELSE x1 END x1, CASE WHEN y1<20 THEN 0e0 ELSE y1 END y1, CASE WHEN x2>620 THEN 640e0 ELSE x2 END x2, CASE WHEN y2>580 THEN 600e0 ELSE y2 END y2")

#: Category numbers (of 1 to 90) that the 80-class numbering leaves out (fixed values).
UNUSED_91 = [12, 26, 29, 30, 45, 66, 68, 69, 71, 83]


def coco91_to_80(c: "F.Column") -> "F.Column":
    """0-based class of 80 for a category of 1 to 91; null where there is none."""
    lower = F.aggregate(F.array(*map(F.lit, UNUSED_91)), F.lit(0), lambda a, u: a + F.when(u < c, 1).otherwise(0))
    return F.when(c.isin(UNUSED_91) | (c < 1) | (c > 90), None).otherwise(c - 1 - lower)


_add("f38_class_id_maps", lambda: [(F.col("image_id") % 91 + 1).alias("cat91"), coco91_to_80((F.col("image_id") % 91 + 1).cast("int")).cast("long").alias("cls80")],
     f"image_id%91+1 cat91, CASE WHEN image_id%91+1 IN ({','.join(map(str, UNUSED_91))}) OR image_id%91+1>90 THEN NULL ELSE image_id%91 - ({'+'.join(f'(CASE WHEN {u}<image_id%91+1 THEN 1 ELSE 0 END)' for u in UNUSED_91)}) END cls80")
_add("f39_label_remap", lambda: [F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {0: 255, 1: 0, 2: 1}.items() for x in kv]), F.col("cls")), F.col("cls")).alias("mapped")],
     "CASE cls WHEN 0 THEN 255 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE cls END mapped")
_add("f40_smooth_bce", lambda: [(F.lit(1.0) - F.col("conf") * 0.5).alias("pos"), (F.col("conf") * 0.5).alias("neg")], "1-conf*5e-1 pos, conf*5e-1 neg")
_add("f41_clean_url", lambda: [B.clean_url(F.col("url")).alias("clean")], "string_split(regexp_replace(replace(url, chr(92), '/'), '^file:/+', ''), '?')[1] clean",
     frame=lambda s, d: read(s, d, "pages"), keys=("page_id",), view="one AS (SELECT 1)", table="pages")
_add("f44_dist2bbox", lambda: [*B.dist2bbox(B.bbox2dist(B.box(), F.lit(320.0), F.lit(300.0)), F.lit(320.0), F.lit(300.0)).named(*C)],
     "((320-(320-x1))+(320+(x2-320)))/2 cx, ((300-(300-y1))+(300+(y2-300)))/2 cy, (320+(x2-320))-(320-(320-x1)) w, (300+(y2-300))-(300-(300-y1)) h")
_add("f45_dist2rbox", lambda: [F.round(v, 5).alias(n) for v, n in zip(O.dist2rbox(B.box(), F.col("conf"), F.lit(10.0), F.lit(20.0)), C)],
     "round((x2-x1)/2*cos(conf)-(y2-y1)/2*sin(conf)+10,5) cx, round((x2-x1)/2*sin(conf)+(y2-y1)/2*cos(conf)+20,5) cy, round(x1+x2,5) w, round(y1+y2,5) h")


def anchors(maps: DataFrame, offset: float = 0.5) -> DataFrame:
    """``maps`` without h and w, and (ax, ay): the cell centres of feature maps of ``h`` lines and ``w`` columns."""
    rows = maps.where("h > 0 and w > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return rows.withColumns({"ax": F.col("x") + offset, "ay": F.col("y") + offset}).drop("h", "w", "x", "y")


def _feature_maps(spark, d) -> DataFrame:
    """Maps of three strides of images of 32 to 96 pixels a side."""
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(k.alias("image_id"), (32 * (1 + k % 2)).alias("height"), (32 * (1 + k % 3)).alias("width"), F.explode(F.array(*(F.lit(s) for s in (8, 16, 32)))).alias("stride"))
    return rows.select("image_id", "stride", F.expr("cast(height div stride as int)").alias("h"), F.expr("cast(width div stride as int)").alias("w"))


QUERIES["f43_make_anchors"] = lambda spark, d: anchors(_feature_maps(spark, d)).select("image_id", "stride", F.col("ax").cast("double"), F.col("ay").cast("double"))
ORACLES["f43_make_anchors"] = """SELECT p_partkey image_id, CAST(s AS INT) stride, x+5e-1 ax, y+5e-1 ay FROM part, (VALUES (8),(16),(32)) t(s),
  (SELECT unnest(range(12)) x) a, (SELECT unnest(range(8)) y) b WHERE x < 32*(1+p_partkey%3)//s AND y < 32*(1+p_partkey%2)//s"""


def point_grid(rows: DataFrame, n: str) -> DataFrame:
    """``rows`` with (x, y): for each the middles of the ``n`` x ``n`` cells of the unit square, ``n`` a column."""
    grid = rows.where(F.col(n) > 0)
    for axis in ("x", "y"):
        grid = grid.withColumn(axis, F.explode(F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: (i * 2 + 1) / (2.0 * F.col(n)))))
    return grid


QUERIES["f46_point_grid"] = lambda spark, d: point_grid(read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (1 + F.col("p_partkey") % 5).cast("int").alias("n")), "n").withColumns(
    {c: F.round(c, 9) for c in ("x", "y")}
)
ORACLES["f46_point_grid"] = """SELECT image_id, CAST(n AS INT) n, round((x*2+1)/(2e0*n),9) x, round((y*2+1)/(2e0*n),9) y
  FROM (SELECT p_partkey image_id, 1+p_partkey%5 n FROM part), (SELECT unnest(range(5)) x) a, (SELECT unnest(range(5)) y) b WHERE x<n AND y<n"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the truth boxes of their image that they overlap."""
    d, g = detections(spark, sf_dir), ground_truth(spark, sf_dir).select("image_id", "gt_id", *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    return d.join(g, "image_id").where(B.overlap(B.box(), B.box("g")))


PAIRS = f"""{DETECTIONS}, {GT}, pr AS (SELECT d.*, g.gt_id, g.x1 gx1, g.y1 gy1, g.x2 gx2, g.y2 gy2,
  least(d.x2,g.x2)-greatest(d.x1,g.x1) iw, least(d.y2,g.y2)-greatest(d.y1,g.y1) ih FROM detections d JOIN gt g ON d.image_id=g.image_id
  WHERE d.x1<g.x2 AND g.x1<d.x2 AND d.y1<g.y2 AND g.y1<d.y2)"""
_key = ("det_id", "gt_id")
_U = "((x2-x1)*(y2-y1)+(gx2-gx1)*(gy2-gy1)-iw*ih)"
_add("j1_pairwise_iou", lambda: [F.round(B.iou(B.box(), B.box("g")), 9).alias("iou")], f"round(iw*ih/({_U}+1e-7),9) iou", _pairs, _key, PAIRS, "pr")
_add("j2_pairwise_ioa", lambda: [F.round(B.ioa(B.box(), B.box("g")), 9).alias("ioa")], "round(iw*ih/((gx2-gx1)*(gy2-gy1)+1e-7),9) ioa", _pairs, _key, PAIRS, "pr")
_V = f"""{PAIRS}, va AS (SELECT det_id, gt_id, iw*ih/u iou, u, greatest(x2,gx2)-least(x1,gx1) cw, greatest(y2,gy2)-least(y1,gy1) ch,
  gx1+gx2-x1-x2 dx, gy1+gy2-y1-y2 dy, atan(w2/h2)-atan(w1/h1) tu FROM (SELECT *, w1*h1+w2*h2-iw*ih+1e-7 u FROM
  (SELECT *, x2-x1 w1, y2-y1+1e-7 h1, gx2-gx1 w2, gy2-gy1+1e-7 h2 FROM pr))),
  vb AS (SELECT *, (dx*dx+dy*dy)/4/(cw*cw+ch*ch+1e-7) ap, tu*tu*{4 / math.pi**2!r} v FROM va)"""
_add("j3_iou_variants", lambda: [F.round(B.iou_variant(B.box(), B.box("g"), k), 7).alias(k) for k in ("iou", "giou", "diou", "ciou")],
     "round(iou,7) iou, round(iou-(cw*ch+1e-7-u)/(cw*ch+1e-7),7) giou, round(iou-ap,7) diou, round(iou-(ap+v*(v/(v-iou+1.0000001e0))),7) ciou", _pairs, _key, _V, "vb")


def _probiou_sql() -> str:
    """Text of the oriented similarity of boxes (ox, oy, ow, oh, r) and (qx, qy, qw, qh, qr)."""
    return """(1e0-sqrt(1e0-exp(-least(greatest(
  ((a1+a2)*dy*dy+(b1+b2)*dx*dx)/(det+1e-7)*25e-2 + (c1+c2)*(-dx)*dy/(det+1e-7)*5e-1
  + ln(det/(sqrt(greatest(a1*b1-c1*c1,0e0)*greatest(a2*b2-c2*c2,0e0))*4+1e-7)+1e-7)*5e-1, 1e-7),100e0))+1e-7))"""


PROB = f"""{PAIRS}, pq AS (SELECT *, (a1+a2)*(b1+b2)-(c1+c2)*(c1+c2) det FROM (SELECT *,
  w1*w1/12*cos(r)*cos(r)+h1*h1/12*sin(r)*sin(r) a1, w1*w1/12*sin(r)*sin(r)+h1*h1/12*cos(r)*cos(r) b1, (w1*w1/12-h1*h1/12)*cos(r)*sin(r) c1,
  w2*w2/12*cos(q)*cos(q)+h2*h2/12*sin(q)*sin(q) a2, w2*w2/12*sin(q)*sin(q)+h2*h2/12*cos(q)*cos(q) b2, (w2*w2/12-h2*h2/12)*cos(q)*sin(q) c2,
  (x1+x2)/2-(gx1+gx2)/2 dx, (y1+y2)/2-(gy1+gy2)/2 dy
  FROM (SELECT *, x2-x1 w1, y2-y1 h1, gx2-gx1 w2, gy2-gy1 h2, conf*3-5e-1 r, 1e-1 q FROM pr)))"""


def _gt_obb() -> O.Obb:
    c = B.xyxy2xywh(B.box("g"))
    return O.Obb(c.a, c.b, c.c, c.d, F.lit(0.1))


_add("j6_probiou", lambda: [F.round(O.probiou(_obb(), _gt_obb()), 6).alias("probiou")], f"round({_probiou_sql()},6) probiou", _pairs, _key, PROB, "pq")


def _j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _pairs(spark, sf_dir).withColumn("probiou", O.probiou(_obb(), _gt_obb())).where("probiou >= 5e-1")
    return near.groupBy("gt_id").agg(F.count("*").alias("n"), F.round(F.max("probiou"), 6).alias("best"))


QUERIES["j7_pairwise_probiou"] = _j7
ORACLES["j7_pairwise_probiou"] = ctes(PROB, f"SELECT gt_id, count(*) n, round(max(p),6) best FROM (SELECT gt_id, {_probiou_sql()} p FROM pq) WHERE p>=5e-1 GROUP BY gt_id")


def _j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of truth and detection as keypoints; the third is invisible on odd truths."""
    vis = F.when(F.col("gt_id") % 2 == 1, 0.0).otherwise(2.0)
    kp = lambda b, v: F.array(*(F.struct(x.alias("x"), y.alias("y"), w.alias("v")) for x, y, w in ((b.a, b.b, F.lit(2.0)), (b.c, b.b, F.lit(2.0)), (b.c, b.d, v), (b.a, b.d, F.lit(1.0)))))
    rows = _pairs(spark, sf_dir)
    size = B.area(B.box("g")) * 0.53
    return rows.select("det_id", "gt_id", F.round(O.oks(kp(B.box("g"), vis), kp(B.box(), F.lit(2.0)), size, [0.05, 0.06, 0.07, 0.08]), 7).alias("oks"))


def _oks_term(dx: str, dy: str, s: float) -> str:
    return f"exp(-(({dx})*({dx})+({dy})*({dy}))/({(2 * s) ** 2!r}::DOUBLE*(ar+1e-7)*2))"


QUERIES["j5_oks"] = _j5
ORACLES["j5_oks"] = ctes(PAIRS, f"""SELECT det_id, gt_id, round(({_oks_term('gx1-x1', 'gy1-y1', 0.05)}+{_oks_term('gx2-x2', 'gy1-y1', 0.06)}
  +CASE WHEN gt_id%2=1 THEN 0 ELSE {_oks_term('gx2-x2', 'gy2-y2', 0.07)} END+{_oks_term('gx1-x1', 'gy2-y2', 0.08)})/((CASE WHEN gt_id%2=1 THEN 3 ELSE 4 END)+1e-7),7) oks
  FROM (SELECT *, (gx2-gx1)*(gy2-gy1)*53e-2 ar FROM pr)""")  # fmt: skip

# Predicates on boxes
_add("p4_box_candidates", lambda: [B.candidates(B.box(), B.affine_box(B.box(), [[0.3, 0, 0], [0, 0.35, 0]])).alias("ok")],
     "(w2>2 AND h2>2 AND w2*h2/((x2-x1)*(y2-y1)+1e-16)>1e-1 AND greatest(w2/(h2+1e-16),h2/(w2+1e-16))<100) ok",
     view=f"{DETECTIONS}, cand AS (SELECT *, x2*3e-1-x1*3e-1 w2, y2*35e-2-y1*35e-2 h2 FROM detections)", table="cand")
QUERIES["p5_zero_area_removal"] = lambda s, d: detections(s, d).select("det_id", *B.clip(B.box(), 200, 220).named()).where(B.area(B.box()) > 0)
ORACLES["p5_zero_area_removal"] = ctes(DETECTIONS, "SELECT * FROM (SELECT det_id, least(x1,200e0) x1, least(y1,220e0) y1, least(x2,200e0) x2, least(y2,220e0) y2 FROM detections) WHERE (x2-x1)*(y2-y1)>0")
