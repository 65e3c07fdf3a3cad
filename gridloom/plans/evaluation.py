"""Queries of suppression, matching and metrics over the derived detections and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import oriented as O
from gridloom.operators import match, metrics, search, suppress
from gridloom.plans.views import DETECTIONS, GT, ctes, detections, ground_truth, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


BOX = ["det_id", "image_id", "cls", "conf", "x1", "y1", "x2", "y2"]
_inter = "greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0e0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0e0)"
_area = lambda p: f"({p}.x2-{p}.x1)*({p}.y2-{p}.y1)"
_touch = "b.x1<a.x2 AND a.x1<b.x2 AND b.y1<a.y2 AND a.y1<b.y2"
_iou = f"{_inter}/({_area('a')}+{_area('b')}-{_inter}+1e-7)"


@query("p1_confidence_filter", ctes(DETECTIONS, "SELECT det_id, conf FROM detections WHERE conf > 25e-2"))
def p1(spark: SparkSession, d: str) -> DataFrame:
    return detections(spark, d).where("conf > 25e-2").select("det_id", "conf")


@query("p2_class_filter", ctes(DETECTIONS, "SELECT det_id, cls FROM detections WHERE cls IN (0, 3)"))
def p2(spark, d):
    return suppress.filter_classes(detections(spark, d), [0, 3]).select("det_id", "cls")


@query("p3_single_class", ctes(DETECTIONS, "SELECT det_id, CAST(0 AS INT) cls FROM detections WHERE cls IN (1, 2)"))
def p3(spark, d):
    return suppress.filter_classes(detections(spark, d), [1, 2]).select("det_id", F.lit(0).alias("cls"))


@query("t2_top_k_per_image", ctes(DETECTIONS, "SELECT det_id, image_id, conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) rk FROM detections) WHERE rk<=5"))
def t2(spark, d):
    return suppress.top_k(detections(spark, d), ["image_id"], 5).select("det_id", "image_id", "conf")


_R = "rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) rk FROM detections WHERE conf>25e-2)"
_FAST = f"SELECT a.det_id, a.image_id, a.cls, a.conf FROM rk a WHERE NOT EXISTS (SELECT 1 FROM rk b WHERE b.image_id=a.image_id AND b.cls=a.cls AND b.rk<a.rk AND {_touch} AND {_iou}>=45e-2)"


@query("n3_fast_nms", ctes(DETECTIONS, _R, _FAST))
def n3(spark, d):
    return suppress.fast_nms(detections(spark, d).where("conf > 25e-2"), 0.45).select("det_id", "image_id", "cls", "conf")


@query("n4_batched_nms", ctes(DETECTIONS, _R, f"SELECT image_id, cls, count(*) n, round(sum(conf),6) s FROM ({_FAST}) GROUP BY ALL"))
def n4(spark, d):
    kept = suppress.fast_nms(detections(spark, d).where("conf > 25e-2"), 0.45, ["image_id", "cls"])
    return kept.groupBy("image_id", "cls").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 6).alias("s"))


_GREEDY = """g0 AS (SELECT image_id, cls, list({'neg': -conf, 'det_id': det_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} ORDER BY conf DESC, det_id) items
  FROM detections WHERE conf>25e-2 GROUP BY image_id, cls),
g1 AS (SELECT image_id, cls, list_reduce(list_transform(items, lambda x: [x]), lambda acc, z: CASE WHEN len(list_filter(acc, lambda k:
    least(k.x2,z[1].x2)>greatest(k.x1,z[1].x1) AND least(k.y2,z[1].y2)>greatest(k.y1,z[1].y1) AND
    (least(k.x2,z[1].x2)-greatest(k.x1,z[1].x1))*(least(k.y2,z[1].y2)-greatest(k.y1,z[1].y1))
    /((k.x2-k.x1)*(k.y2-k.y1)+(z[1].x2-z[1].x1)*(z[1].y2-z[1].y1)-(least(k.x2,z[1].x2)-greatest(k.x1,z[1].x1))*(least(k.y2,z[1].y2)-greatest(k.y1,z[1].y1)))>45e-2))>0
    THEN acc ELSE list_concat(acc, z) END) kept FROM g0),
nms AS (SELECT image_id, cls, b.det_id det_id, -b.neg conf, b.x1 x1, b.y1 y1, b.x2 x2, b.y2 y2 FROM (SELECT image_id, cls, unnest(kept) b FROM g1))"""


@query("n2_greedy_nms", ctes(DETECTIONS, _GREEDY, "SELECT det_id, image_id, cls, conf FROM nms"))
def n2(spark, d):
    return suppress.greedy_nms(detections(spark, d).where("conf > 25e-2"), 0.45).select("det_id", "image_id", "cls", "conf")


@query("n1_full_nms", ctes(DETECTIONS, _GREEDY, "SELECT det_id, image_id, cls, conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) rk FROM nms) WHERE rk<=10"))
def n1(spark, d):
    return suppress.non_max_suppression(detections(spark, d), 0.25, 0.45, max_det=10).select("det_id", "image_id", "cls", "conf")


_PROBS = "list_transform([0,1,2,3,4], lambda k: CASE WHEN k=cls THEN conf ELSE conf*((k*37+det_id%11)%10)/20 END)"


def _scored(spark, d) -> DataFrame:
    """Detections with scores of five classes: the own one is the largest."""
    s = F.transform(F.array(*map(F.lit, range(5))), lambda k: F.when(k == F.col("cls"), F.col("conf")).otherwise(F.col("conf") * ((k * 37 + F.col("det_id") % 11) % 10) / 20))
    return detections(spark, d).select("det_id", "image_id", s.alias("scores"))


@query("n1_multi_label", ctes(DETECTIONS, f"pr AS (SELECT det_id, {_PROBS} s FROM detections)", "SELECT det_id, CAST(k AS INT) cls, s[k+1] conf FROM pr, (SELECT unnest(range(5)) k) WHERE s[k+1]>25e-2"))
def n1m(spark, d):
    return suppress.best_class(_scored(spark, d), "scores", 0.25, multi_label=True).select("det_id", "cls", "conf")


@query("t3_top5_classes", ctes(DETECTIONS, f"pr AS (SELECT det_id, {_PROBS} s FROM detections)", "SELECT det_id, k AS cls, round(s[k+1],9) p FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY s[k+1] DESC, k) rk FROM pr, (SELECT CAST(unnest(range(5)) AS INT) k)) WHERE rk<=2"))
def t3(spark, d):
    order = F.array_sort(F.transform("scores", lambda x, i: F.struct((-x).alias("neg"), i.alias("cls"))))
    rows = _scored(spark, d).select("det_id", F.explode(F.slice(order, 1, 2)).alias("t"))
    return rows.select("det_id", "t.cls", F.round(-F.col("t.neg"), 9).alias("p"))


@query("n6_end_to_end", ctes(DETECTIONS, "SELECT det_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id) rk FROM detections WHERE conf>25e-2 AND cls IN (0,1)) WHERE rk<=3"))
def n6(spark, d):
    return suppress.end_to_end(detections(spark, d), 0.25, [0, 1], 3).select("det_id", "image_id")


_LABELLED = DETECTIONS.replace("detections AS (", "dets AS (", 1) + ", " + GT + ", detections AS (SELECT det_id, image_id, cls, conf, x1, y1, x2, y2 FROM dets WHERE conf>25e-2 UNION ALL SELECT -gt_id, image_id, cls, 1e0, x1, y1, x2, y2 FROM gt)"


@query("n7_prior_labels", ctes(_LABELLED, _GREEDY, "SELECT det_id, image_id, cls, conf FROM nms"))
def n7(spark, d):
    labels = ground_truth(spark, d).withColumn("det_id", -F.col("gt_id"))
    return suppress.non_max_suppression(detections(spark, d), 0.25, 0.45, labels=labels).select("det_id", "image_id", "cls", "conf")


@query("n8_tile_merge", ctes(DETECTIONS, """t AS (SELECT det_id, cls, conf, 'P' || (image_id//4) AS image_id, x1+(image_id%2)*500 x1, y1+((image_id//2)%2)*400 y1, x2+(image_id%2)*500 x2, y2+((image_id//2)%2)*400 y2 FROM detections WHERE conf>5e-1)""",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) rk FROM t)", _FAST.replace("45e-2", "3e-1")))
def n8(spark, d):
    i = F.col("image_id")
    tile = F.concat(F.lit("P"), F.floor(i / 4).cast("string"), F.lit("__640__"), (i % 2 * 500).cast("string"), F.lit("___"), (F.floor(i / 2) % 2 * 400).cast("string"))
    rows = detections(spark, d).where("conf > 5e-1").withColumn("tile", tile)
    return suppress.merge_tiles(rows).select("det_id", "cls", "conf", "image_id")


_ROTATED = """rb AS (SELECT *, (x1+x2)/2 ox, (y1+y2)/2 oy, x2-x1 w, y2-y1 h, conf*3-5e-1 r, row_number() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det_id) rk FROM detections WHERE conf>25e-2),
  rc AS (SELECT *, w*w/12*cos(r)*cos(r)+h*h/12*sin(r)*sin(r) a, w*w/12*sin(r)*sin(r)+h*h/12*cos(r)*cos(r) b, (w*w/12-h*h/12)*cos(r)*sin(r) c FROM rb),
  rp AS (SELECT p.det_id, p.a+q.a a, p.b+q.b b, p.c+q.c c, p.ox-q.ox dx, p.oy-q.oy dy, greatest(p.a*p.b-p.c*p.c,0e0)*greatest(q.a*q.b-q.c*q.c,0e0) own
    FROM rc p JOIN rc q ON p.image_id=q.image_id AND p.cls=q.cls AND q.rk<p.rk)"""
_UNTURNED = """SELECT det_id, image_id, cls, conf FROM rb WHERE det_id NOT IN (SELECT det_id FROM (SELECT det_id, (a*dy*dy+b*dx*dx)/(a*b-c*c+1e-7)*25e-2+c*(-dx)*dy/(a*b-c*c+1e-7)*5e-1
  +ln((a*b-c*c)/(sqrt(own)*4+1e-7)+1e-7)*5e-1 bd FROM rp) WHERE 1e0-sqrt(1e0-exp(-least(greatest(bd,1e-7),1e2))+1e-7)>=45e-2)"""


@query("n5_rotated_nms", ctes(DETECTIONS, _ROTATED, _UNTURNED))
def n5(spark, d):
    """Fast suppression by the oriented similarity; boxes whose enclosing circles are apart (0.3 at most) are not compared."""
    rows = detections(spark, d).where("conf > 25e-2")
    obb = lambda p: O.Obb((F.col(f"{p}x1") + F.col(f"{p}x2")) / 2, (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2, F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1"), F.col(f"{p}conf") * 3 - 0.5)
    reach = lambda o: F.sqrt(o.w * o.w + o.h * o.h) / 2
    near = lambda a, b: (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= (reach(a) + reach(b)) * (reach(a) + reach(b))
    kept = suppress.fast_nms(rows, 0.45, similarity=lambda p, q: O.probiou(obb(p), obb(q)), near=lambda p, q: near(obb(p), obb(q)))
    return kept.select("det_id", "image_id", "cls", "conf")


_named = lambda name, iou: _GREEDY.replace("g0 ", f"g0{name} ").replace("FROM g0)", f"FROM g0{name})").replace("g1 AS", f"g1{name} AS").replace("FROM g1)", f"FROM g1{name})").replace("nms AS", f"{name} AS").replace("45e-2", iou)
_top = lambda name: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) rk FROM {name}) WHERE rk<=300)"


@query("m11_deleted_box_recovery", ctes(DETECTIONS, _named("strict", "1e-1"), _named("loose", "7e-1"),
    f"SELECT det_id, image_id, cls, conf FROM {_top('loose')} a WHERE NOT EXISTS (SELECT 1 FROM {_top('strict')} b WHERE a.image_id=b.image_id AND {_touch} AND {_iou}>=6e-1)"))
def m11(spark, d):
    return suppress.recovered(detections(spark, d), 0.25, 0.1, 0.7, 0.6).select("det_id", "image_id", "cls", "conf")


@query("n9_track_aware_nms", ctes(DETECTIONS.replace("detections AS (", "dets AS (", 1), GT,
    f"detections AS (SELECT * FROM dets a WHERE conf>25e-2 AND NOT EXISTS (SELECT 1 FROM gt b WHERE gt_id%5=0 AND a.image_id=b.image_id AND {_touch} AND {_iou}>4e-1))",
    _GREEDY, "SELECT det_id, image_id, cls, conf FROM nms"))
def n9(spark, d):
    """Candidates that overlap a track (here: a truth box) go; the rest are suppressed greedily."""
    t = ground_truth(spark, d).where("gt_id % 5 = 0").select(F.col("image_id").alias("o_image_id"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    hit = (F.col("image_id") == F.col("o_image_id")) & B.overlap(B.box(), B.box("o_")) & (B.iou(B.box(), B.box("o_")) > 0.4)
    free = detections(spark, d).where("conf > 25e-2").join(t, hit, "left_anti")
    return suppress.greedy_nms(free, 0.45).select("det_id", "image_id", "cls", "conf")


# --- matching -------------------------------------------------------------------------------------------------

_PAIR = lambda where, op: f"""pr AS (SELECT d.det_id, d.image_id, d.cls, d.conf, g.gt_id, g.cls gt_cls, i/(ad+ag-i+1e-7) iou FROM
  (SELECT d.det_id, d.image_id, d.cls, d.conf, g.gt_id, g.cls gcls, (d.x2-d.x1)*(d.y2-d.y1) ad, (g.x2-g.x1)*(g.y2-g.y1) ag,
   greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0e0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0e0) i
   FROM detections d JOIN gt g ON d.image_id=g.image_id WHERE {where}) d JOIN gt g ON g.gt_id=d.gt_id WHERE i/(ad+ag-i+1e-7){op})"""  # noqa: E731
_MATCH = f"""{DETECTIONS}, {GT}, {_PAIR('d.cls=g.cls', '>=5e-1')},
  th AS (SELECT (50+5*k)/100e0 thr FROM (SELECT unnest(range(10)) k)),
  m1 AS (SELECT * FROM (SELECT pr.*, thr, row_number() OVER (PARTITION BY thr, det_id ORDER BY iou DESC, gt_id) rk FROM pr JOIN th ON iou>=thr) WHERE rk=1),
  mt AS (SELECT det_id, thr, gt_id FROM (SELECT *, row_number() OVER (PARTITION BY thr, gt_id ORDER BY conf DESC, det_id) r2 FROM m1) WHERE r2=1)"""


@query("j10_match_evaluation", ctes(_MATCH, "SELECT * FROM mt"))
def j10(spark, d):
    return match.match_evaluation(detections(spark, d), ground_truth(spark, d))


_CONF = f"""{DETECTIONS}, {GT}, {_PAIR('d.conf>25e-2', '>45e-2')},
  m1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) rk FROM pr) WHERE rk=1),
  mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY iou DESC, det_id) r2 FROM m1) WHERE r2=1),
  cells AS (SELECT pred, truth, count(*) n FROM (SELECT cls pred, gt_cls truth FROM mt UNION ALL SELECT 5, cls FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM mt)
    UNION ALL SELECT cls, 5 FROM detections WHERE conf>25e-2 AND det_id NOT IN (SELECT det_id FROM mt)) GROUP BY ALL)"""


@query("j11_match_confusion", ctes(_CONF, "SELECT det_id, gt_id, cls, gt_cls, round(iou,9) iou FROM mt"))
def j11(spark, d):
    return match.match_confusion(detections(spark, d), ground_truth(spark, d)).select("det_id", "gt_id", "cls", "gt_cls", F.round("iou", 9).alias("iou"))


@query("a10_confusion_matrix", ctes(_CONF, "SELECT * FROM cells"))
def a10(spark, d):
    return match.confusion_matrix(detections(spark, d), ground_truth(spark, d), 5)


@query("a12_normalized_matrix", ctes(_CONF, "SELECT truth, " + ", ".join(f"round(coalesce(max(CASE WHEN pred={k} THEN s END),0),5) p{k}" for k in range(6)) + " FROM (SELECT *, n/(sum(n) OVER (PARTITION BY truth)+1e-9) s FROM cells) GROUP BY truth"))
def a12(spark, d):
    cells = metrics.normalized(match.confusion_matrix(detections(spark, d), ground_truth(spark, d), 5))
    wide = cells.groupBy("truth").pivot("pred", list(range(6))).agg(F.max("share"))
    return wide.select("truth", *[F.round(F.coalesce(F.col(str(k)), F.lit(0.0)), 5).alias(f"p{k}") for k in range(6)])


@query("a13_tp_fp", ctes(_CONF, "SELECT pred cls, sum(CASE WHEN pred=truth THEN n ELSE 0 END)::BIGINT tp, (sum(n)-sum(CASE WHEN pred=truth THEN n ELSE 0 END))::BIGINT fp FROM cells WHERE pred<5 GROUP BY pred"))
def a13(spark, d):
    return metrics.confusion_scores(match.confusion_matrix(detections(spark, d), ground_truth(spark, d), 5), 5)


# --- metrics --------------------------------------------------------------------------------------------------

_TP = f"""{_MATCH}, tpv AS (SELECT d.det_id, d.image_id, d.cls, d.conf, th.thr, mt.gt_id IS NOT NULL tp FROM detections d CROSS JOIN th LEFT JOIN mt ON mt.det_id=d.det_id AND mt.thr=th.thr),
  ng AS (SELECT cls, count(*) n_truth FROM gt GROUP BY cls),
  cv AS (SELECT c.*, ctp/(n_truth+1e-16) recall, ctp::DOUBLE/n AS prec FROM (SELECT *, sum(tp::INT) OVER w ctp, count(*) OVER w n FROM tpv
    WINDOW w AS (PARTITION BY cls, thr ORDER BY conf DESC, det_id ROWS UNBOUNDED PRECEDING)) c JOIN ng USING (cls))"""


@query("w1_cumulative_tp_fp", ctes(_TP, "SELECT det_id, cls, ctp::BIGINT ctp, (n-ctp)::BIGINT cfp, round(recall,9) recall, round(prec,9) \"precision\" FROM cv WHERE thr=5e-1"))
def w1(spark, d):
    tp = match.true_positives(detections(spark, d), ground_truth(spark, d), [0.5])
    return metrics.cumulative(tp, ground_truth(spark, d)).select(
        "det_id", "cls", F.col("ctp").cast("long"), (F.col("n") - F.col("ctp")).alias("cfp"), F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision")
    )


@query("a2_precision_envelope", ctes(_TP, "SELECT det_id, cls, round(max(prec) OVER (PARTITION BY cls ORDER BY conf DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),9) envelope FROM cv WHERE thr=5e-1"))
def a2(spark, d):
    tp = match.true_positives(detections(spark, d), ground_truth(spark, d), [0.5])
    return metrics.envelope(metrics.cumulative(tp, ground_truth(spark, d))).select("det_id", "cls", F.round("envelope", 9).alias("envelope"))


_AP = f"""{_TP},
  kn AS (SELECT cls, thr, recall, conf, det_id, prec FROM cv UNION ALL SELECT DISTINCT cls, thr, 0e0, 9e0, 0, 1e0 FROM cv
    UNION ALL SELECT cls, thr, max(recall), -1e0, 0, 0e0 FROM cv GROUP BY cls, thr UNION ALL SELECT DISTINCT cls, thr, 1e0, -2e0, 0, 0e0 FROM cv),
  en AS (SELECT cls, thr, recall, max(prec) OVER (PARTITION BY cls, thr ORDER BY conf DESC, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) e FROM kn),
  kt AS (SELECT cls, thr, recall, max(e) hi, min(e) lo FROM en GROUP BY ALL),
  sg AS (SELECT *, lead(recall) OVER w r1, lead(hi) OVER w p1 FROM kt WINDOW w AS (PARTITION BY cls, thr ORDER BY recall)),
  gd AS (SELECT k FROM (SELECT unnest(range(101)) k)),
  pt AS (SELECT cls, thr, k, CASE WHEN r1 IS NULL THEN lo ELSE lo+(p1-lo)*(k/100e0-recall)/(r1-recall) END y FROM sg JOIN gd
    ON k>=ceil(round(recall*100,9)) AND k<=CASE WHEN r1 IS NULL THEN 100 ELSE ceil(round(r1*100,9))-1 END),
  apv AS (SELECT cls, thr, sum(y*CASE WHEN k IN (0,100) THEN 5e-1 ELSE 1 END)/100 ap FROM pt GROUP BY cls, thr),
  apc AS (SELECT g.cls, th.thr, coalesce(ap,0) ap FROM (SELECT DISTINCT cls FROM gt) g CROSS JOIN th LEFT JOIN apv ON apv.cls=g.cls AND apv.thr=th.thr)"""


def _tp(spark, d, thresholds=match.THRESHOLDS) -> DataFrame:
    return match.true_positives(detections(spark, d), ground_truth(spark, d), thresholds)


def _class_ap(spark, d, thresholds=match.THRESHOLDS) -> DataFrame:
    dets, gt = detections(spark, d), ground_truth(spark, d)
    return metrics.class_ap(dets, match.matched_thresholds(dets, gt, thresholds), gt, thresholds)


@query("a1_average_precision", ctes(_AP, "SELECT cls, thr, round(ap,6) ap FROM apc"))
def a1(spark, d):
    return _class_ap(spark, d).select("cls", "thr", F.round("ap", 6).alias("ap"))


@query("a3_interpolated_ap50", ctes(_AP, "SELECT cls, round(ap,6) ap50 FROM apc WHERE thr=5e-1"))
def a3(spark, d):
    return _class_ap(spark, d, [0.5]).select("cls", F.round("ap", 6).alias("ap50"))


_MEANS = "SELECT round(avg(ap) FILTER (thr=5e-1),6) map50, round(avg(ap) FILTER (abs(thr-75e-2)<1e-9),6) map75, round(avg(ap),6) map FROM apc"


@query("a4_metric_means", ctes(_AP, _MEANS))
def a4(spark, d):
    return metrics.metric_means(_class_ap(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("map50", "map75", "map")])


@query("a5_class_map_vector", ctes(_AP, "SELECT CAST(k AS INT) cls, round(coalesce(m,(SELECT avg(ap) FROM apc)),6) map FROM (SELECT unnest(range(7)) k) LEFT JOIN (SELECT cls, avg(ap) m FROM apc GROUP BY cls) ON cls=k"))
def a5(spark, d):
    ap = _class_ap(spark, d)
    per = ap.groupBy("cls").agg(F.avg("ap").alias("m")).select("cls", "m", F.avg("m").over(Window.partitionBy()).alias("all"))
    grid = spark.range(7).select(F.col("id").cast("int").alias("cls"))
    every = F.max("all").over(Window.partitionBy())
    return grid.join(per, "cls", "left").select("cls", F.round(F.coalesce("m", every), 6).alias("map"))


@query("a6_fitness", ctes(_AP, "SELECT round(avg(ap),6) fitness FROM apc"))
def a6(spark, d):
    m = metrics.metric_means(_class_ap(spark, d))
    return m.select(F.round(metrics.fitness(F.col("map"), F.col("map50"), F.lit(0.0), F.lit(0.0)), 6).alias("fitness"))


@query("a7_per_image_metrics", ctes(_TP, """SELECT image_id, tp, n-tp fp, t-tp fn, round(p,9) "precision", round(r,9) recall, round(CASE WHEN p+r>0 THEN 2*p*r/(p+r) ELSE 0 END,9) f1 FROM (
  SELECT *, CASE WHEN n>0 THEN tp::DOUBLE/n WHEN t=0 THEN 1 ELSE 0 END p, CASE WHEN t>0 THEN tp::DOUBLE/t WHEN n=0 THEN 1 ELSE 0 END r FROM (
  SELECT coalesce(a.image_id,b.image_id) image_id, coalesce(tp,0) tp, coalesce(n,0) n, coalesce(t,0) t FROM (SELECT image_id, count(*) n, (count(*) FILTER (tp)) tp FROM tpv WHERE thr=5e-1 GROUP BY 1) a
  FULL JOIN (SELECT image_id, count(*) t FROM gt GROUP BY 1) b ON a.image_id=b.image_id))"""))  # fmt: skip
def a7(spark, d):
    rows = metrics.per_image(_tp(spark, d, [0.5]), ground_truth(spark, d))
    return rows.select("image_id", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("a9_class_instances", ctes(GT, "SELECT cls, count(*) instances, count(DISTINCT image_id) images FROM gt GROUP BY cls"))
def a9(spark, d):
    return ground_truth(spark, d).groupBy("cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))


_CURVE = f"""{_AP}, c5 AS (SELECT cls, conf, n, recall r, prec p FROM cv WHERE thr=5e-1),
  hn AS (SELECT g.cls, k, x, count(c.n) hn FROM (SELECT cls, k, k/999e0 x FROM (SELECT DISTINCT cls FROM c5), (SELECT unnest(range(1000)) k)) g LEFT JOIN c5 c ON c.cls=g.cls AND c.conf>=x GROUP BY ALL),
  rp AS (SELECT h.cls, k, CASE WHEN hn=0 THEN 0 WHEN b.n IS NULL OR a.conf=x THEN a.r ELSE a.r+(b.r-a.r)*(a.conf-x)/(a.conf-b.conf) END recall,
    CASE WHEN hn=0 THEN 1 WHEN b.n IS NULL OR a.conf=x THEN a.p ELSE a.p+(b.p-a.p)*(a.conf-x)/(a.conf-b.conf) END "precision"
    FROM hn h LEFT JOIN c5 a ON a.cls=h.cls AND a.n=hn LEFT JOIN c5 b ON b.cls=h.cls AND b.n=hn+1),
  crv AS (SELECT *, "precision"*2*recall/("precision"+recall+1e-16) f1 FROM rp),
  sm AS (SELECT k, (sum(f1) OVER (ORDER BY k ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)+greatest(50-k,0)*first(f1) OVER o+greatest(k-949,0)*last(f1) OVER o)/101 smoothed
    FROM (SELECT k, avg(f1) f1 FROM crv GROUP BY k) WINDOW o AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_rounded = lambda digits, *names: ", ".join(f'round("{n}",{digits}) "{n}"' for n in names)


@query("e7_curves", ctes(_CURVE, f"SELECT cls, k, {_rounded(6, 'recall', 'precision', 'f1')} FROM crv"))
def e7(spark, d):
    c = metrics.curves(_tp(spark, d, [0.5]), ground_truth(spark, d))
    return c.select("cls", "k", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "f1")])


@query("e8_mean_curves", ctes(_CURVE, f"SELECT k, {_rounded(6, 'recall', 'precision', 'f1')} FROM (SELECT k, avg(recall) recall, avg(\"precision\") \"precision\", avg(f1) f1 FROM crv GROUP BY k)"))
def e8(spark, d):
    c = metrics.curves(_tp(spark, d, [0.5]), ground_truth(spark, d))
    return c.groupBy("k").agg(*[F.round(F.avg(x), 6).alias(x) for x in ("recall", "precision", "f1")])


@query("w3_smoothed_f1", ctes(_CURVE, "SELECT k, round(smoothed,6) smoothed FROM sm"))
def w3(spark, d):
    mean = metrics.curves(_tp(spark, d, [0.5]), ground_truth(spark, d)).groupBy("k").agg(F.avg("f1").alias("f1"))
    return metrics.smooth(mean, "f1").select("k", F.round("smoothed", 6).alias("smoothed"))


_POINT = f"{_CURVE}, pt1 AS (SELECT * FROM crv WHERE k=(SELECT k FROM sm ORDER BY smoothed DESC, k LIMIT 1))"


@query("a4_mean_precision_recall", ctes(_POINT, 'SELECT round(avg("precision"),6) mp, round(avg(recall),6) mr FROM pt1'))
def a4_means(spark, d):
    """Mean precision and recall of the classes at the confidence of the best smoothed mean F1."""
    point = metrics.best_operating_point(metrics.curves(_tp(spark, d, [0.5]), ground_truth(spark, d)))
    return point.agg(F.round(F.avg("precision"), 6).alias("mp"), F.round(F.avg("recall"), 6).alias("mr"))


@query("a19_metrics_summary", ctes(_POINT, f"""SELECT cls, images, instances, {_rounded(5, 'precision', 'recall', 'f1', 'map50', 'map')}
  FROM (SELECT cls, count(*) instances, count(DISTINCT image_id) images FROM gt GROUP BY cls) JOIN (SELECT cls, avg(ap) FILTER (thr=5e-1) map50, avg(ap) map FROM apc GROUP BY cls) USING (cls) LEFT JOIN pt1 USING (cls)"""))
def a19(spark, d):
    """Class, images, instances, P, R, F1 at the best global confidence, mAP50 and mAP50-95."""
    gt = ground_truth(spark, d)
    point = metrics.best_operating_point(metrics.curves(_tp(spark, d, [0.5]), gt))
    ap = _class_ap(spark, d).groupBy("cls").agg(F.avg(F.when(F.abs(F.col("thr") - 0.5) < 1e-9, F.col("ap"))).alias("map50"), F.avg("ap").alias("map"))
    per = gt.groupBy("cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))
    return per.join(ap, "cls").join(point, "cls", "left").select("cls", "images", "instances", *[F.round(c, 5).alias(c) for c in ("precision", "recall", "f1", "map50", "map")])


# --- classification and semantic metrics ----------------------------------------------------------------------

@query("a11_classification_confusion", "SELECT quality truth, (n_chars > 500)::INT pred, count(*) n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def a11(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")
    return rows.groupBy(F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("pred")).agg(F.count("*").alias("n"))


def _neighbour_labels(spark, d) -> DataFrame:
    """A stated query set (ids divisible by 100) against all vectors: labels of the five nearest by dot product."""
    v = read(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("query"), F.col("label").alias("target"))
    near = search.with_vectors(search.candidates(v, q.select("q", "query"), 5), v, q)
    pairs = near.select("q", "target", "label", "vec_id", F.round(search.dot("embedding", "query"), 9).alias("s"))
    top = pairs.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).where("rk <= 5")
    return top.groupBy("q", "target").agg(F.array_sort(F.collect_list(F.struct("rk", "label"))).alias("top"))


_NN = """nn AS (SELECT q.vec_id q, q.label target, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE*z[2]::DOUBLE)),9) DESC, v.vec_id) rk
  FROM embeddings v JOIN embeddings q ON q.vec_id%100=0 AND v.vec_id<>q.vec_id)"""


@query("a14_classification_accuracy", ctes(_NN, "SELECT round(avg(t1),6) top1, round(avg(t5),6) top5, round((avg(t1)+avg(t5))/2,6) fitness FROM (SELECT q, max((rk=1 AND label=target)::INT) t1, max((label=target)::INT) t5 FROM nn WHERE rk<=5 GROUP BY q)"))
def a14(spark, d):
    rows = _neighbour_labels(spark, d)
    t1 = F.avg((F.element_at("top", 1)["label"] == F.col("target")).cast("int"))
    t5 = F.avg(F.exists("top", lambda t: t["label"] == F.col("target")).cast("int"))
    return rows.agg(F.round(t1, 6).alias("top1"), F.round(t5, 6).alias("top5"), F.round((t1 + t5) / 2, 6).alias("fitness"))


_SEM = "hist AS (SELECT coalesce(quality, 255) truth, (CASE WHEN n_chars>1500 THEN 2 WHEN n_chars>500 THEN 1 ELSE 0 END) pred, count(*) n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL HAVING truth<>255)"


def _histogram(spark, d) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id", "left")
    pred = F.when(F.col("n_chars") > 1500, 2).when(F.col("n_chars") > 500, 1).otherwise(0)
    hist = rows.groupBy(F.coalesce("quality", F.lit(255)).alias("truth"), pred.alias("pred")).agg(F.count("*").alias("n"))
    return hist.where("truth <> 255")


@query("a15_semantic_histogram", ctes(_SEM, "SELECT * FROM hist"))
def a15(spark, d):
    return _histogram(spark, d)


@query("a16_miou", ctes(_SEM, """SELECT round(avg(tp/(t+p-tp)),6) miou, round(sum(tp)/sum(t),6) pixel_acc, round(avg(tp/t),6) mean_acc FROM (
  SELECT c, sum(CASE WHEN truth=c AND pred=c THEN n ELSE 0 END)::DOUBLE tp, sum(CASE WHEN truth=c THEN n ELSE 0 END)::DOUBLE t, sum(CASE WHEN pred=c THEN n ELSE 0 END)::DOUBLE p
  FROM hist, (SELECT DISTINCT truth c FROM hist) GROUP BY c)"""))  # fmt: skip
def a16(spark, d):
    hist = _histogram(spark, d)
    scores = metrics.semantic_scores(hist).agg(F.round(F.avg("iou"), 6).alias("miou"), F.round(F.avg("acc"), 6).alias("mean_acc"))
    right = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    return scores.join(hist.agg(F.round(right / F.sum("n"), 6).alias("pixel_acc")), F.lit(True))


@query("a33_sigma_clip")
def a33(spark, d):
    kept = metrics.sigma_clip(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 2.0, 3)
    return kept.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


_clip = lambda src, out, cond: f"{out} AS (SELECT t.* FROM {src} t, (SELECT avg(v) m, stddev_pop(v) s FROM {src}) z WHERE {cond} OR s=0)"
ORACLES["a33_sigma_clip"] = ctes("c0 AS (SELECT o_totalprice v FROM orders)", _clip("c0", "c1", "abs(v-m)<2*s"),
    _clip("c1", "c2", "abs(v-m)<2*s"), _clip("c2", "c3", "abs(v-m)<2*s"), "SELECT count(*) n, round(avg(v),4) mean FROM c3")


@query("a34_lower_sigma_rejection", ctes("c0 AS (SELECT o_totalprice v FROM orders)", _clip("c0", "c1", "v>=m-s"), _clip("c1", "c2", "v>=m-s"), _clip("c2", "c3", "v>=m-s"), "SELECT count(*) n, round(avg(v),4) mean FROM c3"))
def a34(spark, d):
    kept = metrics.sigma_clip(read(spark, d, "orders").select("o_totalprice"), "o_totalprice", 1.0, 3, below_only=True)
    return kept.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("j20_near_duplicate_tracks", ctes(DETECTIONS, "ag AS (SELECT *, CAST(trunc(conf*100) AS INT) age FROM detections)",
    f"cl AS (SELECT a.det_id ta, b.det_id tb, a.age>b.age older FROM (SELECT * FROM ag WHERE cls=0) a JOIN (SELECT * FROM ag WHERE cls=1) b ON a.image_id=b.image_id AND {_touch} AND 1-{_iou}<5e-1)",
    "SELECT det_id track_id, 'a' side FROM detections WHERE cls=0 AND det_id NOT IN (SELECT ta FROM cl WHERE NOT older) UNION ALL SELECT det_id, 'b' FROM detections WHERE cls=1 AND det_id NOT IN (SELECT tb FROM cl WHERE older)"))
def j20(spark, d):
    rows = detections(spark, d).withColumn("age", (F.col("conf") * 100).cast("int"))
    cols = [F.col("det_id").alias("track_id"), "image_id", "age", "x1", "y1", "x2", "y2"]
    a, b = match.near_duplicate_tracks(rows.where("cls = 0").select(*cols), rows.where("cls = 1").select(*cols), 0.5)
    return a.select("track_id", F.lit("a").alias("side")).unionByName(b.select("track_id", F.lit("b").alias("side")))
