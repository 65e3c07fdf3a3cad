"""Queries of the dataset operators over views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.operators import datasets as D
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


_H = "('0x' || substr(md5(CAST({} AS VARCHAR)),1,15))::BIGINT"


@query("s9_label_paths", "SELECT p_partkey, 'data/images/train/labels/' || p_partkey || '.txt' label FROM part")
def s9(spark, d):
    image = F.concat(F.lit("data/images/train/images/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    return read(spark, d, "part").select("p_partkey", D.label_path(image).alias("label"))


def label_lines(spark, d) -> DataFrame:
    """Label rows of the truth boxes as text; some are broken on purpose."""
    g = ground_truth(spark, d)
    c = B.xyxy2xywhn(B.box(), 640, 600)
    k = F.col("gt_id") % 50
    cls = F.when(k == 3, 9).otherwise(F.col("cls"))
    nums = [F.format_string("%.6f", v) for v in c]
    nums[0] = F.when(k == 7, "1.500000").when(k == 11, "-0.500000").when(k == 13, "abc").otherwise(nums[0])
    raw = F.concat_ws(" ", cls.cast("string"), *nums)
    raw = F.when(k == 17, F.concat(raw, F.lit(" 1"))).otherwise(raw)
    rows = g.select(F.col("image_id").cast("string").alias("path"), F.col("gt_id").alias("line_no"), raw.alias("raw"))
    return rows.unionByName(rows.where("line_no % 50 = 19").withColumn("line_no", F.col("line_no") + 100_000_000))


_LINES = f"""{GT}, ln0 AS (SELECT CAST(image_id AS VARCHAR) path, gt_id line_no, gt_id%50 k, CASE WHEN gt_id%50=3 THEN 9 ELSE cls END cls, (x1+x2)/2/640 xc, (y1+y2)/2/600 yc, (x2-x1)/640 w, (y2-y1)/600 h FROM gt),
  ln AS (SELECT * FROM ln0 UNION ALL SELECT path, line_no+100000000, k, cls, xc, yc, w, h FROM ln0 WHERE line_no%50=19),
  ck AS (SELECT path, line_no, CASE WHEN k=13 OR k=17 THEN 'columns' WHEN k=11 THEN 'negative' WHEN k=7 THEN 'not normalised' WHEN k=3 THEN 'class'
    WHEN row_number() OVER (PARTITION BY path, cls, xc, yc, w, h, k IN (13,17,11,7,3) ORDER BY line_no)>1 THEN 'duplicate' END problem FROM ln)"""


@query("v1_label_validation", ctes(_LINES, "SELECT * FROM ck"))
def v1(spark, d):
    return D.parse_labels(label_lines(spark, d), 5).select("path", "line_no", "problem")


QUERIES["s10_label_scan"], ORACLES["s10_label_scan"] = v1, ORACLES["v1_label_validation"]


@query("a39_scan_counters", ctes(_LINES, "SELECT coalesce(problem,'found') problem, count(*) n FROM ck GROUP BY 1"))
def a39(spark, d):
    rows = D.parse_labels(label_lines(spark, d), 5)
    return rows.groupBy(F.coalesce("problem", F.lit("found")).alias("problem")).agg(F.count("*").alias("n"))


@query("u1_duplicate_rows", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def u1(spark, d):
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates()


def _annotations(spark, d) -> DataFrame:
    c = B.xyxy2ltwh(B.box()).named("l", "t", "w", "h")
    return detections(spark, d).select("image_id", F.col("det_id").alias("ann_id"), "cls", (F.col("det_id") % 10 == 0).alias("iscrowd"), *c)


@query("v7_coco_to_labels", ctes(DETECTIONS, """SELECT image_id, ann_id, cls, round(xc,9) xc, round(yc,9) yc, round(wn,9) wn, round(hn,9) hn FROM (SELECT *, row_number() OVER (PARTITION BY image_id, cls, xc, yc, wn, hn ORDER BY ann_id) rk FROM (
  SELECT image_id, det_id ann_id, cls, (x1+(x2-x1)/2)/640 xc, (y1+(y2-y1)/2)/600 yc, (x2-x1)/640 wn, (y2-y1)/600 hn FROM detections WHERE det_id%10<>0)) WHERE rk=1"""))  # fmt: skip
def v7(spark, d):
    images = read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.lit(640.0).alias("width"), F.lit(600.0).alias("height"))
    rows = D.coco_to_labels(images, _annotations(spark, d))
    return rows.select("image_id", "ann_id", "cls", *[F.round(c, 9).alias(c) for c in ("xc", "yc", "wn", "hn")])


QUERIES["s12_coco_join"], ORACLES["s12_coco_join"] = v7, ORACLES["v7_coco_to_labels"]


@query("u2_duplicate_boxes", ctes(DETECTIONS, "SELECT image_id, cls, x1, y1, min(det_id) det_id FROM detections GROUP BY image_id, cls, x1, y1"))
def u2(spark, d):
    return detections(spark, d).groupBy("image_id", "cls", "x1", "y1").agg(F.min("det_id").alias("det_id"))


@query("j17_missing_labels", ctes(DETECTIONS, "SELECT p_partkey, (NOT EXISTS (SELECT 1 FROM detections WHERE image_id=p_partkey AND conf>97e-2)) background FROM part"))
def j17(spark, d):
    some = detections(spark, d).where("conf > 97e-2").select("image_id").distinct().withColumn("has", F.lit(1))
    return read(spark, d, "part").join(some, F.col("p_partkey") == F.col("image_id"), "left").select("p_partkey", F.col("has").isNull().alias("background"))


@query("a8_dataset_statistics", ctes(GT, f"im AS (SELECT p_partkey image_id, CASE WHEN {_H.format('p_partkey')}%1000000/1e6<9e-1 THEN 'train' ELSE 'val' END split FROM part)", "ob AS (SELECT split, cls, image_id FROM gt JOIN im USING (image_id) WHERE image_id%7<>0)",
    """SELECT split, cls, count(*) instances, count(DISTINCT image_id) images, NULL::BIGINT unlabelled FROM ob GROUP BY split, cls
       UNION ALL SELECT im.split, NULL, (SELECT count(*) FROM ob WHERE ob.split=im.split), count(*), count(*) FILTER (image_id NOT IN (SELECT image_id FROM ob)) FROM im GROUP BY im.split"""))  # fmt: skip
def a8(spark, d):
    images = D.weighted_split(read(spark, d, "part").select(F.col("p_partkey").alias("image_id")), "image_id")
    objects = ground_truth(spark, d).where("image_id % 7 <> 0").join(images, "image_id")
    return D.dataset_statistics(objects, images)


@query("t7_fraction_prefix", "SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) <= round_even((SELECT count(*) FROM part)*3e-1, 0)")
def t7(spark, d):
    part = read(spark, d, "part").select("p_partkey")
    return part.orderBy("p_partkey").limit(round(part.count() * 0.3))


@query("t8_weighted_split", f"SELECT p_partkey, CASE WHEN u<9e-1 THEN 'train' ELSE 'val' END split FROM (SELECT p_partkey, {_H.format('p_partkey')}%1000000/1e6 u FROM part)")
def t8(spark, d):
    return D.weighted_split(read(spark, d, "part").select("p_partkey"), "p_partkey")


@query("t9_class_split", f"SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY {_H.format('p_partkey')}, p_partkey)<=floor(count(*) OVER (PARTITION BY p_brand)*8e-1) THEN 'train' ELSE 'val' END split FROM part")
def t9(spark, d):
    return D.class_split(read(spark, d, "part"), "p_partkey", "p_brand").select("p_partkey", "split")


@query("t10_auto_val_split", f"SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY {_H.format('p_partkey')}, p_partkey)<=floor(count(*) OVER (PARTITION BY p_brand)*9e-1) THEN 'train' ELSE 'val' END split FROM part")
def t10(spark, d):
    return D.class_split(read(spark, d, "part"), "p_partkey", "p_brand", 0.9).select("p_partkey", "split")


@query("t11_contiguous_shards", "SELECT CAST(r AS INT) rank, least((b*r+least(r,x))*16, n) \"first\", least((b*(r+1)+least(r+1,x))*16, n) \"last\" FROM (SELECT unnest(range(3)) r), (SELECT n, ((n+15)//16)//3 b, ((n+15)//16)%3 x FROM (SELECT count(*) n FROM part))")
def t11(spark, d):
    return spark.createDataFrame(D.contiguous_shards(read(spark, d, "part").count(), 3, 16), "rank int, first long, last long")


@query("t15_k_folds", f"SELECT p_partkey, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY {_H.format('p_partkey')}, p_partkey)-1)%5 AS INT) fold FROM part")
def t15(spark, d):
    return D.k_folds(read(spark, d, "part"), "p_partkey", 5, "p_brand").select("p_partkey", "fold")


@query("t12_label_sampling", f"SELECT image_id, cls, role FROM (SELECT DISTINCT image_id, cls, 'positive' AS role FROM gt UNION ALL SELECT image_id, cls, 'negative' FROM (SELECT p_partkey image_id, CAST(c AS INT) cls, row_number() OVER (PARTITION BY p_partkey ORDER BY {_H.format('p_partkey*7+c')}, c) rk FROM part, (SELECT unnest(range(8)) c) WHERE (p_partkey, c) NOT IN (SELECT (image_id, cls) FROM gt)) WHERE rk<=2)".join(["WITH " + GT + " ", ""]))
def t12(spark, d):
    """All classes of an image, and two others of the eight in hash order."""
    pos = ground_truth(spark, d).select("image_id", "cls").distinct()
    every = read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cls"))
    w = Window.partitionBy("image_id").orderBy(D.hash_order(F.col("image_id") * 7 + F.col("cls")), "cls")
    neg = every.join(pos, ["image_id", "cls"], "left_anti").withColumn("rk", F.row_number().over(w)).where("rk <= 2")
    return pos.withColumn("role", F.lit("positive")).unionByName(neg.select("image_id", "cls", F.lit("negative").alias("role")))


_CC = "cc AS (SELECT CAST(k AS INT) cls, coalesce(n,0) n FROM (SELECT unnest(range(8)) k) LEFT JOIN (SELECT cls, count(*) n FROM gt GROUP BY cls) ON cls=k)"


@query("a26_class_counts", ctes(GT, _CC, "SELECT * FROM cc"))
def a26(spark, d):
    return D.class_counts(ground_truth(spark, d), spark.range(8).select(F.col("id").cast("int").alias("cls")))


@query("a25_class_weights", ctes(GT, _CC, "SELECT cls, round(r/(avg(r) OVER ()),6) weight FROM (SELECT cls, 1e0/greatest(n,1) r FROM cc)"))
def a25(spark, d):
    return D.class_weights(a26(spark, d)).select("cls", F.round("weight", 6).alias("weight"))


@query("a23_synonym_frequency", "SELECT w, count(*) n FROM (SELECT unnest(string_split(p_name, ' ')) w FROM part) GROUP BY w")
def a23(spark, d):
    return read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query("a24_frequent_categories", "WITH f AS (SELECT p_brand, count(*) n FROM part GROUP BY 1) SELECT * FROM f WHERE n>=least((SELECT max(n) FROM f),100)")
def a24(spark, d):
    f = read(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return f.withColumn("top", F.max("n").over(Window.partitionBy())).where(F.col("n") >= F.least("top", F.lit(100))).drop("top")


@query("a32_histogram_2d", ctes(DETECTIONS, "en AS (SELECT min((x1+x2)/2) a, max((x1+x2)/2) b, min((y1+y2)/2) c, max((y1+y2)/2) e FROM detections)", "SELECT CAST(least(floor(((x1+x2)/2-a)/(b-a)*50),49) AS INT) bx, CAST(least(floor(((y1+y2)/2-c)/(e-c)*50),49) AS INT) by_, count(*) n FROM detections, en GROUP BY ALL"))
def a32(spark, d):
    c = B.xyxy2xywh(B.box())
    return D.histogram_2d(detections(spark, d).select(c.a.alias("cx"), c.b.alias("cy")), "cx", "cy")


@query("a38_expected_count", ctes(GT, "SELECT count(*) found, (SELECT count(*)*8 FROM part) expected, count(*)=(SELECT count(*)*8 FROM part) ok FROM gt"))
def a38(spark, d):
    found = ground_truth(spark, d).agg(F.count("*").alias("found"))
    want = read(spark, d, "part").agg((F.count("*") * 8).alias("expected"))
    return found.join(want, F.lit(True)).withColumn("ok", F.col("found") == F.col("expected"))


@query("a40_dataset_hash", "SELECT p_brand, sha256(CAST(sum(p_size) AS VARCHAR) || string_agg('img' || p_partkey, '' ORDER BY p_partkey)) h FROM part GROUP BY p_brand")
def a40(spark, d):
    rows = read(spark, d, "part").groupBy("p_brand").agg(F.sum("p_size").alias("s"), F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    text = F.concat(F.col("s").cast("string"), F.array_join(F.transform("keys", lambda k: F.concat(F.lit("img"), k.cast("string"))), ""))
    return rows.select("p_brand", F.sha2(text, 256).alias("h"))


def _sizes(spark, d) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 32 + 640).alias("width"), (F.col("p_size") * 24 + 500).alias("height"), "p_brand")


_TILES = """sz AS (SELECT p_partkey image_id, p_size*32+640 width, p_size*24+500 height, p_brand FROM part),
  tx AS (SELECT image_id, width, height, CASE WHEN width>640 AND i*540+640>width THEN width-640 ELSE i*540 END x FROM sz, (SELECT unnest(range(10)) i) WHERE i<CASE WHEN width<=640 THEN 1 ELSE ceil((width-640)/540e0)+1 END),
  ty AS (SELECT *, CASE WHEN height>640 AND j*540+640>height THEN height-640 ELSE j*540 END y FROM tx, (SELECT unnest(range(10)) j) WHERE j<CASE WHEN height<=640 THEN 1 ELSE ceil((height-640)/540e0)+1 END),
  tc AS (SELECT *, (least(x+640,width)-x)*(least(y+640,height)-y)/409600e0 cover FROM ty),
  tl AS (SELECT image_id, CAST(x AS INT) x, CAST(y AS INT) y, CAST(x+640 AS INT) x2, CAST(y+640 AS INT) y2 FROM (SELECT *, max(cover) OVER (PARTITION BY image_id) best FROM tc) WHERE cover>6e-1 OR (best<=6e-1 AND cover=best))"""


@query("r10_tile_windows", ctes(_TILES, "SELECT * FROM tl"))
def r10(spark, d):
    return D.tile_windows(_sizes(spark, d), 640, 100)


QUERIES["v11_test_tiles"], ORACLES["v11_test_tiles"] = r10, ORACLES["r10_tile_windows"]


@query("j9_tile_objects", ctes(DETECTIONS, _TILES, """SELECT tile, obj_id, cls, round((x1-x)/640,8) nx1, round((y1-y)/640,8) ny1, round((x2-x)/640,8) nx2, round((y2-y)/640,8) ny2 FROM (
  SELECT tl.image_id || '__640__' || tl.x || '___' || tl.y tile, det_id obj_id, cls, d.x1, d.y1, d.x2, d.y2, tl.x, tl.y,
  greatest(least(tl.x2,d.x2)-greatest(tl.x,d.x1),0)*greatest(least(tl.y2,d.y2)-greatest(tl.y,d.y1),0)/((d.x2-d.x1)*(d.y2-d.y1)) iof FROM detections d JOIN tl ON tl.image_id=d.image_id) WHERE iof>=7e-1"""))  # fmt: skip
def j9(spark, d):
    objects = detections(spark, d).withColumnRenamed("det_id", "obj_id")
    rows = D.tile_objects(D.tile_windows(_sizes(spark, d), 640, 100), objects)
    return rows.select("tile", "obj_id", "cls", *[F.round(c, 8).alias(c) for c in ("nx1", "ny1", "nx2", "ny2")])


@query("w17_aspect_batches", ctes(_TILES, "SELECT p_brand, batch, count(*) n, round(CASE WHEN max(ar)<1 THEN max(ar) ELSE 1 END,9) shape_h, round(CASE WHEN max(ar)>=1 AND min(ar)>1 THEN 1/min(ar) ELSE 1 END,9) shape_w FROM (SELECT p_brand, height/width::DOUBLE ar, (row_number() OVER (PARTITION BY p_brand ORDER BY height/width::DOUBLE, image_id)-1)//16 batch FROM sz) GROUP BY ALL"))
def w17(spark, d):
    rows = D.aspect_batches(_sizes(spark, d), 16, "p_brand")
    return rows.select("p_brand", "batch", "n", F.round("shape_h", 9).alias("shape_h"), F.round("shape_w", 9).alias("shape_w"))


@query("w16_unique_names", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name)=1 THEN p_name ELSE p_name || '-' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) END unique_name FROM part")
def w16(spark, d):
    return D.unique_names(read(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("s17_class_folders", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand)-1 AS INT) cls FROM part")
def s17(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.concat(F.lit("root/train/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"))
    named = rows.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return D.remap_vocabulary(named, "folder").select("p_partkey", F.col("text_id").cast("int").alias("cls"))


@query("u3_concat_instances", ctes(DETECTIONS, GT, "SELECT image_id, cls, x1 FROM detections UNION ALL SELECT image_id, cls, x1 FROM gt"))
def u3(spark, d):
    cols = ["image_id", "cls", "x1"]
    return detections(spark, d).select(cols).unionByName(ground_truth(spark, d).select(cols))


for _n in ("s25_dataset_concat", "v13_mixup_labels"):
    QUERIES[_n], ORACLES[_n] = u3, ORACLES["u3_concat_instances"]


@query("u4_mosaic_concat", ctes(DETECTIONS, "SELECT image_id//4 mosaic, det_id, x1, y1, x2, y2 FROM (SELECT image_id, det_id, least(greatest(x1+ox,0e0),1000e0) x1, least(greatest(y1+oy,0e0),900e0) y1, least(greatest(x2+ox,0e0),1000e0) x2, least(greatest(y2+oy,0e0),900e0) y2 FROM (SELECT *, (image_id%2)*640 ox, ((image_id//2)%2)*600 oy FROM detections)) WHERE (x2-x1)*(y2-y1)>0"))
def u4(spark, d):
    """Four images in a square, clipped to its canvas; what lies outside goes."""
    i = F.col("image_id")
    moved = B.clip(B.shift(B.box(), i % 2 * 640, F.floor(i / 2) % 2 * 600), 1000, 900)
    rows = detections(spark, d).select(F.floor(i / 4).alias("mosaic"), "det_id", *moved.named())
    return rows.where(B.area(B.box()) > 0)


@query("v14_cutmix", ctes(DETECTIONS, "SELECT det_id, least(greatest(x1,200e0),400e0) x1, least(x2,400e0) x2 FROM detections d WHERE greatest(least(x2,400e0)-greatest(x1,200e0),0)*greatest(least(y2,400e0)-greatest(y1,200e0),0)/((x2-x1)*(y2-y1)+1e-7)>=1e-1 AND greatest(least(x2,400e0)-greatest(x1,200e0),0)*greatest(least(y2,400e0)-greatest(y1,200e0),0)>0"))
def v14(spark, d):
    cut = B.Box(*(F.lit(v) for v in (200.0, 200.0, 400.0, 400.0)))
    rows = detections(spark, d).where(B.overlap(cut, B.box()) & (B.ioa(cut, B.box()) >= 0.1))
    return rows.select("det_id", F.least(F.greatest("x1", F.lit(200.0)), F.lit(400.0)).alias("x1"), F.least("x2", F.lit(400.0)).alias("x2"))


@query("v15_copy_paste", ctes(DETECTIONS, GT, """SELECT det_id FROM (SELECT d.det_id, d.image_id, coalesce(max(greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0)/((d.x2-d.x1)*(d.y2-d.y1)+1e-7)),0) ioa
  FROM detections d LEFT JOIN gt g ON g.image_id=d.image_id GROUP BY 1,2) WHERE ioa<3e-1"""))  # fmt: skip
def v15(spark, d):
    """Boxes covered by less than 30 % by any existing box of their image."""
    g = ground_truth(spark, d).select(F.col("image_id").alias("g_image"), *[F.col(c).alias(f"g{c}") for c in ("x1", "y1", "x2", "y2")])
    hit = (F.col("image_id") == F.col("g_image")) & B.overlap(B.box("g"), B.box()) & (B.ioa(B.box("g"), B.box()) >= 0.3)
    return detections(spark, d).join(g, hit, "left_anti").select("det_id")


@query("p9_anchor_in_truth", ctes(GT, "SELECT gt_id, count(*) n FROM gt JOIN (SELECT (x+5e-1)*32 ax, (y+5e-1)*32 ay FROM (SELECT unnest(range(20)) x), (SELECT unnest(range(20)) y)) ON least(ax-x1, ay-y1, x2-ax, y2-ay)>1e-9 GROUP BY gt_id"))
def p9(spark, d):
    """Anchor cells of stride 32 whose centre lies inside each truth box: the cells follow from the box, no join."""
    g = ground_truth(spark, d)
    cells = lambda lo, hi: F.filter(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (i + 0.5) * 32), lambda a: (a - F.col(lo) > 1e-9) & (F.col(hi) - a > 1e-9))
    return g.select("gt_id", (F.size(cells("x1", "x2")) * F.size(cells("y1", "y2"))).cast("long").alias("n")).where("n > 0")


@query("j25_anchor_top_k", ctes(GT, DETECTIONS, """al AS (SELECT d.det_id, g.gt_id, i/(ad+ag-i+1e-7) iou, conf FROM (SELECT d.det_id, d.conf, g.gt_id, (d.x2-d.x1)*(d.y2-d.y1) ad, (g.x2-g.x1)*(g.y2-g.y1) ag, greatest(least(d.x2,g.x2)-greatest(d.x1,g.x1),0e0)*greatest(least(d.y2,g.y2)-greatest(d.y1,g.y1),0e0) i FROM detections d JOIN gt g ON d.image_id=g.image_id) d JOIN gt g ON g.gt_id=d.gt_id WHERE i>0),
  tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY round(sqrt(conf)*iou*iou*iou*iou*iou*iou,12) DESC, det_id) rk FROM al) WHERE rk<=3)""",
    "SELECT det_id, gt_id FROM (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, gt_id) r2 FROM tk) WHERE r2=1"))
def j25(spark, d):
    from gridloom.operators.match import candidate_pairs

    pairs = candidate_pairs(detections(spark, d), ground_truth(spark, d), 0.0, same_class=False)
    i = F.col("iou")
    align = F.round(F.sqrt("conf") * i * i * i * i * i * i, 12)
    top = pairs.withColumn("rk", F.row_number().over(Window.partitionBy("gt_id").orderBy(F.desc(align), "det_id"))).where("rk <= 3")
    return top.withColumn("rk", F.row_number().over(Window.partitionBy("det_id").orderBy(F.desc("iou"), "gt_id"))).where("rk = 1").select("det_id", "gt_id")


QUERIES["t5_anchor_top_k"], ORACLES["t5_anchor_top_k"] = j25, ORACLES["j25_anchor_top_k"]


@query("j18_difference_by_id", ctes(DETECTIONS, "SELECT det_id FROM detections WHERE conf>5e-1 AND det_id NOT IN (SELECT det_id FROM detections WHERE cls=2)"))
def j18(spark, d):
    rows = detections(spark, d)
    return rows.where("conf > 5e-1").join(rows.where("cls = 2").select("det_id"), "det_id", "left_anti").select("det_id")


QUERIES["u7_difference"], ORACLES["u7_difference"] = j18, ORACLES["j18_difference_by_id"]


@query("j19_union_by_id", ctes(DETECTIONS, "SELECT det_id, 'a' side FROM detections WHERE conf>5e-1 UNION ALL SELECT det_id, 'b' FROM detections WHERE cls=2 AND conf<=5e-1"))
def j19(spark, d):
    a, b = detections(spark, d).where("conf > 5e-1").select("det_id"), detections(spark, d).where("cls = 2").select("det_id")
    return a.withColumn("side", F.lit("a")).unionByName(b.join(a, "det_id", "left_anti").withColumn("side", F.lit("b")))


QUERIES["u6_union"], ORACLES["u6_union"] = j19, ORACLES["j19_union_by_id"]


@query("j22_class_names", ctes(DETECTIONS, "SELECT det_id, ['person','car','dog','cup','bird'][cls+1] name FROM detections"))
def j22(spark, d):
    names = spark.createDataFrame(list(enumerate(["person", "car", "dog", "cup", "bird"])), "cls int, name string")
    return detections(spark, d).join(F.broadcast(names), "cls").select("det_id", "name")


@query("j26_name_remap", "SELECT a.p_partkey, b.r_regionkey FROM part a JOIN region b ON lower(a.p_brand)=lower(b.r_name) UNION ALL SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey=r_regionkey AND lower(r_name)=lower(r_name)")
def j26(spark, d):
    region = read(spark, d, "region")
    part = read(spark, d, "part").join(region, F.lower("p_brand") == F.lower("r_name")).select("p_partkey", "r_regionkey")
    return part.union(read(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long"), "r_regionkey"))


@query("r12_crop_layers", """WITH p AS (SELECT p_partkey image_id, 600+p_partkey%5*100 w, 400+p_partkey%3*90 h FROM part),
  l AS (SELECT *, CAST(floor(25e-2*least(w,h)*2/n) AS INT) ov FROM p, (VALUES (1,2),(2,4)) t(layer,n)),
  c AS (SELECT *, CAST(ceil((ov*(n-1)+w)/n::DOUBLE) AS INT) cw, CAST(ceil((ov*(n-1)+h)/n::DOUBLE) AS INT) ch FROM l)
  SELECT image_id, CAST(0 AS INT) layer, CAST(0 AS INT) x0, CAST(0 AS INT) y0, CAST(w AS INT) x1, CAST(h AS INT) y1 FROM p UNION ALL
  SELECT image_id, layer, CAST((cw-ov)*i AS INT), CAST((ch-ov)*j AS INT), CAST(least((cw-ov)*i+cw,w) AS INT), CAST(least((ch-ov)*j+ch,h) AS INT) FROM c, (SELECT unnest(range(4)) i), (SELECT unnest(range(4)) j) WHERE i<n AND j<n""")  # fmt: skip
def r12(spark, d):
    """Crop boxes of images: each whole, and in layers of 2 x 2 and 4 x 4, a quarter of the shorter side overlapping."""
    k = F.col("p_partkey")
    images = read(spark, d, "part").select(k.alias("image_id"), (600 + k % 5 * 100).cast("int").alias("w"), (400 + k % 3 * 90).cast("int").alias("h"))
    return crop_layers(images, 2, 0.25)


def crop_layers(images: DataFrame, layers: int, ratio: float) -> DataFrame:
    """``image_id, layer, x0, y0, x1, y1`` of images (image_id, w, h): layer 0 is the image, layer n has 2 ** n boxes a side."""
    rows = images.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers)))).withColumn("n", F.pow(F.lit(2), F.col("layer")).cast("int"))
    rows = rows.withColumn("ov", F.floor(ratio * F.least("w", "h") * (F.lit(2.0) / F.col("n"))).cast("int"))
    for side, size in (("cw", "w"), ("ch", "h")):
        rows = rows.withColumn(side, F.ceil((F.col("ov") * (F.col("n") - 1) + F.col(size)) / F.col("n")).cast("int"))
    for i in "ij":
        rows = rows.withColumn(i, F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x0, y0 = (F.col("cw") - F.col("ov")) * F.col("i"), (F.col("ch") - F.col("ov")) * F.col("j")
    return rows.select("image_id", "layer", x0.alias("x0"), y0.alias("y0"), F.least(x0 + F.col("cw"), "w").alias("x1"), F.least(y0 + F.col("ch"), "h").alias("y1"))
