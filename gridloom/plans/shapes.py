"""Queries of file readers (over files the query writes in the shared folder) and of shapes that need loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import oriented as O
from gridloom.functions import shapes as S
from gridloom.plans.views import DETECTIONS, GT, ctes, detections, ground_truth, read
from gridloom.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` (in local mode a temporary one where that is not set)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}"


def _turned(spark, d) -> DataFrame:
    c = B.xyxy2xywh(B.box())
    pts = O.corners(O.Obb(c.a, c.b, c.c, c.d, F.col("conf") * 2 - 0.5))
    return detections(spark, d).select("det_id", F.array(*(v for p in pts for v in p)).alias("coords"))


@query("f10_min_area_rect", ctes(DETECTIONS, f"SELECT det_id, round((x1+x2)/2,4) cx, round((y1+y2)/2,4) cy, round(greatest(x2-x1,y2-y1),4) longer, round(least(x2-x1,y2-y1),4) shorter FROM detections"))
def f10(spark, d):
    r = _turned(spark, d).select("det_id", S.min_area_rect("coords").alias("r"))
    return r.select("det_id", F.round("r.cx", 4).alias("cx"), F.round("r.cy", 4).alias("cy"), F.round(F.greatest("r.w", "r.h"), 4).alias("longer"), F.round(F.least("r.w", "r.h"), 4).alias("shorter"))


@query("r2_merge_polygons")
def r2(spark, d):
    """Truth boxes of an image and class joined into one outline."""
    b = B.box()
    ring = F.array(b.a, b.b, b.c, b.b, b.c, b.d, b.a, b.d)
    parts = ground_truth(spark, d).groupBy("image_id", "cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("gt_id", ring.alias("p")))), lambda s: s["p"]).alias("parts"))
    outline = S.merge_polygons("parts")
    return parts.select("image_id", "cls", outline.alias("o")).select("image_id", "cls", F.size("o").alias("n"), F.to_json("o").alias("outline"))


@query("r3_polygon_mask", ctes(GT, "SELECT gt_id, count(*) n FROM gt, (SELECT unnest(range(64)) px), (SELECT unnest(range(60)) py) WHERE px+5e-1>=x1/10 AND px+5e-1<x2/10 AND py+5e-1>=y1/10 AND py+5e-1<y2/10 GROUP BY gt_id"))
def r3(spark, d):
    b = B.scale(B.box(), 0.1, 0.1)
    ring = F.array(b.a, b.b, b.c, b.b, b.c, b.d, b.a, b.d)
    return ground_truth(spark, d).select("gt_id", F.size(S.polygon_places(64, 60)(ring)).cast("long").alias("n"))


@query("s14_ndjson_scan", ctes(GT, "SELECT 'img' || image_id || '.jpg' AS file, count(*) n, sum(cls)::BIGINT cls_sum FROM gt GROUP BY image_id"))
def s14(spark, d):
    """Truth boxes written as NDJSON image records and read again."""
    path = scratch(spark)
    box = F.array(F.col("cls").cast("double"), *B.xyxy2xywhn(B.box(), 640, 600))
    images = ground_truth(spark, d).groupBy("image_id").agg(F.collect_list(box).alias("boxes"))
    rows = images.select(F.lit("image").alias("type"), F.concat(F.lit("img"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file"), F.lit("train").alias("split"), F.struct("boxes").alias("annotations"))
    rows.write.json(path)
    _, labels = files.ndjson(spark, path)
    return labels.groupBy("file").agg(F.count("cls").alias("n"), F.sum("cls").alias("cls_sum"))


@query("v8_ndjson_auto_val", "SELECT file, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5(file),1,15))::BIGINT, file)<=greatest(1,floor((SELECT count(*) FROM part)*1e-1)) THEN 'val' ELSE 'train' END split FROM (SELECT 'img' || p_partkey AS file FROM part)")
def v8(spark, d):
    names = read(spark, d, "part").select(F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("file"), F.lit("train").alias("split"))
    return files.with_validation(names).select("file", "split")


@query("s19_run_log_scan", "SELECT CAST(month(o_orderdate) AS INT) epoch, count(*) n FROM orders GROUP BY 1")
def s19(spark, d):
    path = scratch(spark)
    o = read(spark, d, "orders").groupBy(F.month("o_orderdate").alias("epoch")).agg(F.lit(1.0).alias("time"), F.count("*").cast("double").alias("metrics/n"))
    o.write.option("header", True).csv(path)
    return files.run_log(spark, path, ["metrics/n"]).select("epoch", F.col("metrics/n").cast("long").alias("n"))


@query("s13_grounding_scan", "SELECT p_partkey image_id, CAST(1 AS BIGINT) ann_id, lower(substr(p_name,1,4)) text, CAST(0 AS INT) cls FROM part")
def s13(spark, d):
    images = read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("caption"))
    anns = images.select("image_id", F.lit(1).cast("long").alias("ann_id"), F.array(F.array(F.lit(0), F.lit(4))).alias("tokens_positive"))
    return files.grounding(images, anns)


@query("s15_dota_scan", ctes(GT, "SELECT gt_id line_no, cls, x1+y1+x2+y1+x2+y2+x1+y2 s FROM gt"))
def s15(spark, d):
    b = B.box()
    names = spark.createDataFrame([(f"c{k}", k) for k in range(5)], "name string, cls int")
    raw = F.concat_ws(" ", *(v.cast("string") for v in (b.a, b.b, b.c, b.b, b.c, b.d, b.a, b.d)), F.concat(F.lit("c"), F.col("cls").cast("string")), F.lit("0"))
    lines = ground_truth(spark, d).select(F.lit("p").alias("path"), F.col("gt_id").alias("line_no"), raw.alias("raw"))
    return files.dota_labels(lines, names).select("line_no", "cls", F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("s"))
