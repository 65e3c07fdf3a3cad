"""Queries of metric variants (masks, keypoints, oriented boxes), result members, label conversions and written datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import oriented as O
from gridloom.operators import datasets as D
from gridloom.operators import export as E
from gridloom.operators import match, metrics, search
from gridloom.operators.zones import cell_series
from gridloom.plans import geometry as G
from gridloom.plans.evaluation import _AP, _MATCH, _MEANS
from gridloom.plans.shapes import scratch
from gridloom.plans.views import DETECTIONS, GT, TRACKS, ctes, detections, ground_truth, read, tracks
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


# --- average precision by other similarities ----------------------------------------------------------------------


def _means(spark, d, pairs: DataFrame) -> DataFrame:
    """Means of average precision over pairs ``image_id, det_id, conf, cls, gt_id, iou`` of one class."""
    gt = ground_truth(spark, d)
    ap = metrics.class_ap(detections(spark, d), match.claims(pairs.where(F.col("iou") >= match.THRESHOLDS[0])), gt, match.THRESHOLDS)
    return metrics.metric_means(ap).select(*[F.round(c, 6).alias(c) for c in ("map50", "map75", "map")])


def _variant(view: str, pairs: str) -> str:
    """The text of average precision with the pairs of ``pairs`` in place of those of plain boxes."""
    start, end = _MATCH.index("pr AS ("), _MATCH.index("th AS (")
    return ctes(view, _AP.replace(_MATCH, f"{pairs}, {_MATCH[end:]}"), _MEANS) if start < end else ""


_same_class = "(gt_id%12)%5=cls"


@query("a22_oriented_map", _variant(G.PROB, f"pr AS (SELECT det_id, image_id, cls, conf, gt_id, iou FROM (SELECT *, {G._probiou_sql()} iou FROM pq WHERE {_same_class}) WHERE iou>=5e-1)").replace("pr AS (SELECT d.*", "bp AS (SELECT d.*").replace("FROM pr)))", "FROM bp)))"))
def a22(spark, d):
    """Average precision of oriented boxes by the distance of their Gaussians."""
    pairs = G._pairs(spark, d).where(F.col("gt_id") % 12 % 5 == F.col("cls")).withColumn("iou", O.probiou(G._obb(), G._gt_obb()))
    return _means(spark, d, pairs)


_OKS = f"""((1-(gt_id%2))*{G._oks_term('gx2-x2', 'gy2-y2', 0.07)}+{G._oks_term('gx1-x1', 'gy1-y1', 0.05)}+{G._oks_term('gx2-x2', 'gy1-y1', 0.06)}+{G._oks_term('gx1-x1', 'gy2-y2', 0.08)})/((CASE WHEN gt_id%2=1 THEN 3 ELSE 4 END)+1e-7)"""


@query("a21_pose_map", _variant(G.PAIRS.replace("pr AS (", "bp AS ("), f"pr AS (SELECT det_id, image_id, cls, conf, gt_id, iou FROM (SELECT *, round({_OKS},12) iou FROM (SELECT *, (gx2-gx1)*(gy2-gy1)*53e-2 ar FROM bp WHERE {_same_class})) WHERE iou>=5e-1)"))
def a21(spark, d):
    """Average precision of four keypoints (the corners; the third is unseen on odd truths) by their similarity."""
    seen = F.when(F.col("gt_id") % 2 == 1, 0.0).otherwise(2.0)
    kp = lambda b, v: F.array(*(F.struct(x.alias("x"), y.alias("y"), w.alias("v")) for x, y, w in ((b.a, b.b, F.lit(2.0)), (b.c, b.b, F.lit(2.0)), (b.c, b.d, v), (b.a, b.d, F.lit(1.0)))))
    rows = G._pairs(spark, d).where(F.col("gt_id") % 12 % 5 == F.col("cls"))
    oks = O.oks(kp(B.box("g"), seen), kp(B.box(), F.lit(2.0)), B.area(B.box("g")) * 0.53, [0.05, 0.06, 0.07, 0.08])
    return _means(spark, d, rows.withColumn("iou", F.round(oks, 12)))


def _places(boxes: DataFrame, key: str, *more: str) -> DataFrame:
    """Set ``places`` of a grid of 20 pixels of each box, as an array, with its image, class and ``more``."""
    lo, hi = lambda c: F.floor(F.col(c) / 20).cast("int"), lambda c: F.ceil(F.col(c) / 20).cast("int") - 1
    rows = boxes.select(key, "image_id", "cls", *more, F.sequence(lo("x1"), hi("x2")).alias("xs"), F.sequence(lo("y1"), hi("y2")).alias("ys"))
    return rows.select(key, "image_id", "cls", *more, F.flatten(F.transform("xs", lambda x: F.transform("ys", lambda y: x * 64 + y))).alias("places"))


def _cells(boxes: DataFrame, key: str) -> DataFrame:
    """:func:`_places` with a row for each place."""
    return _places(boxes, key).select(key, "image_id", "cls", F.explode("places").alias("place"))


_grid = lambda t, k: f"SELECT {k}, image_id, cls, x*64+y place FROM {t}, (SELECT unnest(range(64)) x), (SELECT unnest(range(64)) y) WHERE x BETWEEN floor(x1/20) AND ceil(x2/20)-1 AND y BETWEEN floor(y1/20) AND ceil(y2/20)-1"
_MASKS = f"""{DETECTIONS}, {GT}, dm AS ({_grid('detections', 'det_id')}), gm AS ({_grid('gt', 'gt_id')}),
  dn AS (SELECT det_id, count(*) n FROM dm GROUP BY 1), gn AS (SELECT gt_id, count(*) n FROM gm GROUP BY 1),
  im AS (SELECT det_id, gt_id, count(*) i FROM dm JOIN gm USING (image_id, cls, place) GROUP BY ALL)"""


@query("a20_mask_map", _variant(_MASKS, "pr AS (SELECT det_id, image_id, cls, conf, gt_id, iou FROM (SELECT det_id, gt_id, i/(dn.n+gn.n-i+1e-7) iou FROM im JOIN dn USING (det_id) JOIN gn USING (gt_id)) JOIN detections USING (det_id) WHERE iou>=5e-1)"))
def a20(spark, d):
    """Average precision of masks: set places shared over set places of either; a mask is one row, with its places."""
    dets = _places(detections(spark, d), "det_id", "conf")
    gts = _places(ground_truth(spark, d), "gt_id").withColumnRenamed("places", "theirs")
    i = F.size(F.array_intersect("places", "theirs"))
    pairs = dets.join(gts, ["image_id", "cls"]).withColumn("i", i).where("i > 0")
    return _means(spark, d, pairs.withColumn("iou", F.col("i") / (F.size("places") + F.size("theirs") - F.col("i") + 1e-7)).drop("places", "theirs"))


# --- members of results --------------------------------------------------------------------------------------------


@query("e5_slice_rows", ctes(DETECTIONS, "SELECT det_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id)-1 i, count(*) OVER (PARTITION BY image_id) n FROM detections) WHERE i>=1 AND i<n-2 AND (i-1)%2=0"))
def e5(spark, d):
    """Every second row of each image from the second on, without the last two."""
    return E.sliced(detections(spark, d), "image_id", "det_id", 1, -2, 2).select("det_id", "image_id")


@query("e3_semantic_rows", ctes(GT, """pm AS (SELECT image_id, x, y, min(cls) cls FROM gt, (SELECT CAST(unnest(range(32)) AS INT) x), (SELECT CAST(unnest(range(32)) AS INT) y)
  WHERE x BETWEEN floor(x1/20) AND ceil(x2/20)-1 AND y BETWEEN floor(y1/20) AND ceil(y2/20)-1 GROUP BY ALL)""",
    "SELECT image_id, ['person','car','dog','cup','bird'][cls+1] name, cls class, round(count(*)/1024e0,5) pixel_ratio FROM pm GROUP BY image_id, cls"))
def e3(spark, d):
    """Classes of each image's class map and the share of its pixels that each has."""
    pixels = _cells(ground_truth(spark, d), "gt_id").groupBy("image_id", "place").agg(F.min("cls").alias("cls"))
    names = spark.createDataFrame(list(enumerate(["person", "car", "dog", "cup", "bird"])), "cls int, name string")
    return E.semantic_rows(pixels, names, 1024)


@query("v17_collated", ctes(DETECTIONS, "SELECT image_id//16 batch, CAST(image_id%16 AS INT) batch_idx, det_id, cls, round((x1+x2)/2/640,9) xc, round((y1+y2)/2/600,9) yc, round((x2-x1)/640,9) w, round((y2-y1)/600,9) h FROM detections"))
def v17(spark, d):
    """Normalised centre boxes of batches of 16 images, each with its image's place in the batch."""
    c = B.xyxy2xywhn(B.box(), 640, 600)
    i = F.col("image_id")
    return detections(spark, d).select(F.floor(i / 16).alias("batch"), (i % 16).cast("int").alias("batch_idx"), "det_id", "cls", *[F.round(v, 9).alias(n) for v, n in zip(c, ("xc", "yc", "w", "h"))])


# --- labels --------------------------------------------------------------------------------------------------------


@query("v4_box_segment_consistency", ctes(DETECTIONS, "pi AS (SELECT image_id%3 dataset, image_id, count(*) boxes, count(*) FILTER (image_id%3<>1 OR det_id%50<>0) segments FROM detections GROUP BY image_id)",
    "SELECT dataset, image_id, boxes, CAST(CASE WHEN sum(boxes) OVER w=sum(segments) OVER w THEN segments ELSE 0 END AS BIGINT) segments FROM pi WINDOW w AS (PARTITION BY dataset)"))
def v4(spark, d):
    """Three datasets, in one of which some boxes have no segment, so that all its segments are dropped."""
    has = (F.col("image_id") % 3 != 1) | (F.col("det_id") % 50 != 0)
    per = detections(spark, d).groupBy((F.col("image_id") % 3).alias("dataset"), "image_id").agg(F.count("*").alias("boxes"), F.sum(has.cast("long")).alias("segments"))
    return D.consistent_segments(per, "dataset")


@query("u5_vocabulary_union", "SELECT text, CAST(row_number() OVER (ORDER BY text)-1 AS INT) text_id FROM (SELECT p_brand AS text FROM part UNION SELECT p_type FROM part UNION SELECT r_name FROM region)")
def u5(spark, d):
    part = read(spark, d, "part")
    return D.united_vocabulary([part.select(F.col("p_brand").alias("text")), part.select(F.col("p_type").alias("text")), read(spark, d, "region").select(F.col("r_name").alias("text"))])


_corner_sql = ", ".join(f"round(p{a}{i}/{s},6) {a}{i}" for i in range(1, 5) for a, s in (("x", "640"), ("y", "600")))


@query("v9_dota_to_labels", ctes(G._obb_view, f"SELECT det_id, cls, {_corner_sql} FROM oc"))
def v9(spark, d):
    """The four corners of oriented boxes over the image's size."""
    ends = zip(range(1, 5), O.corners(G._obb()))
    return detections(spark, d).select("det_id", "cls", *[F.round(v / s, 6).alias(f"{a}{i}") for i, p in ends for v, a, s in zip(p, "xy", (640, 600))])


@query("s16_dota_annotations", ctes(GT, "SELECT image_id, CAST(600 AS INT) height, CAST(640 AS INT) width, '[' || string_agg('[' || cls || ',' || x1::INT || ',' || y1::INT || ',' || x2::INT || ',' || y2::INT || ']', ',' ORDER BY gt_id) || ']' labels FROM gt GROUP BY image_id"))
def s16(spark, d):
    """Each image's size and label matrix, in order of the labels."""
    cells = F.array(*(F.col(c).cast("int") for c in ("cls", "x1", "y1", "x2", "y2")))
    per = ground_truth(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gt_id", cells.alias("row")))).alias("rows"))  # an image's labels
    return per.select("image_id", F.lit(600).alias("height"), F.lit(640).alias("width"), F.to_json(F.transform("rows", lambda r: r["row"])).alias("labels"))


def _tiles_sql(name: str, crop: int, gap: int) -> str:
    step = crop - gap
    starts = lambda size, k: f"CASE WHEN {size}>{crop} AND {k}*{step}+{crop}>{size} THEN {size}-{crop} ELSE {k}*{step} END"
    many = lambda size, k: f"{k}<CASE WHEN {size}<={crop} THEN 1 ELSE ceil(({size}-{crop})/{step}e0)+1 END"
    return f"""{name}x AS (SELECT image_id, width, height, {starts('width', 'i')} x FROM sz, (SELECT unnest(range(40)) i) WHERE {many('width', 'i')}),
  {name}y AS (SELECT *, {starts('height', 'j')} y FROM {name}x, (SELECT unnest(range(40)) j) WHERE {many('height', 'j')}),
  {name}c AS (SELECT *, (least(x+{crop},width)-x)*(least(y+{crop},height)-y)/{crop * crop}e0 cover FROM {name}y),
  {name} AS (SELECT image_id, {crop} size, x, y FROM (SELECT *, max(cover) OVER (PARTITION BY image_id) best FROM {name}c) WHERE cover>6e-1 OR (best<=6e-1 AND cover=best))"""


_TL = f"""{DETECTIONS}, sz AS (SELECT p_partkey image_id, p_size*32+640 width, p_size*24+500 height FROM part), {_tiles_sql('ta', 1280, 200)}, {_tiles_sql('tb', 640, 100)},
  tl AS (SELECT * FROM ta UNION ALL SELECT * FROM tb), ob AS (SELECT tl.image_id || '__' || size || '__' || tl.x || '___' || tl.y tile, det_id, cls, (x1-tl.x)/size a, (y1-tl.y)/size b, (x2-tl.x)/size c, (y2-tl.y)/size e,
    greatest(least(tl.x+size,x2)-greatest(tl.x,x1),0)*greatest(least(tl.y+size,y2)-greatest(tl.y,y1),0)/((x2-x1)*(y2-y1)) iof FROM detections d JOIN tl ON tl.image_id=d.image_id)"""


def _scaled_tiles(spark, d) -> DataFrame:
    """Objects of tiles at half and at full size."""
    sizes = read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 32 + 640).alias("width"), (F.col("p_size") * 24 + 500).alias("height"))
    objects = detections(spark, d).withColumnRenamed("det_id", "obj_id")
    return D.scaled_tile_objects(sizes, objects, 640, 100, [0.5, 1.0])


@query("v10_tile_split", ctes(_TL, "SELECT tile, count(*) n, round(sum(a),8) left_ends FROM ob WHERE iof>=7e-1 GROUP BY tile"))
def v10(spark, d):
    return _scaled_tiles(spark, d).groupBy("tile").agg(F.count("*").alias("n"), F.round(F.sum("nx1"), 8).alias("left_ends"))


@query("r11_crop_labels", ctes(_TL, "SELECT tile, det_id, printf('%d %.9f %.9f %.9f %.9f', cls, a, b, c, e) line FROM ob WHERE iof>=7e-1"))
def r11(spark, d):
    """A tile's label lines: class and box in tile coordinates."""
    rows = _scaled_tiles(spark, d)
    return rows.select("tile", F.col("obj_id").alias("det_id"), F.format_string("%d %.9f %.9f %.9f %.9f", "cls", "nx1", "ny1", "nx2", "ny2").alias("line"))


@query("s18_mask_pairs", "SELECT 'p' || p_partkey stem, CASE WHEN p_partkey%7=0 THEN 'no mask' WHEN p_partkey%11=0 THEN 'shapes differ' ELSE 'pair' END state FROM part UNION ALL SELECT 'q' || p_partkey, 'no image' FROM part WHERE p_partkey%13=0")
def s18(spark, d):
    """Image and mask files joined by stem, their shapes compared."""
    k = F.col("p_partkey")
    part = read(spark, d, "part")
    name = lambda folder, head, tail: F.concat(F.lit(f"root/{folder}/{head}"), k.cast("string"), F.lit(tail))
    images = part.select(name("images", "p", ".jpg").alias("path"), F.col("p_size").alias("height"), F.lit(640).alias("width"))
    masks = part.where(k % 7 != 0).select(name("masks", "p", ".png").alias("path"), F.when(k % 11 == 0, 0).otherwise(F.col("p_size")).alias("height"), F.lit(640).alias("width"))
    spare = part.where(k % 13 == 0).select(name("masks", "q", ".png").alias("path"), F.lit(1).alias("height"), F.lit(640).alias("width"))
    return D.mask_pairs(images, masks.unionByName(spare))


# --- written and read again ------------------------------------------------------------------------------------------


@query("k2_csv_rows", ctes(DETECTIONS, "SELECT det_id || ',' || cls || ',' || conf || ',\"{\"\"x1\"\":' || x1 || ',\"\"y1\"\":' || y1 || '}\"' line FROM detections"))
def k2(spark, d):
    """Rows as CSV text; a nested cell is its JSON, quoted."""
    rows = detections(spark, d).select("det_id", "cls", "conf", F.struct("x1", "y1").alias("box"))
    return E.csv_lines(rows).select("line")


@query("k14_dataset_stats", ctes(GT, """sp AS (SELECT *, CASE WHEN image_id%10=0 THEN 'val' ELSE 'train' END split FROM gt)""",
    "SELECT split, '{\"split\":\"' || split || '\",\"images\":' || (SELECT count(DISTINCT image_id) FROM sp t WHERE t.split=a.split) || ',\"classes\":[' || string_agg('{\"cls\":' || cls || ',\"n\":' || n || '}', ',' ORDER BY cls) || ']}' stats FROM (SELECT split, cls, count(*) n FROM sp GROUP BY ALL) a GROUP BY split"))
def k14(spark, d):
    """Images and instances a class of each split, as JSON."""
    objects = ground_truth(spark, d).withColumn("split", F.when(F.col("image_id") % 10 == 0, "val").otherwise("train"))
    return E.split_stats(objects)


@query("k15_split_lists", "SELECT CASE WHEN u<9e-1 THEN 'train' ELSE 'val' END split, './images/' || p_partkey || '.jpg' path FROM (SELECT p_partkey, ('0x' || substr(md5(p_partkey::VARCHAR),1,15))::BIGINT%1000000/1e6 u FROM part)")
def k15(spark, d):
    """Lists of the images of each split, written as text and read again."""
    rows = D.weighted_split(read(spark, d, "part").select("p_partkey", F.concat(F.lit("./images/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path")), "p_partkey")
    path = scratch(spark)
    E.write_split_lists(rows, path)
    return spark.read.text(path).select("split", F.col("value").alias("path"))


@query("k12_tuning_log", "SELECT r_regionkey iteration, round(r_regionkey/8e0,4) fitness FROM region UNION ALL SELECT 100+n_nationkey, round(n_nationkey/16e0,4) FROM nation")
def k12(spark, d):
    """Two batches of tuning results appended as JSON lines, read again without blank lines."""
    path = scratch(spark)
    E.append_json_lines(read(spark, d, "region").select(F.col("r_regionkey").alias("iteration"), F.round(F.col("r_regionkey") / 8, 4).alias("fitness")), path)
    E.append_json_lines(read(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("iteration"), F.round(F.col("n_nationkey") / 16, 4).alias("fitness")), path)
    spark.createDataFrame([("",)], "value string").write.mode("append").text(path)
    return E.read_json_lines(spark, path, "iteration int, fitness double")


@query("k16_label_cache", ctes(GT, "SELECT image_id, count(*) n, true fresh FROM gt GROUP BY image_id"))
def k16(spark, d):
    """Labels of images cached with a version and a hash of what they were read from; a stale cache is not served."""
    labels = ground_truth(spark, d).groupBy("image_id").agg(F.count("*").alias("n"))
    path, source = scratch(spark), ground_truth(spark, d).select("gt_id", "image_id")
    E.write_cache(labels, path, source)
    stale = E.read_cache(spark, path, source.where("image_id > 1"))
    return E.read_cache(spark, path, source).withColumn("fresh", F.lit(stale is None))


_NEAREST = """cs AS (SELECT q.vec_id q, v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE*z[2]::DOUBLE))
  /sqrt(list_sum(list_transform(v.embedding, lambda z: z::DOUBLE*z::DOUBLE)))/sqrt(list_sum(list_transform(q.embedding, lambda z: z::DOUBLE*z::DOUBLE))),9) score
  FROM embeddings v JOIN embeddings q ON q.vec_id%100=0 AND v.vec_id<>q.vec_id)"""


@query("x3_index_round_trip", ctes(_NEAREST, "SELECT q, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) rk FROM cs) WHERE rk<=3"))
def x3(spark, d):
    """Unit vectors and their paths written as an index; a stated query set against all of it, three nearest each."""
    path = scratch(spark)
    search.write_index(read(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("images/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("path")), path)
    index = search.read_index(spark, path)
    return search.nearest(index, index.where("vec_id % 100 = 0"), 3).select("q", "vec_id")


@query("s3_listed_sources", """SELECT path, kind FROM (SELECT 'media/' || p_partkey || CASE p_partkey%4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' ELSE '.png' END path,
  CASE p_partkey%4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 3 THEN 'image' END kind FROM part) WHERE kind IS NOT NULL""")  # fmt: skip
def s3(spark, d):
    """A list file with a path a line: images and videos by suffix, all else left out."""
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, ".JPG").when(k % 4 == 1, ".mp4").when(k % 4 == 2, ".txt").otherwise(".png")
    path = scratch(spark)
    read(spark, d, "part").select(F.concat(F.lit(" media/"), k.cast("string"), tail).alias("value")).write.text(path)
    return files.listed(spark, path).select("path", "kind")


@query("m25_heat_over_time", ctes(TRACKS, "SELECT frame_no, x, y, CAST(sum(n) OVER (PARTITION BY x, y ORDER BY frame_no) AS BIGINT) heat FROM (SELECT frame_no, CAST(floor(cx/40) AS INT) x, CAST(floor(cy/40) AS INT) y, count(*) n FROM tracks GROUP BY ALL)"))
def m25(spark, d):
    """How often each cell of 40 pixels has been visited up to each frame that visits it."""
    return cell_series(tracks(spark, d), 40)


@query("u8_pool_merge", ctes(DETECTIONS, """ag AS (SELECT *, CAST(trunc(conf*100) AS INT) age FROM detections),
  tr AS (SELECT * FROM ag WHERE cls=0 UNION ALL SELECT * FROM ag WHERE cls=1 AND conf>5e-1), lo AS (SELECT * FROM ag WHERE cls IN (1,2) AND NOT (cls=1 AND conf>5e-1)),
  cl AS (SELECT a.det_id ta, b.det_id tb, a.age>b.age older FROM tr a JOIN lo b ON a.image_id=b.image_id AND b.x1<a.x2 AND a.x1<b.x2 AND b.y1<a.y2 AND a.y1<b.y2
    AND 1-greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0e0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0e0)/((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0e0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0e0)+1e-7)<15e-2)""",
    "SELECT det_id track_id, 'tracked' pool FROM tr WHERE det_id NOT IN (SELECT ta FROM cl WHERE NOT older) UNION ALL SELECT det_id, 'lost' FROM lo WHERE det_id NOT IN (SELECT tb FROM cl WHERE older)"))
def u8(spark, d):
    """Refound tracks join the tracked ones, leave the lost ones, and near duplicates between the pools go."""
    rows = detections(spark, d).select(F.col("det_id").alias("track_id"), "image_id", "cls", "conf", (F.col("conf") * 100).cast("int").alias("age"), "x1", "y1", "x2", "y2")
    tracked, lost = match.merged_pools(rows.where("cls = 0"), rows.where("cls in (1, 2)"), rows.where("cls = 1 and conf > 5e-1"))
    return tracked.select("track_id", F.lit("tracked").alias("pool")).unionByName(lost.select("track_id", F.lit("lost").alias("pool")))
