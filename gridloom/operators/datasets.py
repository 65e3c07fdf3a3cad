"""Dataset operators: label validation, conversion, statistics, splits, tiles and the transforms of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import boxes as B


def label_path(image: Column) -> Column:
    """The label file of an image: the last ``/images/`` becomes ``/labels/``, the suffix ``.txt``."""
    return F.regexp_replace(F.regexp_replace(image, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def hash_order(key: Column) -> Column:
    """A fixed shuffle: 60 bits of the key's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def parse_labels(lines: DataFrame, n_classes: int) -> DataFrame:
    """``path, line_no, raw`` as ``cls, xc, yc, w, h, problem``; ``problem`` is null for a sound row.

    Rules in order: five numbers; no value below -0.01; no coordinate above 1.01; a class below ``n_classes``.
    Repeated rows of a file count once (``duplicate`` on all but the first).
    """
    part = F.split(F.trim("raw"), r"\s+")
    rows = lines.withColumn("v", F.transform(part, lambda x: x.try_cast("double")))
    val = [F.try_element_at("v", F.lit(i)) for i in range(1, 6)]
    bad = F.when((F.size("v") != 5) | F.exists("v", lambda x: x.isNull()), "columns")
    bad = bad.when(F.exists("v", lambda x: x < -0.01), "negative").when(F.exists(F.slice("v", 2, 4), lambda x: x > 1.01), "not normalised")
    bad = bad.when(val[0] >= n_classes, "class")
    rows = rows.select("path", "line_no", *[c.alias(n) for c, n in zip(val, ("cls", "xc", "yc", "w", "h"))], bad.alias("problem"))
    w = Window.partitionBy("path", "cls", "xc", "yc", "w", "h").orderBy("line_no")
    again = F.col("problem").isNull() & (F.row_number().over(w) > 1)
    return rows.withColumn("problem", F.when(again, "duplicate").otherwise(F.col("problem")))


def coco_to_labels(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Normalised centre boxes from left-top boxes: crowds, empty boxes and repeats of an image's box go."""
    rows = annotations.where(~F.col("iscrowd")).join(images, "image_id")
    c = B.ltwh2xywh(B.Box(*(F.col(n) for n in ("l", "t", "w", "h"))))
    rows = rows.where("w > 0 and h > 0").select(
        "image_id", "ann_id", "cls", (c.a / F.col("width")).alias("xc"), (c.b / F.col("height")).alias("yc"), (c.c / F.col("width")).alias("wn"), (c.d / F.col("height")).alias("hn")
    )
    w = Window.partitionBy("image_id", "cls", "xc", "yc", "wn", "hn").orderBy("ann_id")
    return rows.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def weighted_split(df: DataFrame, key: str, weights: tuple[float, float, float] = (0.9, 0.1, 0.0)) -> DataFrame:
    """``split`` train, val or test by a fixed hash of the key; no shuffle."""
    u = hash_order(F.col(key)) % 1_000_000 / F.lit(1e6)
    total = sum(weights)
    split = F.when(u < weights[0] / total, "train").when(u < (weights[0] + weights[1]) / total, "val").otherwise("test")
    return df.withColumn("split", split)


def class_split(df: DataFrame, key: str, cls: str, ratio: float = 0.8) -> DataFrame:
    """``split``: of each class, the first int(n * ratio) in hash order are train, the rest val."""
    w = Window.partitionBy(cls)
    rk = F.row_number().over(w.orderBy(hash_order(F.col(key)), key))
    return df.withColumn("split", F.when(rk <= F.floor(F.count("*").over(w) * ratio), "train").otherwise("val"))


def k_folds(df: DataFrame, key: str, k: int, group: str) -> DataFrame:
    """``fold`` 0 to k-1 in hash order within ``group`` (so no task sorts all rows)."""
    w = Window.partitionBy(group).orderBy(hash_order(F.col(key)), key)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)


def contiguous_shards(total: int, ranks: int, batch: int) -> list[tuple[int, int, int]]:
    """``(rank, first, last)``: whole batches to ranks in order, the remainder to the first ones."""
    batches = -(-total // batch)
    per, rest = divmod(batches, ranks)
    out, start = [], 0
    for r in range(ranks):
        n = per + (r < rest)
        out.append((r, min(start * batch, total), min((start + n) * batch, total)))
        start += n
    return out


def class_counts(df: DataFrame, classes: DataFrame) -> DataFrame:
    """``cls, n`` for every class of ``classes``, zero where there is none."""
    return classes.join(df.groupBy("cls").agg(F.count("*").alias("n")), "cls", "left").fillna(0, ["n"])


def class_weights(counts: DataFrame, power: float = 1.0) -> DataFrame:
    """``cls, weight``: counts (zero as one) to the power -``power``, scaled to mean one."""
    raw = F.pow(F.lit(1.0) / F.greatest(F.col("n"), F.lit(1)), F.lit(power))
    rows = counts.withColumn("raw", raw)
    mean = rows.agg(F.avg("raw").alias("mean"))
    return rows.join(F.broadcast(mean), F.lit(True)).select("cls", (F.col("raw") / F.col("mean")).alias("weight"))  # one row


def dataset_statistics(objects: DataFrame, images: DataFrame) -> DataFrame:
    """``split, cls, instances, images``; a null class sums up the split, with its images without labels."""
    per = objects.groupBy("split", "cls").agg(F.count("*").alias("instances"), F.countDistinct("image_id").alias("images"))
    per = per.withColumn("unlabelled", F.lit(None).cast("long"))
    some = objects.select("image_id").distinct().withColumn("has", F.lit(1))
    total = images.join(some, "image_id", "left").groupBy("split").agg(F.count("*").alias("images"), F.count(F.when(F.col("has").isNull(), 1)).alias("unlabelled"))
    n = objects.groupBy("split").agg(F.count("*").alias("instances"))
    whole = total.join(n, "split", "left").fillna(0, ["instances"]).select("split", F.lit(None).cast("int").alias("cls"), "instances", "images", "unlabelled")
    return per.select(whole.columns).unionByName(whole)


def tile_windows(images: DataFrame, crop: int = 1024, gap: int = 200, least: float = 0.6) -> DataFrame:
    """``image_id, x, y, x2, y2``: windows of ``crop`` pixels, ``gap`` overlapping, the last one moved to the edge.

    A window stays if it covers more than ``least`` of itself with image; if none does, those that cover most stay.
    """
    step = crop - gap

    def starts(size: str) -> Column:
        n = F.when(F.col(size) <= crop, 1).otherwise(F.ceil((F.col(size) - crop) / step) + 1)
        raw = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: i * step)
        return F.transform(raw, lambda s: F.when((F.col(size) > crop) & (s + crop > F.col(size)), F.col(size) - crop).otherwise(s).cast("int"))

    rows = images.select("image_id", "width", "height", F.explode(starts("width")).alias("x")).select("*", F.explode(starts("height")).alias("y"))
    rows = rows.withColumn("x2", F.col("x") + crop).withColumn("y2", F.col("y") + crop)
    cover = (F.least("x2", "width") - F.col("x")) * (F.least("y2", "height") - F.col("y")) / F.lit(float(crop * crop))
    rows = rows.withColumn("cover", cover)
    best = F.max("cover").over(Window.partitionBy("image_id"))
    return rows.withColumn("best", best).where((F.col("cover") > least) | ((F.col("best") <= least) & (F.col("cover") == F.col("best")))).select("image_id", "x", "y", "x2", "y2")


def tile_objects(tiles: DataFrame, objects: DataFrame, least: float = 0.7) -> DataFrame:
    """Objects (image_id, obj_id, cls, x1..y2) in the tiles that hold at least ``least`` of their area, in tile coordinates."""
    t = tiles.select(F.col("image_id").alias("t_image"), *[F.col(c).alias(f"t_{c}") for c in ("x", "y", "x2", "y2")])
    tile = B.Box(*(F.col(f"t_{c}").cast("double") for c in ("x", "y", "x2", "y2")))
    on = (F.col("image_id") == F.col("t_image")) & B.overlap(tile, B.box())
    rows = objects.join(t, on).withColumn("iof", B.intersection(tile, B.box()) / B.area(B.box())).where(F.col("iof") >= least)
    size = F.col("t_x2") - F.col("t_x")
    name = F.concat(F.col("image_id").cast("string"), F.lit("__"), size.cast("string"), F.lit("__"), F.col("t_x").cast("string"), F.lit("___"), F.col("t_y").cast("string"))
    return rows.select(
        name.alias("tile"), "obj_id", "cls", *[((F.col(c) - F.col(f"t_{o}")) / size).alias(f"n{c}") for c, o in (("x1", "x"), ("y1", "y"), ("x2", "x"), ("y2", "y"))]
    )


def aspect_batches(images: DataFrame, batch: int, group: str) -> DataFrame:
    """``group, batch, n, rows_h, rows_w``: images of a group in order of height by width, in batches, with each batch's shape."""
    w = Window.partitionBy(group).orderBy("ar", "image_id")
    rows = images.withColumn("ar", F.col("height") / F.col("width")).withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch))
    lo, hi = F.min("ar"), F.max("ar")
    h = F.when(hi < 1, hi).otherwise(F.lit(1.0))
    wd = F.when((hi >= 1) & (lo > 1), F.lit(1.0) / lo).otherwise(F.lit(1.0))
    return rows.groupBy(group, "batch").agg(F.count("*").alias("n"), h.alias("shape_h"), wd.alias("shape_w"))


def unique_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """``unique_name``: the name where it occurs once, else with its occurrence's number."""
    w = Window.partitionBy(name)
    rk = F.row_number().over(w.orderBy(key))
    return df.withColumn("unique_name", F.when(F.count("*").over(w) == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), rk.cast("string"))))


def remap_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``text_id``: the place of each text among the distinct texts, in their order."""
    words = df.select(text).distinct().withColumn("text_id", F.row_number().over(Window.orderBy(text)) - 1)  # a class vocabulary
    return df.join(words, text)


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """``bx, by_, n`` over the columns' own ranges."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    rows = df.join(F.broadcast(ends), F.lit(True))  # one row
    bin_ = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_(x).alias("bx"), bin_(y).alias("by_")).agg(F.count("*").alias("n"))


def consistent_segments(per_image: DataFrame, dataset: str) -> DataFrame:
    """``per_image`` (boxes and segments of each image); a dataset with fewer or more segments than boxes loses them all."""
    totals = per_image.groupBy(dataset).agg((F.sum("boxes") == F.sum("segments")).alias("_same"))
    rows = per_image.join(totals, dataset)
    return rows.withColumn("segments", F.when(F.col("_same"), F.col("segments")).otherwise(0)).drop("_same")


def united_vocabulary(parts: list[DataFrame]) -> DataFrame:
    """``text, text_id``: the texts of all parts, numbered in their order (a vocabulary is ordered in one task)."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    texts = every.where("text is not null").distinct()
    return texts.withColumn("text_id", (F.row_number().over(Window.orderBy("text")) - 1).cast("int"))


def scaled_tile_objects(images: DataFrame, objects: DataFrame, crop: int, gap: int, rates: list[float], least: float = 0.7) -> DataFrame:
    """:func:`tile_objects` over windows of ``crop / rate`` pixels with gaps of ``gap / rate``, for each rate."""
    found = None
    for rate in rates:
        part = tile_objects(tile_windows(images, int(crop / rate), int(gap / rate)), objects, least)
        found = part if found is None else found.unionByName(part)
    return found


def mask_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """``stem, state`` of files ``path, height, width``: ``pair``, ``shapes differ``, ``no mask`` or ``no image``."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    a, b = (f.select(stem.alias("stem"), F.struct("height", "width").alias(n)) for f, n in ((images, "image"), (masks, "mask")))
    state = F.when(F.col("mask").isNull(), "no mask").when(F.col("image").isNull(), "no image").when(F.col("image") != F.col("mask"), "shapes differ").otherwise("pair")
    return a.join(b, "stem", "full").select("stem", state.alias("state"))
