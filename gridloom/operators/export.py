"""Results as rows and files: detection records, label text, prediction JSON, run-length masks, run logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import boxes as B


def detection_rows(dets: DataFrame, names: DataFrame, width: float | None = None, height: float | None = None, decimals: int = 5) -> DataFrame:
    """``det_id, name, class, confidence, box``; divided by width and height if they are given."""
    b = B.box()
    if width:
        b = B.Box(b.a / width, b.b / height, b.c / width, b.d / height)
    box = F.struct(*[F.round(v, decimals).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"))])
    return dets.join(F.broadcast(names), "cls").select("det_id", "name", F.col("cls").alias("class"), F.round("conf", decimals).alias("confidence"), box.alias("box"))  # a class vocabulary


def label_text(dets: DataFrame, width: float, height: float, with_conf: bool = True, digits: int = 6) -> DataFrame:
    """``image_id, line``: class, normalised centre and size, confidence, with six digits."""
    fmt = f"%.{digits}f"
    c = B.xyxy2xywhn(B.box(), width, height)
    cols = [F.col("cls").cast("string"), *[F.format_string(fmt, v) for v in c]]
    if with_conf:
        cols.append(F.format_string(fmt, "conf"))
    return dets.select("image_id", "det_id", F.concat_ws(" ", *cols).alias("line"))


def prediction_json(dets: DataFrame) -> DataFrame:
    """``det_id, record``: a JSON record with the box as left, top, width, height (3 digits) and the score (5)."""
    l, t, w, h = B.xyxy2ltwh(B.box())
    box = F.array(*[F.round(v, 3) for v in (l, t, w, h)])
    return dets.select("det_id", F.to_json(F.struct("image_id", F.col("cls").alias("category_id"), box.alias("bbox"), F.round("conf", 5).alias("score"))).alias("record"))


def run_lengths(pixels: DataFrame, size: int) -> DataFrame:
    """``mask_id, counts``: runs of a mask of ``size`` places from its set places (``mask_id, place``), background first."""
    w = Window.partitionBy("mask_id").orderBy("place")
    rows = pixels.withColumn("island", F.col("place") - F.row_number().over(w))
    runs = rows.groupBy("mask_id", "island").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    before = F.lag("hi").over(Window.partitionBy("mask_id").orderBy("lo"))
    runs = runs.withColumn("gap", F.col("lo") - F.coalesce(before, F.lit(-1)) - 1)
    items = F.array_sort(F.collect_list(F.struct("lo", "gap", (F.col("hi") - F.col("lo") + 1).alias("n"))))
    flat = F.flatten(F.transform("items", lambda r: F.array(r["gap"], r["n"])))
    tail = F.lit(size) - F.col("last") - 1
    return runs.groupBy("mask_id").agg(items.alias("items"), F.max("hi").alias("last")).select(
        "mask_id", F.when(tail > 0, F.concat(flat, F.array(tail))).otherwise(flat).alias("counts")
    )


@F.pandas_udf(T.StringType())
def rle_string(counts: pd.Series) -> pd.Series:
    """The compact text of run lengths: from the fourth on the difference to the one two before, in 5-bit groups.

    Groups come from the lowest bits up, 32 more where another follows; the last one is the first whose rest is its sign.
    """

    def text(runs: list[int] | None) -> str | None:
        if runs is None:
            return None
        out = []
        for i, n in enumerate(runs):
            x = int(n) - (int(runs[i - 2]) if i > 2 else 0)
            while True:
                group, x = x & 31, x >> 5
                last = x == (-1 if group & 16 else 0)
                out.append(chr(48 + group + (0 if last else 32)))
                if last:
                    break
        return "".join(out)

    return counts.map(text)


def class_summary(dets: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``key, summary``: text such as ``2 persons, 1 car, `` in order of class."""
    per = dets.groupBy(key, "cls").agg(F.count("*").alias("n")).join(F.broadcast(names), "cls")  # a class vocabulary
    text = F.concat(F.col("n").cast("string"), F.lit(" "), "name", F.when(F.col("n") > 1, "s").otherwise(""), F.lit(", "))
    items = F.array_sort(F.collect_list(F.struct("cls", text.alias("t"))))
    return per.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t"]), "").alias("summary"))


def run_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """Metric rows added to a CSV folder with a header in each file."""
    df.write.mode(mode).option("header", True).csv(path)


def write_label_files(dets: DataFrame, path: str, width: float, height: float) -> None:
    """Label text, one folder an image."""
    label_text(dets, width, height).select("image_id", "line").write.mode("overwrite").partitionBy("image_id").text(path)


def write_split_lists(df: DataFrame, path: str, name: str = "path") -> None:
    df.select("split", F.col(name).cast("string")).write.mode("overwrite").partitionBy("split").text(path)


def sliced(df: DataFrame, group: str, order: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """The rows of each ``group`` that a slice of its rows in ``order`` takes; negative ends count from the last one."""
    w = Window.partitionBy(group)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    end = lambda v: F.lit(v) if v >= 0 else F.greatest(F.col("_n") + v, F.lit(0))
    first = end(start or 0)
    rows = rows.where((F.col("_i") >= first) & ((F.col("_i") - first) % step == 0))
    return (rows if stop is None else rows.where(F.col("_i") < end(stop))).drop("_i", "_n")


def semantic_rows(pixels: DataFrame, names: DataFrame, size: int, decimals: int = 5) -> DataFrame:
    """``image_id, name, class, pixel_ratio`` of class maps of ``size`` pixels (``image_id, place, cls``)."""
    per = pixels.groupBy("image_id", "cls").agg(F.round(F.count("*") / size, decimals).alias("pixel_ratio"))
    return per.join(F.broadcast(names), "cls").select("image_id", "name", F.col("cls").alias("class"), "pixel_ratio")  # a class vocabulary


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: the rows as CSV text; cells that are nested become their JSON."""
    nested = ("struct", "array", "map")
    cells = [F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_csv(F.struct(*cells), {"escape": '"'}).alias("line"))


def split_stats(objects: DataFrame) -> DataFrame:
    """``split, stats``: images and instances of each class of a split, as JSON."""
    per = objects.groupBy("split", "cls").agg(F.count("*").alias("n"))
    classes = per.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("classes"))  # a class vocabulary
    images = objects.groupBy("split").agg(F.countDistinct("image_id").alias("images"))
    return images.join(classes, "split").select("split", F.to_json(F.struct("split", "images", "classes")).alias("stats"))


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


#: Version of written caches; others are not served.
CACHE_VERSION = "1"


def source_hash(source: DataFrame) -> tuple[str, int]:
    """What a cache was read from: a sum of row hashes that does not depend on their order, and their number."""
    h = F.xxhash64(*source.columns)
    row = source.agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"), F.count("*").alias("n")).first()
    return f"{row['x']}:{row['s']}", row["n"]


def write_cache(df: DataFrame, path: str, source: DataFrame) -> None:
    """``df`` with the cache's version and the hash of its source."""
    digest, _ = source_hash(source)
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(CACHE_VERSION, digest)], "version string, hash string").write.mode("overwrite").parquet(f"{path}/head")


def read_cache(spark: SparkSession, path: str, source: DataFrame) -> DataFrame | None:
    """The rows of a cache; None if it is of another version or its source has changed."""
    head = spark.read.parquet(f"{path}/head").first()
    fresh = head["version"] == CACHE_VERSION and head["hash"] == source_hash(source)[0]
    return spark.read.parquet(f"{path}/rows") if fresh else None
