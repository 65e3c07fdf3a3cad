"""Detections, ground truth and tracks derived from the star-schema tables, and the same views as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``det_id, image_id, cls, conf, x1, y1, x2, y2``: an image a part, an object a line item.

    ``det_id`` is made of the row's own keys, so no global sort numbers the rows.
    """
    li = read(spark, sf_dir, "lineitem")
    slot, o, s, n = F.col("l_orderkey") % 12, F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x1 = o % 4 * 160 + s % 25
    y1 = F.floor(slot / 4) * 200 + (s * 7 + n) % 25
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")
    key = F.concat_ws(",", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), cents)
    return li.select(
        F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("det_id"),
        F.col("l_partkey").alias("image_id"),
        (F.when(n == 7, slot + 1).otherwise(slot) % 5).cast("int").alias("cls"),
        ((o * 31 + n * 17 + s * 7) % 1000 / F.lit(1000.0)).alias("conf"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 80 + F.col("l_quantity").cast("long") % 30).cast("double").alias("x2"), (y1 + 90 + o % 17).cast("double").alias("y2"),
    )


DETECTIONS = """detections AS (
  SELECT ('0x' || substr(md5(concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice*100)::BIGINT)), 1, 15))::BIGINT AS det_id,
         l_partkey AS image_id, CAST((CASE WHEN l_linenumber=7 THEN slot+1 ELSE slot END)%5 AS INT) AS cls,
         ((l_orderkey*31+l_linenumber*17+l_suppkey*7)%1000)/CAST(1000 AS DOUBLE) AS conf,
         CAST(ox+dx AS DOUBLE) x1, CAST(oy+dy AS DOUBLE) y1, CAST(ox+dx+w AS DOUBLE) x2, CAST(oy+dy+h AS DOUBLE) y2
  FROM (SELECT *, l_orderkey%12 AS slot, (l_orderkey%4)*160 AS ox, CAST(FLOOR((l_orderkey%12)/4) AS BIGINT)*200 AS oy,
               l_suppkey%25 AS dx, (l_suppkey*7+l_linenumber)%25 AS dy,
               80+CAST(l_quantity AS BIGINT)%30 AS w, 90+l_orderkey%17 AS h FROM lineitem) t)"""


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gt_id, image_id, cls, x1, y1, x2, y2``: up to twelve objects a part on a 4 x 3 grid.

    Spark takes the size of the parts' keys for that of the objects, so the hint keeps joins from broadcasting them.
    """
    p = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("slot"))
    x, y = F.col("slot") % 4 * 160, F.floor(F.col("slot") / 4) * 200
    return p.where((F.col("p_partkey") + F.col("slot")) % 3 != 0).select(
        (F.col("p_partkey") * 12 + F.col("slot")).alias("gt_id"), F.col("p_partkey").alias("image_id"), (F.col("slot") % 5).alias("cls"),
        (x + 12).cast("double").alias("x1"), (y + 12).cast("double").alias("y1"), (x + 107).cast("double").alias("x2"), (y + 110).cast("double").alias("y2"),
    ).hint("merge")


GT = """gt AS (
  SELECT p_partkey*12+slot AS gt_id, p_partkey AS image_id, CAST(slot%5 AS INT) AS cls,
         CAST((slot%4)*160+12 AS DOUBLE) x1, CAST(CAST(FLOOR(slot/4) AS BIGINT)*200+12 AS DOUBLE) y1,
         CAST((slot%4)*160+107 AS DOUBLE) x2, CAST(CAST(FLOOR(slot/4) AS BIGINT)*200+110 AS DOUBLE) y2
  FROM part CROSS JOIN (SELECT unnest(range(12)) AS slot) s WHERE (p_partkey+slot)%3<>0)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track_id, frame_no, event_id, cls_name, cx, cy``: the first event of a user in an hour."""
    ev = read(spark, sf_dir, "events")
    frame = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 3600)
    row = F.struct(
        "ts", "event_id", F.col("event_type").alias("cls_name"), F.col("value").alias("cx"),
        (F.get_json_object("props", "$.k").cast("double") * 4).alias("cy"),
    )
    first = ev.groupBy(F.col("user_id").alias("track_id"), frame.alias("frame_no")).agg(F.min(row).alias("r"))
    return first.select("track_id", "frame_no", "r.event_id", "r.cls_name", "r.cx", "r.cy")


TRACKS = """tracks AS (
  SELECT track_id, frame_no, event_id, cls_name, cx, cy FROM (
    SELECT *, row_number() OVER (PARTITION BY track_id,frame_no ORDER BY ts,event_id) rn FROM (
      SELECT event_id, user_id track_id, event_type cls_name, ts, value cx,
             CAST(FLOOR(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts))/3600) AS BIGINT) frame_no,
             CAST(json_extract_string(props,'$.k') AS DOUBLE)*4 AS cy FROM events) e) z WHERE rn=1)"""


#: Zones over the tracks' plane (fixed test shapes).
R1 = [(20, 140), (120, 140), (120, 340), (20, 340)]
R2 = [(0, 180), (490, 180), (490, 220), (0, 220)]
REGIONS = {"R1": R1, "R2": R2}
LINE_H = [(0, 200), (490, 200)]
LINE_V = [(30, 0), (30, 400)]


def ctes(*parts: str) -> str:
    """``WITH`` over common table expressions; the last part is the query."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
