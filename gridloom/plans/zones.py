"""Queries of the zone analytics over the derived tracks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.operators import zones as Z
from gridloom.plans.views import DETECTIONS, LINE_H, LINE_V, R1, R2, REGIONS, TRACKS, ctes, detections, tracks

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_IN = {"R1": "(cx>20 AND cx<120 AND cy>140 AND cy<340)", "R2": "(cx>0 AND cx<490 AND cy>180 AND cy<220)"}
_PREV = "pv AS (SELECT *, lag(cx) OVER w px, lag(cy) OVER w py, row_number() OVER w nth FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame_no))"


@query("p6_point_in_polygon", ctes(TRACKS, f"SELECT event_id, {_IN['R1']} r1, {_IN['R2']} r2 FROM tracks"))
def p6(spark, d):
    return tracks(spark, d).select("event_id", *[Z.P.contains(p, F.col("cx"), F.col("cy"), False).alias(n.lower()) for n, p in REGIONS.items()])


@query("p7_point_in_polygon_inclusive", ctes(TRACKS, "SELECT event_id, (cx>=20 AND cx<=120 AND cy>=140 AND cy<=340) r1, (cx>=0 AND cx<=490 AND cy>=180 AND cy<=220) r2 FROM tracks"))
def p7(spark, d):
    return tracks(spark, d).select("event_id", *[Z.P.contains(p, F.col("cx"), F.col("cy"), True).alias(n.lower()) for n, p in REGIONS.items()])


_CROSS = """SELECT event_id, coalesce((d1*d2<0 AND d3*d4<0) OR (d1=0 AND px BETWEEN 0 AND 490 AND py=200) OR (d2=0 AND cx BETWEEN 0 AND 490 AND cy=200)
  OR (d3=0 AND 0 BETWEEN least(px,cx) AND greatest(px,cx) AND 200 BETWEEN least(py,cy) AND greatest(py,cy))
  OR (d4=0 AND 490 BETWEEN least(px,cx) AND greatest(px,cx) AND 200 BETWEEN least(py,cy) AND greatest(py,cy)), false) h FROM (
  SELECT event_id, px, py, cx, cy, sign(49e1*(py-2e2)-0*(px-0)) d1, sign(49e1*(cy-2e2)-0*(cx-0)) d2,
    sign((cx-px)*(2e2-py)-(cy-py)*(0-px)) d3, sign((cx-px)*(2e2-py)-(cy-py)*(49e1-px)) d4 FROM pv)"""


@query("p8_segment_crosses_line", ctes(TRACKS, _PREV, _CROSS))
def p8(spark, d):
    rows = Z.with_previous(tracks(spark, d))
    hit = Z.P.crosses((F.col("px"), F.col("py")), (F.col("cx"), F.col("cy")), LINE_H)
    return rows.select("event_id", F.coalesce(hit, F.lit(False)).alias("h"))


@query("p12_frame_stride", ctes(TRACKS, "SELECT event_id, frame_no FROM tracks WHERE frame_no % 5 = 0"))
def p12(spark, d):
    return tracks(spark, d).where("frame_no % 5 = 0").select("event_id", "frame_no")


@query("p13_region_of_interest", ctes(DETECTIONS, "SELECT det_id FROM detections WHERE (x1+x2)/2>100 AND (x1+x2)/2<400 AND (y1+y2)/2>100 AND (y1+y2)/2<500"))
def p13(spark, d):
    """Detections whose centre lies in the region (their pixels outside it are not at hand)."""
    roi = [(100, 100), (400, 100), (400, 500), (100, 500)]
    c = Z.P.contains(roi, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, False)
    return detections(spark, d).where(c).select("det_id")


@query("p14_threshold_alert", ctes(TRACKS, "SELECT min(frame_no) frame_no FROM (SELECT frame_no, count(*) n FROM tracks GROUP BY frame_no) WHERE n>=5"))
def p14(spark, d):
    return Z.first_alert(tracks(spark, d).groupBy("frame_no").agg(F.count("*").alias("n")), 5)


QUERIES["m26_alert_latch"], ORACLES["m26_alert_latch"] = p14, ORACLES["p14_threshold_alert"]


@query("j23_region_join", ctes(TRACKS, f"SELECT event_id, 'R1' region FROM tracks WHERE {_IN['R1']} UNION ALL SELECT event_id, 'R2' FROM tracks WHERE {_IN['R2']}"))
def j23(spark, d):
    return Z.inside_regions(tracks(spark, d), REGIONS).select("event_id", "region")


@query("a28_region_counts", ctes(TRACKS, f"SELECT frame_no, 'R1' region, count(*) FILTER ({_IN['R1']}) n FROM tracks GROUP BY frame_no UNION ALL SELECT frame_no, 'R2', count(*) FILTER ({_IN['R2']}) FROM tracks GROUP BY frame_no"))
def a28(spark, d):
    return Z.region_counts(tracks(spark, d), REGIONS)


SLOTS = [[(x, y), (x + 40, y), (x + 40, y + 40), (x, y + 40)] for y in range(0, 400, 80) for x in range(0, 480, 80)]
_slot = "sl AS (SELECT x*80 sx, y*80 sy FROM (SELECT unnest(range(6)) x), (SELECT unnest(range(5)) y))"


@query("a29_slot_occupancy", ctes(TRACKS, _slot, "fr AS (SELECT DISTINCT frame_no FROM tracks)", "oc AS (SELECT frame_no, count(*) n FROM (SELECT DISTINCT frame_no, sx, sy FROM tracks JOIN sl ON floor(cx) BETWEEN sx AND sx+40 AND floor(cy) BETWEEN sy AND sy+40) GROUP BY frame_no)",
    "SELECT fr.frame_no, CAST(coalesce(n,0) AS INT) filled, CAST(30-coalesce(n,0) AS INT) available FROM fr LEFT JOIN oc USING (frame_no)"))
def a29(spark, d):
    return Z.slot_occupancy(tracks(spark, d), SLOTS)


@query("j24_slot_semi_join", ctes(TRACKS, _slot, "SELECT DISTINCT CAST(sx AS INT) sx, CAST(sy AS INT) sy FROM sl JOIN tracks ON floor(cx) BETWEEN sx AND sx+40 AND floor(cy) BETWEEN sy AND sy+40"))
def j24(spark, d):
    slots = spark.createDataFrame([s[0] for s in SLOTS], "sx int, sy int")
    x, y = F.floor("cx"), F.floor("cy")
    # The slot's cell of the 80-pixel grid is an equality, so this semi join is a hash join.
    on = (F.floor(x / 80) * 80 == F.col("sx")) & (F.floor(y / 80) * 80 == F.col("sy")) & (x <= F.col("sx") + 40) & (y <= F.col("sy") + 40)
    return slots.join(tracks(spark, d), on, "left_semi")


@query("w6_previous_position", ctes(TRACKS, _PREV, "SELECT event_id, px, py FROM pv"))
def w6(spark, d):
    return Z.with_previous(tracks(spark, d)).select("event_id", "px", "py")


@query("w7_last_30_history", ctes(TRACKS, "SELECT event_id, count(*) OVER w n, round(avg(cx) OVER w,6) mx FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"))
def w7(spark, d):
    w = Z.by_track().rowsBetween(-29, 0)
    rows = tracks(spark, d).withColumn("path", F.collect_list("cx").over(w))
    return rows.select("event_id", F.size("path").cast("long").alias("n"), F.round(F.aggregate("path", F.lit(0.0), lambda a, x: a + x) / F.size("path"), 6).alias("mx"))


@query("w9_first_event", ctes(TRACKS, f"SELECT track_id, min(frame_no) frame_no FROM tracks WHERE {_IN['R2']} GROUP BY track_id"))
def w9(spark, d):
    return Z.inside_regions(tracks(spark, d), {"R2": R2}).groupBy("track_id").agg(F.min("frame_no").alias("frame_no"))


@query("m20_line_counter", ctes(TRACKS, _PREV, "SELECT track_id, frame_no, CASE WHEN cy>py THEN 'IN' ELSE 'OUT' END direction, cls_name FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) rk FROM pv WHERE px IS NOT NULL AND least(py,cy)<=200 AND greatest(py,cy)>=200 AND (CASE WHEN py=cy THEN least(px,cx)<=490 AND greatest(px,cx)>=0 ELSE px+(cx-px)*(200-py)/(cy-py) BETWEEN 0 AND 490 END)) WHERE rk=1"))
def m20(spark, d):
    return Z.line_counter(tracks(spark, d), LINE_H)


@query("m20_vertical_line_counter", ctes(TRACKS, _PREV, "SELECT track_id, frame_no, CASE WHEN cx>px THEN 'IN' ELSE 'OUT' END direction, cls_name FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) rk FROM pv WHERE px IS NOT NULL AND least(px,cx)<=30 AND greatest(px,cx)>=30) WHERE rk=1"))
def m20v(spark, d):
    return Z.line_counter(tracks(spark, d), LINE_V)


_ZONE = f"""zn AS (SELECT *, {_IN['R1']} ins, row_number() OVER w nth FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame_no)),
  zp AS (SELECT *, list({{'x': cx, 'i': ins}}) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) past FROM zn),
  z1 AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) rk FROM zp WHERE ins AND nth>1)"""


@query("m20_zone_counter", ctes(TRACKS, _ZONE, "SELECT track_id, frame_no, CASE WHEN cx > coalesce(list_filter(past, lambda p: NOT p.i)[1].x, past[1].x) THEN 'IN' ELSE 'OUT' END direction, cls_name FROM z1 WHERE rk=1"))
def m20z(spark, d):
    return Z.zone_counter(tracks(spark, d), R1)


@query("m21_queue_counts", ctes(TRACKS, _PREV, f"SELECT frame_no, count(*) n FROM pv WHERE px IS NOT NULL AND {_IN['R2']} GROUP BY frame_no"))
def m21(spark, d):
    return Z.queue_counts(tracks(spark, d), R2)


@query("w10_speed", ctes(TRACKS, "sp AS (SELECT *, row_number() OVER w nth, first_value(frame_no) OVER w f0, first_value(cx) OVER w x0, first_value(cy) OVER w y0 FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY frame_no))",
    "SELECT track_id, frame_no, CAST(least(floor(sqrt((cx-x0)*(cx-x0)+(cy-y0)*(cy-y0))*5e-2/((frame_no-f0)/3e1)*3.6e0),120) AS BIGINT) kmh FROM sp WHERE nth=5"))
def w10(spark, d):
    return Z.speeds(tracks(spark, d))


QUERIES["m22_speed"], ORACLES["m22_speed"] = w10, ORACLES["w10_speed"]


@query("w11_repetitions", ctes(TRACKS, """st AS (SELECT *, last_value(CASE WHEN cx>145 THEN 'up' WHEN cx<90 THEN 'down' END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) stage FROM tracks)""",
    "SELECT track_id, count(*) FILTER (stage='down' AND before='up') reps FROM (SELECT *, lag(stage) OVER (PARTITION BY track_id ORDER BY frame_no) before FROM st) GROUP BY track_id"))
def w11(spark, d):
    return Z.repetitions(tracks(spark, d), "cx")


QUERIES["m23_workout_reps"], ORACLES["m23_workout_reps"] = w11, ORACLES["w11_repetitions"]


@query("w12_sampled_series", ctes(TRACKS, "SELECT frame_no, cls_name, n FROM (SELECT *, row_number() OVER (PARTITION BY cls_name ORDER BY frame_no DESC) rk FROM (SELECT frame_no, cls_name, count(*) n FROM tracks WHERE frame_no%30=0 GROUP BY ALL)) WHERE rk<=45"))
def w12(spark, d):
    rows = tracks(spark, d).where("frame_no % 30 = 0").groupBy("frame_no", "cls_name").agg(F.count("*").alias("n"))
    w = Z.Window.partitionBy("cls_name").orderBy(F.desc("frame_no"))
    return rows.withColumn("rk", F.row_number().over(w)).where("rk <= 45").drop("rk")


@query("w13_score_extrapolation", ctes(TRACKS, _PREV, "SELECT event_id, cx+coalesce(cx-px,0) next_value FROM pv"))
def w13(spark, d):
    return Z.extrapolated(tracks(spark, d), "cx").select("event_id", "next_value")


@query("w14_velocity", ctes(TRACKS, """vl AS (SELECT *, coalesce(last_value(cx) OVER b, first_value(cx) OVER w) bx0, coalesce(last_value(cy) OVER b, first_value(cy) OVER w) by0 FROM tracks
  WINDOW w AS (PARTITION BY track_id ORDER BY frame_no), b AS (PARTITION BY track_id ORDER BY frame_no RANGE BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING))""",
    "SELECT event_id, round((cx-bx0)/(sqrt((cx-bx0)*(cx-bx0)+(cy-by0)*(cy-by0))+1e-6),6) vx, round((cy-by0)/(sqrt((cx-bx0)*(cx-bx0)+(cy-by0)*(cy-by0))+1e-6),6) vy FROM vl"))
def w14(spark, d):
    return Z.velocity(tracks(spark, d)).select("event_id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


@query("a27_frame_class_counts", ctes(TRACKS, "SELECT frame_no, cls_name, count(*) n FROM tracks GROUP BY ALL"))
def a27(spark, d):
    return tracks(spark, d).groupBy("frame_no", "cls_name").agg(F.count("*").alias("n"))


_HEAT = """ds AS (SELECT (x1::BIGINT+x2::BIGINT)//2 ox, (y1::BIGINT+y2::BIGINT)//2 oy, least(x2::BIGINT-x1::BIGINT, y2::BIGINT-y1::BIGINT)//2 r, count(*) n FROM detections GROUP BY ALL),
  ht AS (SELECT ox+dx x, oy+dy y, (sum(n)*2)::BIGINT heat FROM ds, (SELECT unnest(range(-60,61)) dx), (SELECT unnest(range(-60,61)) dy) WHERE abs(dx)<=r AND abs(dy)<=r AND dx*dx+dy*dy<=r*r GROUP BY ALL)"""


@query("a30_heatmap", ctes(DETECTIONS, _HEAT, "SELECT CAST(x AS INT) x, CAST(y AS INT) y, heat FROM ht"))
def a30(spark, d):
    return Z.heat(detections(spark, d))




@query("a31_minmax_scale", ctes(DETECTIONS, _HEAT, "SELECT CAST(x AS INT) x, CAST(y AS INT) y, round((heat-lo)/(hi-lo)::DOUBLE*255,4) v FROM ht, (SELECT min(heat) lo, max(heat) hi FROM ht)"))
def a31(spark, d):
    return Z.scaled(Z.heat(detections(spark, d)), "heat", "v").select("x", "y", F.round("v", 4).alias("v"))


@query("m24_pair_distance", ctes(TRACKS, "SELECT a.frame_no, round(sqrt((floor(a.cx)-floor(b.cx))*(floor(a.cx)-floor(b.cx))+(floor(a.cy)-floor(b.cy))*(floor(a.cy)-floor(b.cy))),6) distance FROM tracks a JOIN tracks b ON a.frame_no=b.frame_no AND a.track_id=5 AND b.track_id=7"))
def m24(spark, d):
    return Z.pair_distances(tracks(spark, d), 5, 7).select("frame_no", F.round("distance", 6).alias("distance"))


@query("m27_crop_counter", ctes(TRACKS, "SELECT event_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) nth FROM tracks"))
def m27(spark, d):
    return tracks(spark, d).select("event_id", F.row_number().over(Z.by_track()).cast("long").alias("nth"))


@query("m28_vision_mapping", ctes(TRACKS, f"SELECT event_id, round(sqrt((cx-20)*(cx-20)+(cy-20)*(cy-20)),6) distance, round(atan2(cy-20,cx-20)*180/{math.pi!r},6) degrees FROM tracks"))
def m28(spark, d):
    return Z.bearing(tracks(spark, d), (20, 20)).select("event_id", F.round("distance", 6).alias("distance"), F.round("degrees", 6).alias("degrees"))
