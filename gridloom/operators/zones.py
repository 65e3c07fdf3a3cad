"""Zone, line, speed, repetition and heat analytics over object tracks (``track_id, frame_no, cx, cy, ...``).

Everything is a window over one track or an aggregate per frame, so a long recording spreads over its tracks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import polygons as P


def by_track(order: str = "frame_no") -> Window:
    return Window.partitionBy("track_id").orderBy(order)


def with_previous(tracks: DataFrame) -> DataFrame:
    """``px, py``: the position of the observation before; null at the first."""
    w = by_track()
    return tracks.withColumn("px", F.lag("cx").over(w)).withColumn("py", F.lag("cy").over(w))


def region_counts(tracks: DataFrame, regions: dict[str, P.Points]) -> DataFrame:
    """``frame_no, region, n``: centres strictly inside each region, zero-filled over all frames."""
    flags = [F.count(F.when(P.contains(p, F.col("cx"), F.col("cy"), inclusive=False), 1)).alias(name) for name, p in regions.items()]
    wide = tracks.groupBy("frame_no").agg(*flags)
    return wide.unpivot("frame_no", list(regions), "region", "n")


def inside_regions(tracks: DataFrame, regions: dict[str, P.Points], inclusive: bool = False) -> DataFrame:
    """One row for each track position and region that holds it (a position may lie in several)."""
    names = F.array_compact(F.array(*(F.when(P.contains(p, F.col("cx"), F.col("cy"), inclusive), F.lit(n)) for n, p in regions.items())))
    return tracks.select("*", F.explode(names).alias("region"))


def slot_occupancy(tracks: DataFrame, slots: list[P.Points]) -> DataFrame:
    """``frame_no, filled, available``: slots whose area (boundary included) holds an integer-truncated centre."""
    x, y = F.floor("cx"), F.floor("cy")
    taken = [F.max(P.contains(s, x.cast("double"), y.cast("double"), inclusive=True).cast("int")) for s in slots]
    total = sum(taken[1:], taken[0])
    return tracks.groupBy("frame_no").agg(total.alias("filled")).withColumn("available", F.lit(len(slots)) - F.col("filled"))


def line_counter(tracks: DataFrame, line: P.Points) -> DataFrame:
    """``track_id, frame_no, direction, cls_name``: each track counts once, at its first step that meets the line.

    For a line that is more wide than high, downwards is IN; for another one, rightwards is IN.
    """
    (ax, ay), (bx, by_) = line
    flat = abs(ax - bx) >= abs(ay - by_)
    steps = with_previous(tracks).where("px is not null")
    hit = steps.where(P.crosses((F.col("px"), F.col("py")), (F.col("cx"), F.col("cy")), line))
    first = hit.withColumn("rk", F.row_number().over(by_track())).where("rk = 1")
    ahead = F.col("cy") > F.col("py") if flat else F.col("cx") > F.col("px")
    return first.select("track_id", "frame_no", F.when(ahead, "IN").otherwise("OUT").alias("direction"), "cls_name")


def zone_counter(tracks: DataFrame, zone: P.Points) -> DataFrame:
    """As :func:`line_counter`, for a polygon: a track counts when it is inside and has been seen before.

    The direction compares the position with the oldest of the last five that lay outside (else with the oldest of the
    five), along the zone's longer side.
    """
    w = by_track()
    xs, ys = [p[0] for p in zone], [p[1] for p in zone]
    wide = max(xs) - min(xs) < max(ys) - min(ys)
    inside = P.contains(zone, F.col("cx"), F.col("cy"), inclusive=False)
    seen = tracks.withColumn("inside", inside)
    past = F.collect_list(F.struct("cx", "cy", "inside")).over(w.rowsBetween(-4, 0))
    seen = seen.withColumn("past", past).withColumn("nth", F.row_number().over(w))
    first = seen.where("inside and nth > 1").withColumn("rk", F.row_number().over(w)).where("rk = 1")
    out = F.filter("past", lambda p: ~p["inside"])
    base = F.when(F.size(out) > 0, F.element_at(out, 1)).otherwise(F.element_at("past", 1))
    first = first.withColumn("base", base)
    ahead = F.col("cx") > F.col("base.cx") if wide else F.col("cy") > F.col("base.cy")
    return first.select("track_id", "frame_no", F.when(ahead, "IN").otherwise("OUT").alias("direction"), "cls_name")


def queue_counts(tracks: DataFrame, zone: P.Points) -> DataFrame:
    """``frame_no, n``: tracks inside the zone that were seen before."""
    rows = with_previous(tracks).where("px is not null")
    return rows.where(P.contains(zone, F.col("cx"), F.col("cy"), inclusive=False)).groupBy("frame_no").agg(F.count("*").alias("n"))


def speeds(tracks: DataFrame, fps: float = 30.0, meter_per_pixel: float = 0.05, max_hist: int = 5, most: int = 120) -> DataFrame:
    """``track_id, frame_no, kmh``: the speed between a track's first and ``max_hist``-th observation, fixed from then on."""
    w = by_track()
    rows = tracks.withColumn("nth", F.row_number().over(w)).withColumn("f0", F.first("frame_no").over(w)).withColumn("x0", F.first("cx").over(w)).withColumn("y0", F.first("cy").over(w))
    at = rows.where(F.col("nth") == max_hist)
    dt = (F.col("frame_no") - F.col("f0")) / fps
    dist = F.sqrt((F.col("cx") - F.col("x0")) * (F.col("cx") - F.col("x0")) + (F.col("cy") - F.col("y0")) * (F.col("cy") - F.col("y0"))) * meter_per_pixel
    return at.where(dt > 0).select("track_id", "frame_no", F.least(F.floor(dist / dt * 3.6), F.lit(most)).cast("long").alias("kmh"))


def repetitions(series: DataFrame, angle: str, up: float = 145.0, down: float = 90.0) -> DataFrame:
    """``track_id, reps``: changes from the up stage (angle over ``up``) to the down stage (under ``down``)."""
    w = by_track()
    stage = F.when(F.col(angle) > up, "up").when(F.col(angle) < down, "down")
    rows = series.withColumn("stage", F.last(stage, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.lag("stage").over(w))
    return rows.groupBy("track_id").agg(F.count(F.when((F.col("stage") == "down") & (F.col("before") == "up"), 1)).alias("reps"))


def heat(boxes: DataFrame) -> DataFrame:
    """``x, y, heat``: two for every box whose inscribed disc (integer centre, half the shorter side) holds the pixel.

    A disc is a rise and a fall in each of its pixel rows; these are summed per place, and the running sum along a row
    is spread over the pixels up to the next change. The work grows with the discs' height, not with their area.
    """
    b = {c: F.floor(c).cast("int") for c in ("x1", "y1", "x2", "y2")}
    r = F.floor(F.least(b["x2"] - b["x1"], b["y2"] - b["y1"]) / 2).cast("int")
    discs = boxes.groupBy(F.floor((b["x1"] + b["x2"]) / 2).cast("int").alias("ox"), F.floor((b["y1"] + b["y2"]) / 2).cast("int").alias("oy"), r.alias("r")).agg(F.count("*").alias("n"))
    rows = discs.select("*", F.explode(F.sequence(-F.col("r"), F.col("r"))).alias("dy"))
    half = F.floor(F.sqrt((F.col("r") * F.col("r") - F.col("dy") * F.col("dy")).cast("double"))).cast("int")
    rows = rows.select((F.col("oy") + F.col("dy")).alias("y"), (F.col("ox") - half).alias("lo"), (F.col("ox") + half + 1).alias("hi"), "n")
    steps = rows.select("y", F.inline(F.array(F.struct(F.col("lo").alias("x"), F.col("n").alias("d")), F.struct(F.col("hi").alias("x"), (-F.col("n")).alias("d")))))
    steps = steps.groupBy("y", "x").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("y").orderBy("x")
    runs = steps.select("y", "x", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.lead("x").over(w).alias("to"))
    return runs.where("v > 0 and to is not null").select(F.explode(F.sequence("x", F.col("to") - 1)).alias("x"), "y", (F.col("v") * 2).alias("heat"))


def scaled(df: DataFrame, column: str, out: str, top: float = 255.0) -> DataFrame:
    """``out``: ``column`` between 0 and ``top`` by its least and greatest value (one aggregate, joined back)."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    rows = df.join(F.broadcast(ends), F.lit(True))  # one row
    return rows.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * top).otherwise(0.0)).drop("_lo", "_hi")


def pair_distances(tracks: DataFrame, a: int, b: int) -> DataFrame:
    """``frame_no, distance`` between the integer-truncated centres of two tracks."""
    one = lambda t, s: tracks.where(F.col("track_id") == t).select("frame_no", F.floor("cx").cast("double").alias(f"x{s}"), F.floor("cy").cast("double").alias(f"y{s}"))
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    return one(a, "a").join(one(b, "b"), "frame_no").select("frame_no", F.sqrt(dx * dx + dy * dy).alias("distance"))


def first_alert(counts: DataFrame, records: int = 5) -> DataFrame:
    """The first frame with at least ``records`` objects: an alert is sent once."""
    return counts.where(F.col("n") >= records).agg(F.min("frame_no").alias("frame_no"))


def bearing(tracks: DataFrame, point: tuple[float, float]) -> DataFrame:
    """``distance, degrees`` of the line from a fixed point to each centre."""
    dx, dy = F.col("cx") - float(point[0]), F.col("cy") - float(point[1])
    return tracks.withColumn("distance", F.sqrt(dx * dx + dy * dy)).withColumn("degrees", F.degrees(F.atan2(dy, dx)))


def extrapolated(series: DataFrame, value: str, order: Column | str = "frame_no") -> DataFrame:
    """``next_value``: the value carried on by its last step; the value itself at the first."""
    w = Window.partitionBy("track_id").orderBy(order)
    return series.withColumn("next_value", F.col(value) + F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))


def velocity(tracks: DataFrame, delta: int = 3) -> DataFrame:
    """``vx, vy``: unit step from the latest observation at least ``delta`` frames back, else from the earliest."""
    w = by_track()
    frame = F.struct("cx", "cy")
    back = F.last(frame).over(w.rangeBetween(Window.unboundedPreceding, -delta))
    rows = tracks.withColumn("_b", F.coalesce(back, F.first(frame).over(w)))
    dx, dy = F.col("cx") - F.col("_b.cx"), F.col("cy") - F.col("_b.cy")
    n = F.sqrt(dx * dx + dy * dy) + 1e-6
    return rows.withColumn("vx", dx / n).withColumn("vy", dy / n).drop("_b")


def cell_series(tracks: DataFrame, size: int) -> DataFrame:
    """``frame_no, x, y, heat``: visits of each cell of ``size`` pixels up to each frame that visits it."""
    cells = tracks.groupBy("frame_no", *(F.floor(F.col(c) / size).cast("int").alias(n) for c, n in (("cx", "x"), ("cy", "y")))).agg(F.count("*").alias("n"))
    w = Window.partitionBy("x", "y").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("frame_no", "x", "y", F.sum("n").over(w).alias("heat"))
