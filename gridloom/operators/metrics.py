"""Average precision, curves and the other evaluation metrics, from matched detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of the recall grid of average precision and of the confidence grid of the curves.
GRID, CURVE = 100, 1000


def _running(rows: DataFrame, keys: list[str], bucket: Column, order: list, **values: Column) -> DataFrame:
    """``rows`` with the running sum of each of ``values`` (the row itself included), by ``keys`` and in ``order``.

    ``bucket`` must not fall along ``order``. Sums of buckets come first and then those inside a bucket, so a key that
    holds a third of all rows is still many tasks' work.
    """
    rows = rows.withColumns({"_b": bucket, **{f"_{k}": v for k, v in values.items()}})
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_b").agg(*[F.sum(f"_{k}").alias(f"_s{k}") for k in values])
    sums = sums.select(*keys, "_b", *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_t{k}") for k in values])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_i{k}": F.sum(f"_{k}").over(inside) for k in values}).join(sums, [*keys, "_b"])
    return out.withColumns({k: F.col(f"_i{k}") + F.col(f"_t{k}") for k in values}).drop("_b", *[f"_{p}{k}" for k in values for p in ("", "i", "t")])


def by_confidence(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Running sums by falling confidence, ties by ``det_id``."""
    return _running(rows, keys, F.floor((1 - F.col("conf")) * 4096), [F.desc("conf"), "det_id"], **values)


def cumulative(tp: DataFrame, truths: DataFrame) -> DataFrame:
    """``cls, thr, conf, det_id, ctp, n, n_truth, recall, precision`` by falling confidence."""
    per = truths.groupBy("cls").agg(F.count("*").alias("n_truth"))
    rows = by_confidence(tp, ["cls", "thr"], ctp=F.col("tp").cast("int"), n=F.lit(1))
    return rows.join(F.broadcast(per), "cls").select(  # one row a class
        "cls", "thr", "conf", "det_id", "tp", "ctp", "n", "n_truth",
        (F.col("ctp") / (F.col("n_truth") + 1e-16)).alias("recall"), (F.col("ctp") / F.col("n")).alias("precision"),
    )


def envelope(curve: DataFrame) -> DataFrame:
    """``curve`` with ``envelope``: the best precision from each row on, in two steps as the running sums are."""
    rows = curve.withColumn("_b", F.floor((1 - F.col("conf")) * 4096))
    later = Window.partitionBy("cls", "thr").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    tops = rows.groupBy("cls", "thr", "_b").agg(F.max("precision").alias("_top")).withColumn("_after", F.max("_top").over(later)).drop("_top")
    here = Window.partitionBy("cls", "thr", "_b").orderBy(F.desc("conf"), "det_id").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_here", F.max("precision").over(here)).join(tops, ["cls", "thr", "_b"])
    return rows.withColumn("envelope", F.greatest("_here", F.coalesce("_after", F.lit(0.0)))).drop("_b", "_here", "_after")


def average_precision(hits: DataFrame, truths: DataFrame) -> DataFrame:
    """``cls, thr, ap``: the precision envelope at 101 recalls by linear interpolation, then the trapezoid rule.

    ``hits`` are the true positives of each class and threshold: ``cls, thr, n, total`` with the detections of the class
    down to this one and in all. Precision between two of them only falls, so they tell the whole curve. Those of one
    hundredth of recall become one row (its first and last recall, its best precision) before the curve is put in order,
    so what is ordered has at most 101 rows a class and threshold. Sentinels: precision one at recall zero, and zero
    after the last recall.
    """
    per = truths.groupBy("cls").agg(F.count("*").alias("n_truth"))
    rows = _running(hits, ["cls", "thr"], F.floor(F.col("n") / 65536), ["n"], ctp=F.lit(1)).join(F.broadcast(per), "cls")  # one row a class
    rows = rows.withColumn("recall", F.col("ctp") / (F.col("n_truth") + 1e-16)).withColumn("cell", F.ceil(F.round(F.col("recall") * GRID, 9)))
    cells = rows.groupBy("cls", "thr", "cell").agg(
        F.min("recall").alias("r0"), F.max("recall").alias("r1"), F.max("ctp").alias("ctp"), F.min("n").alias("n0"), F.max("total").alias("total"), F.max(F.col("ctp") / F.col("n")).alias("top")
    )
    order = Window.partitionBy("cls", "thr").orderBy("cell")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    cells = cells.withColumns({"after": F.max("top").over(later), "next_n": F.lead("n0").over(order), "first": F.row_number().over(order)})
    # What a segment ends with at its first recall (hi), and what the next one begins with at its last (lo).
    hi = F.greatest("top", F.coalesce("after", F.lit(0.0)))
    lo = F.when(F.col("after").isNull(), 0.0).otherwise(F.greatest(F.col("ctp") / (F.col("next_n") - 1), F.col("after")))
    start = cells.where("first = 1").select(
        "cls", "thr", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("r0"), F.lit(0.0).alias("r1"), F.lit(1.0).alias("hi"), F.when(F.col("n0") > 1, hi).otherwise(1.0).alias("lo")
    )
    knots = start.unionByName(cells.select("cls", "thr", "cell", "r0", "r1", hi.alias("hi"), lo.alias("lo")))
    order = Window.partitionBy("cls", "thr").orderBy("cell")
    ahead = {"to": F.coalesce(F.lead("cell").over(order) - 1, F.lit(GRID)), "x1": F.coalesce(F.lead("r0").over(order), F.lit(1.0)), "y1": F.coalesce(F.lead("hi").over(order), F.lit(0.0))}
    points = knots.withColumns(ahead).select("cls", "thr", "r1", "lo", "x1", "y1", F.explode(F.sequence("cell", "to")).alias("k"))
    x = F.col("k") / F.lit(float(GRID))
    y = F.when(F.col("x1") > F.col("r1"), F.col("lo") + (F.col("y1") - F.col("lo")) * (x - F.col("r1")) / (F.col("x1") - F.col("r1"))).otherwise(F.col("lo"))
    weight = F.when(F.col("k").isin(0, GRID), 0.5).otherwise(1.0)
    return points.groupBy("cls", "thr").agg((F.sum(y * weight) / GRID).alias("ap"))


def class_ap(dets: DataFrame, matched: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """``cls, thr, ap`` over the classes of the truths; a class without detections has zero.

    ``matched`` has ``det_id`` and the thresholds ``thrs`` at which it is a true positive.
    """
    ranked = by_confidence(dets.select("det_id", "cls", "conf"), ["cls"], n=F.lit(1))
    totals = dets.groupBy("cls").agg(F.count("*").alias("total"))
    hits = ranked.join(matched.select("det_id", "thrs"), "det_id").join(F.broadcast(totals), "cls")  # one row a class
    got = average_precision(hits.select("cls", "n", "total", F.explode("thrs").alias("thr")), truths)
    grid = truths.select("cls").distinct().select("cls", F.explode(F.array(*map(F.lit, thresholds))).alias("thr"))
    return grid.join(got, ["cls", "thr"], "left").select("cls", "thr", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def metric_means(ap: DataFrame) -> DataFrame:
    """``map50, map75, map`` of class APs."""
    at = lambda t: F.avg(F.when(F.abs(F.col("thr") - t) < 1e-9, F.col("ap")))
    return ap.agg(at(0.5).alias("map50"), at(0.75).alias("map75"), F.avg("ap").alias("map"))


def per_image(tp: DataFrame, truths: DataFrame) -> DataFrame:
    """``image_id, tp, fp, fn, precision, recall, f1`` at the first threshold; nothing to find and nothing found is 1."""
    d = tp.where(F.abs(F.col("thr") - 0.5) < 1e-9).groupBy("image_id").agg(F.sum(F.col("tp").cast("long")).alias("tp"), F.count("*").alias("n"))
    g = truths.groupBy("image_id").agg(F.count("*").alias("t"))
    rows = d.join(g, "image_id", "full").fillna(0, ["tp", "n", "t"])
    p = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(F.when(F.col("t") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(F.when(F.col("n") == 0, 1.0).otherwise(0.0))
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, F.col("precision") * 2 * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rows.select("image_id", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), "precision", "recall", f1.alias("f1"))


def curves(tp: DataFrame, truths: DataFrame) -> DataFrame:
    """``cls, k, recall, precision, f1`` at confidences k / 999: linear interpolation over falling confidence.

    The value left of the lowest confidence is the last one; right of the highest, recall is 0 and precision 1.
    """
    w = Window.partitionBy("cls").orderBy("conf")
    at = cumulative(tp.where(F.abs(F.col("thr") - 0.5) < 1e-9), truths)
    # Of equal confidences, a value from below meets the last row and one from above the first.
    knots = at.groupBy("cls", "conf").agg(F.max(F.struct("n", "recall", "precision")).alias("z"), F.min(F.struct("n", "recall", "precision")).alias("a"))
    last = CURVE - 1
    # Between two points of the grid only the first and the last confidence matter.
    cell = F.ceil(F.round(F.col("conf") * last, 9))
    ends = knots.groupBy("cls", cell).agg(*[f(F.struct("conf", "z", "a")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    knots = ends.select("cls", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select("cls", "e.conf", "e.z", "e.a")
    seg = knots.select(
        "cls", "conf", F.lead("conf").over(w).alias("c1"), F.lag("conf").over(w).alias("c0"), F.col("a.recall").alias("r0"), F.col("a.precision").alias("p0"),
        F.col("z.recall").alias("rz"), F.col("z.precision").alias("pz"), F.lead("z").over(w).alias("nx"),
    )
    lo = F.ceil(F.round(F.col("conf") * last, 9))
    hi = F.when(F.col("c1").isNull(), lo).otherwise(F.ceil(F.round(F.col("c1") * last, 9)) - 1)
    x = F.col("k") / F.lit(float(last))
    inner = seg.where("c1 is not null").select("*", F.explode(F.sequence(lo, F.greatest(hi, lo))).alias("k")).where(x < F.col("c1"))
    part = F.when(F.col("c1") > F.col("conf"), (x - F.col("conf")) / (F.col("c1") - F.col("conf")))
    between = lambda low, own, next_: F.when(x == F.col("conf"), F.col(own)).otherwise(F.col(low) + (F.col(next_) - F.col(low)) * part)
    mid = inner.select("cls", "k", between("r0", "rz", "nx.recall").alias("recall"), between("p0", "pz", "nx.precision").alias("precision"))
    below = seg.where("c0 is null").select("cls", "rz", "pz", F.explode(F.sequence(F.lit(0), F.greatest(lo - 1, F.lit(0)))).alias("k"), "conf")
    below = below.where(x < F.col("conf")).select("cls", "k", F.col("rz").alias("recall"), F.col("pz").alias("precision"))
    above = seg.where("c1 is null").select("cls", "rz", "pz", "conf", F.explode(F.sequence(F.least(lo, F.lit(last)), F.lit(last))).alias("k"))
    above = above.where(x >= F.col("conf")).select(
        "cls", "k", F.when(x > F.col("conf"), 0.0).otherwise(F.col("rz")).alias("recall"), F.when(x > F.col("conf"), 1.0).otherwise(F.col("pz")).alias("precision")
    )
    f1 = F.col("precision") * 2 * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-16)
    return mid.unionByName(below).unionByName(above).withColumn("f1", f1)


def smooth(values: DataFrame, column: str, f: float = 0.1, n: int = CURVE, order: str = "k") -> DataFrame:
    """``smoothed``: the box filter of an odd number of points, about ``2 f n``, with both ends repeated."""
    half = (round(n * f * 2) // 2 + 1) // 2
    w = Window.orderBy(order)  # a curve of n points
    around = w.rowsBetween(-half, half)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rn = F.row_number().over(w)
    total = F.count("*").over(Window.partitionBy())
    left, right = F.greatest(F.lit(half) - (rn - 1), F.lit(0)), F.greatest(F.lit(half) - (total - rn), F.lit(0))
    full = F.sum(column).over(around) + left * F.first(column).over(every) + right * F.last(column).over(every)
    return values.withColumn("smoothed", full / (2 * half + 1))


def best_operating_point(curve: DataFrame) -> DataFrame:
    """``cls, k, precision, recall, f1`` of each class at the confidence where the smoothed mean F1 is highest."""
    mean = curve.groupBy("k").agg(F.avg("f1").alias("f1"))
    top = smooth(mean, "f1").orderBy(F.desc("smoothed"), "k").limit(1).select("k")
    return curve.join(F.broadcast(top), "k").select("cls", "k", "precision", "recall", "f1")  # one row


def confusion_scores(cells: DataFrame, n_classes: int) -> DataFrame:
    """``cls, tp, fp`` of a confusion matrix in long form, without the background class."""
    diagonal = F.when(F.col("pred") == F.col("truth"), F.col("n")).otherwise(0)
    return cells.where(F.col("pred") < n_classes).groupBy(F.col("pred").alias("cls")).agg(F.sum(diagonal).alias("tp"), (F.sum("n") - F.sum(diagonal)).alias("fp"))


def normalized(cells: DataFrame) -> DataFrame:
    """Cells as shares of their truth's column."""
    return cells.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("truth")) + 1e-9))


def semantic_scores(hist: DataFrame) -> DataFrame:
    """``cls, iou, acc`` from a histogram ``truth, pred, n`` over classes with truth."""
    tp = hist.where("truth = pred").select(F.col("truth").alias("cls"), F.col("n").alias("tp"))
    row = hist.groupBy(F.col("truth").alias("cls")).agg(F.sum("n").alias("t"))
    col = hist.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("p"))
    rows = row.join(col, "cls", "left").join(tp, "cls", "left").fillna(0, ["p", "tp"])
    return rows.select("cls", (F.col("tp") / (F.col("t") + F.col("p") - F.col("tp"))).alias("iou"), (F.col("tp") / F.col("t")).alias("acc"))


def fitness(map_: Column, map50: Column, precision: Column, recall: Column, weights: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0)) -> Column:
    return precision * weights[0] + recall * weights[1] + map50 * weights[2] + map_ * weights[3]


def sigma_clip(df: DataFrame, column: str, sigmas: float = 2.0, rounds: int = 3, below_only: bool = False) -> DataFrame:
    """Rows within ``sigmas`` population deviations of the mean, again and again; each pass is one two-phase aggregate."""
    for _ in range(rounds):
        stats = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
        df = df.join(F.broadcast(stats), F.lit(True))  # one row
        low = F.col(column) >= F.col("_m") - F.col("_s") * sigmas if below_only else F.abs(F.col(column) - F.col("_m")) < F.col("_s") * sigmas
        df = df.where(low | (F.col("_s") == 0)).drop("_m", "_s")
    return df
