"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in an order that depends on their ids alone and cut into blocks of equal numbers of
words; a source that is wanted more than once runs on into another copy of the same order. The mix is a row of slots,
one block each. Slot i gets the i-th van der Corput point, which the cumulative target weights map to a source, and
the slots of a source are ranked: the k-th takes the source's k-th block. Slots beyond a source's target go, in order,
to the sources that are still short, and a source's last block is cut at its target, so each source is met exactly.

Running sums are taken in two steps (sums of small id-hash buckets, then within a bucket), so a source with a third of
all rows is still spread over all tasks.

Defined cases: a null text has size 0 and nothing is taken of it; a null source is a source of its own, ordered last;
a source without words has target 0; rows that repeat an id count one by one and are told apart by a number (``copy``,
in order of source, size and text); extra columns are ignored; an empty table gives an empty result. Sources are names,
so their table (a row each) is put in order in one task; 100,000 of them are no burden, one source a document would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, release, shared_dir, stored

#: Bits of a van der Corput point: slot numbers below 2 ** POINT_BITS.
POINT_BITS = 40
#: Hex digits of the id hash that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], most: int = 3) -> DataFrame:
    """``(source, source_size, target, quota)``, one row for each source.

    Sources by code point (null last) weigh ``weights`` in turn. With r = most * size / weight, the sources of small r
    stop at ``most * size``; the rest share what is left by weight, at the level found by running sums in order of r.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("place", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    order = Window.orderBy("ratio", "place")
    src = src.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    src = src.withColumn("done", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "done_weight", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    src = src.fillna(0, ["done", "done_weight"])
    # The level if this source and all of larger ratio shared the rest; the first one that it does not exceed counts.
    src = src.withColumn("level", (F.col("all_size") - F.col("done")) / (F.col("all_weight") - F.col("done_weight")))
    src = src.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    )
    src = src.withColumn("target", target)
    return src.select("source", "place", "source_size", "cap", "target", F.least("cap", F.floor(F.col("target") + 0.5)).alias("quota"))


def van_der_corput(i: Column) -> Column:
    """The bits of ``i`` mirrored, as an integer below 2 ** POINT_BITS."""
    return F.conv(F.reverse(F.lpad(F.bin(i), POINT_BITS, "0")), 2, 10).cast("long")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``_copy``: 1, or where an id repeats the place of the row among those of its id."""
    again = docs.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_col).alias("_again"))
    if again.isEmpty():
        return docs.withColumn("_copy", F.lit(1))
    marked = docs.join(again, docs[id_col].eqNullSafe(again["_again"]), "left_semi")
    alone = docs.join(again, docs[id_col].eqNullSafe(again["_again"]), "left_anti").withColumn("_copy", F.lit(1))
    order = Window.partitionBy(id_col).orderBy(source_col, F.length(text_col), F.xxhash64(text_col))
    return alone.unionByName(marked.withColumn("_copy", F.row_number().over(order)))


def _running(rows: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its ``group`` in order of ``(bucket, key)``."""
    sums = rows.groupBy(*group, "bucket").agg(F.sum(value).alias("_s"))
    before = sums.withColumn(
        "_before", F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_s")
    inside = Window.partitionBy(*group, "bucket").orderBy("key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return part.join(before, [*group, "bucket"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def schedule(targets: DataFrame, block: int, path: str) -> DataFrame:
    """``(slot, place, rank)``: the slots of the mix, the source of each and which of its blocks it takes."""
    spark = targets.sparkSession
    need = targets.where("quota > 0").select("place", "target", F.ceil(F.col("quota") / block).alias("blocks"))
    total = need.agg(F.sum("blocks"), F.count("*"), F.sum("target")).first()
    if not total[0]:
        return spark.createDataFrame([], "slot long, place int, rank long")
    n, n_sources, weight = total
    cells = 1 << (4 * n_sources).bit_length()
    w = Window.orderBy("place")
    upto = F.sum("target").over(w) / F.lit(weight)
    cum = need.withColumn("hi", F.round(upto * (1 << POINT_BITS)).cast("long"))
    cum = cum.withColumn("lo", F.lag("hi", 1, 0).over(w)).withColumn("hi", F.when(F.lead("place").over(w).isNull(), 1 << POINT_BITS).otherwise(F.col("hi")))
    width = (1 << POINT_BITS) // cells
    ranges = cum.where("hi > lo").select(
        "place", "lo", "hi", "blocks", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell")
    )
    points = spark.range(n).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width)).withColumn("bucket", F.floor(F.col("slot") / 4096))
    drawn = stored(
        points.join(ranges, "cell").where("point >= lo and point < hi").select("slot", "bucket", "place", "blocks"), f"{path}/drawn"
    )
    drawn = drawn.select("*", F.col("slot").alias("key"), F.col("slot").alias("doc_id"), F.lit(1).alias("copy"), F.lit(1).cast("long").alias("size"))
    ranked = stored(_running(drawn, ["place"], "size", "rank").select("slot", "bucket", "place", "rank", "blocks"), f"{path}/ranked")
    fits = ranked.where("rank < blocks").select("slot", "place", "rank")
    # Surplus slots, numbered in order, meet the missing blocks, numbered by source: as many of the one as of the other.
    over = ranked.where("rank >= blocks").select(
        "slot", "bucket", F.lit(0).alias("g"), F.col("slot").alias("key"), F.col("slot").alias("doc_id"), F.lit(1).alias("copy"), F.lit(1).cast("long").alias("size")
    )
    over = _running(over, ["g"], "size", "no").select("slot", "no")
    got = fits.groupBy("place").count()
    short = need.join(got, "place", "left").fillna(0, ["count"]).where("count < blocks")
    miss = short.withColumn("from", F.coalesce(F.sum(F.col("blocks") - F.col("count")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    miss = miss.select("place", "from", "count", F.explode(F.sequence(F.col("count"), F.col("blocks") - 1)).alias("rank"))
    filled = over.join(miss.select((F.col("from") + F.col("rank") - F.col("count")).alias("no"), "place", "rank"), "no")
    return fits.unionByName(filled.select("slot", "place", "rank"))


def mix_sources(
    docs: DataFrame,
    weights: list[int],
    most: int = 3,
    block: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    path: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables: ``(documents, targets, pieces)``.

    ``documents``: doc_id, copy, source, size; ``targets``: see :func:`source_targets`; ``pieces``: slot, doc_id, copy,
    ``from_word`` and ``to_word`` - the words of a document that the slot takes, in the order of the mix.
    """
    path = path or shared_dir(docs.sparkSession)
    doc_id = F.col(id_col).cast("long")
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    rows = stored(
        numbered(docs.select(id_col, text_col, source_col), id_col, text_col, source_col).select(
            doc_id.alias("doc_id"),
            F.col("_copy").alias("copy"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            digest.alias("key"),
            F.substring(digest, 1, BUCKET_DIGITS).alias("bucket"),
        ),
        f"{path}/sizes",
    )
    targets = stored(source_targets(rows, weights, most), f"{path}/targets")
    release(docs.sparkSession)
    slots = schedule(targets, block, path)
    release(docs.sparkSession)
    named = rows.where("size > 0").join(targets, rows["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "copy", "size", "key", "bucket", "place", "source_size", "quota"
    )
    placed = _running(named, ["place"], "size", "at")
    # The words of each run through the source, and the blocks that they fall into.
    runs = placed.where("quota > at").withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1 - F.col("at")) / F.col("source_size")))))
    runs = runs.withColumn("begin", F.col("at") + F.col("run") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("quota")))
    cut = runs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    pieces = cut.join(slots, ["place", "rank"]).select(
        "slot",
        "doc_id",
        "copy",
        (F.greatest("begin", F.col("rank") * block) - F.col("begin")).alias("from_word"),
        (F.least("end", (F.col("rank") + 1) * block) - F.col("begin")).alias("to_word"),
        F.col("run"),
    )
    return rows.select("doc_id", "copy", "source", "size"), targets, pieces
