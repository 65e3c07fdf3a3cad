"""Cross-site boilerplate lines by their spread over distinct sites.

Each line (trimmed of spaces) is known by two 64-bit hashes. One aggregation gives every line hash a HyperLogLog
sketch of the sites that it occurs on; sketches of the same hash merge as partial aggregates, so a line that a third of
all rows hold is summed up before it is shuffled. Lines whose estimate is clear of the threshold are decided by the
sketch; those within the sketch's error of it (and two sites at least) get exact distinct counts. Lines on
``min_sites`` sites or more are boilerplate and leave every document.

Defined cases: null and empty texts have no line and stay as they are (a null one as an empty text); blank lines are
never removed; a null site is a site of its own; repeated rows are cleaned one by one; a document of one very long line
is one line; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import shared_dir, stored

#: log2 of a sketch's registers, and its relative standard error.
LG_K = 12
ERROR = 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" ")))


def _hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(3), line).alias("h2")]


def boilerplate(docs: DataFrame, min_sites: int, path: str, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``(h1, h2)`` of the lines on at least ``min_sites`` distinct sites."""
    site = F.concat(F.when(F.col(site_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(site_col).cast("string"), F.lit("")))
    lines = docs.select(F.explode(_lines(F.col(text_col))).alias("line"), site.alias("site")).where("line <> ''")
    lines = lines.select(*_hash(F.col("line")), "site")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n"))
    spread = spread.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    band = max(2.0, 5 * ERROR * min_sites)
    spread = stored(spread.where(F.col("sites") >= min_sites - band), f"{path}/spread")
    sure = spread.where(F.col("sites") > min_sites + band).select("h1", "h2")
    near = spread.where(F.col("sites") <= min_sites + band).select("h1", "h2")
    exact = (
        lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    )
    return stored(sure.unionByName(exact), f"{path}/boilerplate")


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    path: str | None = None,
) -> DataFrame:
    """``(doc_id, n_lines, n_removed, clean_text)``, a row for each of ``docs``; lines that are not blank are counted."""
    path = path or shared_dir(docs.sparkSession)
    common = boilerplate(docs, min_sites, path, text_col, site_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Which of the common lines a text holds depends on the text alone, so a text's digest names it.
    digest = F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), F.col("text")).alias("t2")
    rows = rows.select("*", *digest)
    texts = rows.where(F.col("text") != "").select("t1", "t2", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    held = texts.where("line <> ''").select("t1", "t2", "line", *_hash(F.col("line"))).join(common, ["h1", "h2"])
    # Written before it is joined: so the join has a shuffle of its own, in which Spark splits a text that many rows have.
    drop = stored(held.groupBy("t1", "t2").agg(F.collect_set("line").alias("gone")), f"{path}/drop")
    gone = F.coalesce("gone", F.array().cast("array<string>"))
    parts = F.split("text", "\n")
    trimmed = lambda x: F.trim(x, F.lit(" "))
    rest = F.filter(parts, lambda x: ~F.array_contains(gone, trimmed(x)))
    full = lambda a: F.size(F.filter(a, lambda x: trimmed(x) != ""))
    out = rows.join(drop, ["t1", "t2"], "left").select("doc_id", parts.alias("parts"), F.when(F.size(gone) > 0, rest).otherwise(parts).alias("rest"))
    return out.select(
        "doc_id", full(F.col("parts")).cast("long").alias("n_lines"),
        (full(F.col("parts")) - full(F.col("rest"))).cast("long").alias("n_removed"), F.array_join("rest", "\n").alias("clean_text"),
    )
