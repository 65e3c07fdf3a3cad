"""Exact deduplication by a log-structured merge index of text digests (DataFrame operations only).

Input splits are dealt over memtables. A memtable is summed up (for each digest the smallest identifier and the number
of copies) and flushed as a run: a Parquet table range-sorted by digest, beside a blocked Bloom filter of its digests.
Before that, its digests are probed against the runs already there: those that a run's filter passes are looked up in
the run, which sheds the filter's false positives. Digests that are found, or that a memtable holds twice, are hits.
Once a level holds ``fanout`` runs they are compacted into one run of the next level, which keeps for each digest the
smallest identifier ("smallest" may mean the largest document number).

Rows whose digest is no hit stay as they are and are not shuffled: a filter of the hits, broadcast while its size
allows, tells them. The bytes of all hits are verified: of the texts of one digest the least and the greatest must be
equal, a partial aggregate, so a text with a third of all rows moves once a task. Should two texts ever share a digest,
they are grouped anew by the text itself.

Defined cases: a null text counts as empty text; repeated rows, and rows that repeat an id with another text, count one
by one; a null id never beats another id, and an all-null group keeps a null; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import checked_broadcast, forget, release, shared_dir, stored
from gridloom.llm.url_filter import BITS_PER_KEY, LANES, all_set, block_of, bloom_blocks, lane_masks

#: Bytes of a filter that are broadcast; beyond it, a filter is joined by block.
FILTER_BYTES = 32 << 20


class Run(NamedTuple):
    path: str


class DigestIndex:
    """Sorted runs of ``(digest, rank, copies)`` and their filters under one shared folder."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 2):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.levels: list[list[Run]] = [[]]
        self._made = 0
        self._filters: dict[str, int] = {}

    def rows(self, run: Run) -> DataFrame:
        return self.spark.read.parquet(f"{run.path}/rows")

    def _flush(self, rows: DataFrame, level: int) -> Run:
        path = f"{self.path}/level{level}/run{self._made}"
        self._made += 1
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(n, "digest").sortWithinPartitions("digest").write.parquet(f"{path}/rows")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(Run(path))
        return self.levels[level][-1]

    def _filter(self, run: Run) -> tuple[DataFrame, int]:
        """The run's filter and its number of blocks; it is written when it is first probed."""
        if run.path not in self._filters:
            blocks = filter_blocks(self.rows(run).count())
            bloom_blocks(self.rows(run).select(F.col("digest").alias("key")), blocks).write.parquet(f"{run.path}/filter")
            self._filters[run.path] = blocks
        return self.spark.read.parquet(f"{run.path}/filter"), self._filters[run.path]

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.min("rank").alias("rank"), F.sum("copies").alias("copies"))

    def find(self, rows: DataFrame, run: Run) -> DataFrame:
        """``digest`` of those ``rows`` that the run holds: what its filter passes, looked up in it."""
        may = passed(rows, *self._filter(run)).where("may").select("digest")
        return may.join(self.rows(run).select("digest"), "digest", "left_semi")

    def ingest(self, batch: DataFrame) -> DataFrame:
        """Add ``(digest, rank)`` rows; returns the written ``digest`` of the batch's hits."""
        older = [r for level in self.levels for r in level]
        run = self._flush(self.merged(batch.select("digest", "rank", F.lit(1).cast("long").alias("copies"))), 0)
        hits = self.rows(run).where("copies > 1").select("digest")
        for r in older:  # few: fanout - 1 a level
            hits = hits.unionByName(self.find(self.rows(run).select("digest"), r))
        hits = stored(hits.distinct(), f"{self.path}/hits{self._made}")
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            rows = [self.rows(r) for r in runs]
            every = rows[0]
            for r in rows[1:]:
                every = every.unionByName(r)
            self._flush(self.merged(every), level + 1)
            for r in runs:
                forget(self.spark, r.path)
            level += 1
        return hits

    def entries(self, hits: DataFrame) -> DataFrame:
        """``(digest, rank, copies)`` of the digests in ``hits``, over all runs."""
        found = None
        for run in (r for level in self.levels for r in level):
            part = self.rows(run).join(hits, "digest", "left_semi")
            found = part if found is None else found.unionByName(part)
        return self.merged(found)


def filter_blocks(n: int) -> int:
    """Blocks of a filter of ``n`` digests."""
    return 1 << max(0, math.ceil(math.log2(max(1, n * BITS_PER_KEY / (64 * LANES)))))


def passed(rows: DataFrame, bloom: DataFrame, blocks: int, limit: int = FILTER_BYTES) -> DataFrame:
    """``rows`` (with a ``digest``) and whether the filter passes each, as ``may``."""
    bloom = checked_broadcast(bloom, blocks, 8 * LANES + 4, limit)
    probed = rows.withColumn("block", block_of(F.col("digest"), blocks)).join(bloom, "block", "left")
    return probed.withColumn("may", F.coalesce(all_set(lane_masks(F.col("digest"))), F.lit(False))).select(*rows.columns, "may")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    memtables: int = 4,
    fanout: int = 2,
    digest: Callable[[Column], Column] = sha256,
    path: str | None = None,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    ``keep`` is ``smallest`` or ``largest``: which identifier of a group of equal texts stays. ``text_sha256`` is the
    digest in hexadecimal. The text is read twice: to digest it, and to verify the hits.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    sign = F.lit(-1 if keep == "largest" else 1)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), (F.col("doc_id") * sign).alias("k"), F.col("doc_id").alias("id")).alias("rank")
    split = F.pmod(F.spark_partition_id(), F.lit(memtables)).alias("memtable")
    rows.select("doc_id", "digest", split).write.partitionBy("memtable").parquet(f"{path}/digests")
    digests = spark.read.schema("doc_id long, digest binary, memtable int").parquet(f"{path}/digests")
    index = DigestIndex(spark, f"{path}/index", fanout)
    hits = None
    for k in range(memtables):
        found = index.ingest(digests.where(F.col("memtable") == k).select("digest", rank))
        hits = found if hits is None else hits.unionByName(found)
        release(spark)
    groups = stored(index.entries(hits.distinct()), f"{path}/groups")
    forget(spark, f"{path}/index")
    blocks = filter_blocks(groups.count())
    bloom = stored(bloom_blocks(groups.select(F.col("digest").alias("key")), blocks), f"{path}/filter")

    wrong = _unequal(rows, groups, bloom, blocks, path)
    release(spark)
    probed = passed(digests.select("doc_id", "digest"), bloom, blocks)
    one = F.lit(1).cast("long")
    alone = probed.where("not may").select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), "digest", F.lit(True).alias("kept"))
    several = probed.where("may").join(groups, "digest", "left")
    several = several.withColumn("keep_id", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("rank.id")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = alone.unionByName(several.select("doc_id", "keep_id", F.coalesce("copies", one).alias("group_size"), "digest", kept.alias("kept")))
    if wrong is not None:
        out = _regrouped(rows, out, wrong, rank)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _unequal(rows: DataFrame, groups: DataFrame, bloom: DataFrame, blocks: int, path: str) -> DataFrame | None:
    """Digests of several texts, from the bytes of all hits; None if there is none."""
    hits = passed(rows.select("digest", "text"), bloom, blocks).where("may").select("digest", "text")
    ends = hits.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest")
    bad = stored(ends.join(groups.select("digest"), "digest", "left_semi"), f"{path}/unequal")
    return None if bad.isEmpty() else bad


def _regrouped(rows: DataFrame, out: DataFrame, wrong: DataFrame, rank: Column) -> DataFrame:
    """Groups of the digests in ``wrong`` formed anew by whole texts (no such pair of SHA-256 digests is known)."""
    texts = rows.join(wrong, "digest", "left_semi")
    groups = texts.groupBy("digest", "text").agg(F.min(rank).alias("first"), F.count("*").alias("group_size"))
    anew = texts.join(groups, ["digest", "text"]).withColumn("keep_id", F.col("first.id"))
    anew = anew.select("doc_id", "keep_id", "group_size", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return out.join(wrong, "digest", "left_anti").unionByName(anew)
