"""The corpus pipeline: stages that each call one operator, written and read again between them.

Documents need a number: one whose doc_id is null goes at the first stage. A null text is rejected by language ID. A
number that repeats stays or goes as one document in the first three stages; the mix tells its rows apart. Extra
columns are carried to the last stage, whatever their names. Without labelled texts, the first stage rejects only texts
without a letter. A stage's frame has to be written before the next stage is called, as :func:`run` does: the tables that
a stage wrote for itself go then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, packing
from gridloom.llm.common import WORD, forget, release, shared_dir, stored
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.minhash_dedup import near_duplicates
from gridloom.llm.mixing import mix_sources, numbered
from gridloom.llm.queries import MIX_WEIGHTS, vocabulary


_left: list[str] = []


def _scratch(spark: SparkSession) -> str:
    """A folder for a stage's own tables; that of the stage before, whose result has been written, goes."""
    while _left:
        forget(spark, _left.pop())
    _left.append(shared_dir(spark))
    return _left[0]


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number is among ``ids``."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the nearest centroid rejects go."""
    model = langid.train(docs)
    return _kept(docs, langid.identify(docs, model).where("not rejected"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest number."""
    return _kept(docs, exact_dedup(docs, keep="smallest", memtables=2, path=_scratch(spark)).where("kept"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest number."""
    return _kept(docs, near_duplicates(docs, threshold=0.75, k=5, path=_scratch(spark)).where("kept"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; one that a source's target cuts keeps the words that are taken."""
    _, _, pieces = mix_sources(docs, MIX_WEIGHTS, path=_scratch(spark))
    turns = pieces.groupBy(F.col("doc_id").alias("d"), "copy", "run").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = numbered(docs.select("doc_id", "text", "source", F.struct("*").alias("row")))
    rows = rows.join(turns, (rows["doc_id"] == turns["d"]) & (rows["_copy"] == turns["copy"]))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.col("taken") < F.regexp_count("text", F.lit(WORD))
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        n_chars = F.when(cut, F.length("row.text").cast("long")).otherwise(F.col("row.n_chars"))
        rows = rows.withColumn("row", F.col("row").withField("n_chars", n_chars))
    return rows.select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 ids."""
    placed, _ = packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048, vocabulary_size=50257, path=_scratch(spark))
    return placed


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicate_groups),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path, before = shared_dir(spark), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/stage{k}")
        if before:
            forget(spark, before)
        before = f"{path}/stage{k}"
        release(spark)
    return docs
