"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped without making pairs.

A word is known by its place in the order of counts (most first, ties by code point), so that "the near word of largest
count" is the least number. Every word goes into one wildcard group for each of its letters: (place, what is before, what is
after). Two words of a group differ by that letter, and two words that differ by one letter share exactly one group. A
group keeps its size and its two first words; each member counts the others and takes the first that is not itself. What
is left of a word without a letter is joined with the vocabulary; such links are one for each letter of a word at most.
Keys are two 64-bit hashes of letters and places, so a word of a million letters has rows of the same size as any other.

Groups are bounded by the alphabet (90 letters); occurrences are summed up where they are read before they are shuffled.

Defined cases: null and empty texts have no words; a null id counts as an empty name; repeated rows count again; runs of any
length are words; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import forget, mixed, shared_dir, stored

#: Runs of letters: a-z, A-Z and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of words whose keys are made at once.
AT_ONCE = 1 << 20

_SEEDS = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)), (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))]


def runs(docs: DataFrame, text_col: str = "text") -> Column:
    """The lower-cased runs of letters of a text."""
    return F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(RUN), 0)


def misspelled(doc_id: Column, run: Column, every: int = 97) -> Column:
    """``run`` without one letter where ``every`` divides the checksum of id and run; else ``run``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``(word, n)`` of the words of ``least_length`` letters and ``least_count`` occurrences at least."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(runs(docs, text_col)).alias("run")).where(F.length("run") >= least_length)
    words = rows.select((misspelled(F.col("doc_id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keys(words: list[str], wanted: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Two hashes for each wildcard, for each distinct deletion, or for each whole word, and the word of each.

    A letter weighs by its place; weights of places are hashes, so no pattern of letters makes hashes meet.
    """
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    at = (np.arange(len(code)) - first[of]).astype(np.uint64)
    keep = slice(None)
    if wanted == "deletion":  # of a run of one letter, the last: the others leave the same
        keep = np.append(of[1:] != of[:-1], True)
        keep[:-1] |= code[1:] != code[:-1]
    out = []
    for letter, place in _SEEDS:
        value = mixed(code * letter + place)
        here = value * (mixed(at * place + letter) | np.uint64(1))
        upto = np.append(np.uint64(0), np.cumsum(here, dtype=np.uint64))
        total = upto[first + size] - upto[first]
        length = size.astype(np.uint64)
        if wanted == "whole":
            out.append(mixed(total + length * letter))
        elif wanted == "wildcard":
            out.append(mixed(total[of] - here + (length[of] * letter ^ mixed(at + place))))
        else:  # letters behind the place move up by one
            moved = value * (mixed((at - np.uint64(1)) * place + letter) | np.uint64(1))
            behind = np.append(np.uint64(0), np.cumsum(moved, dtype=np.uint64))
            rest = upto[:-1] - upto[first][of] + behind[first + size][of] - behind[1:]
            out.append(mixed(rest + (length[of] - np.uint64(1)) * letter)[keep])
    return [x.view(np.int64) for x in out], np.arange(len(words)) if wanted == "whole" else of[keep]


def _keyed(vocabulary: DataFrame, wanted: str) -> DataFrame:
    """``(k1, k2, id)`` of the words of ``vocabulary``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            lo = 0
            while lo < len(words):
                hi, letters = lo, 0
                while hi < len(words) and (hi == lo or letters + len(words[hi]) <= AT_ONCE):
                    letters += len(words[hi])
                    hi += 1
                (k1, k2), of = _keys(words[lo:hi], wanted)
                for i in range(0, len(k1), 1 << 18):
                    part = slice(i, i + (1 << 18))
                    yield pa.RecordBatch.from_pydict({"k1": k1[part], "k2": k2[part], "id": ids[lo:hi][of[part]]})
                lo = hi

    return vocabulary.select("id", "word").mapInArrow(run, "k1 long, k2 long, id long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of ``(id, word)``: how many words are near, and the least id of them; words without any are left out."""
    group = Window.partitionBy("k1", "k2")
    in_order = group.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = _keyed(vocabulary, "wildcard").select(
        "id", F.count("*").over(in_order).alias("size"), F.first("id").over(in_order).alias("top"), F.nth_value("id", 2).over(in_order).alias("second")
    )
    replaced = groups.where("size > 1").select("id", (F.col("size") - 1).alias("links"), F.when(F.col("top") == F.col("id"), F.col("second")).otherwise(F.col("top")).alias("near"))
    links = _keyed(vocabulary, "deletion").join(_keyed(vocabulary, "whole").withColumnRenamed("id", "shorter"), ["k1", "k2"])
    both = F.explode(F.array(F.struct("id", F.col("shorter").alias("near")), F.struct(F.col("shorter").alias("id"), F.col("id").alias("near")))).alias("x")
    shifted = links.select(both).select("x.id", F.lit(1).cast("long").alias("links"), "x.near")
    return replaced.unionByName(shifted).groupBy("id").agg(F.sum("links").alias("n_near"), F.min("near").alias("best"))


def group_variants(words: DataFrame, ratio: int = 2, path: str | None = None) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each of ``(word, n)``; words are distinct.

    A word's form is its near word of largest count (ties: first by code point) if that count is ``ratio`` times its own at
    least (2 or more, so that forms lead to ever larger counts); its root is where forms lead to.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2")
    spark = words.sparkSession
    path = path or shared_dir(spark)
    # A sort by range gives rising numbers; written, so that they hold.
    vocabulary = stored(words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), f"{path}/vocabulary")
    near = near_words(vocabulary).join(vocabulary.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n")), "best")
    leads = F.col("best_n") >= F.lit(ratio) * F.col("n")
    rows = vocabulary.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best")).alias("form_id"),
        F.when(leads, F.col("best_word")).alias("form"), F.when(leads, F.col("best_n")).alias("form_n"),
    )
    rows = stored(rows, f"{path}/forms")
    # Counts double at least from form to form, so chains are short; each round doubles what a word has walked.
    ends, moving, k = stored(rows.where("form_id is not null").select("id", F.col("form_id").alias("end")), f"{path}/ends0"), True, 0
    while moving:
        on = ends.select(F.col("id").alias("end"), F.col("end").alias("further"))
        walked = ends.join(on, "end", "left").select("id", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved"))
        k += 1
        walked = stored(walked, f"{path}/ends{k}")
        forget(spark, f"{path}/ends{k - 1}")
        ends, moving = walked.select("id", "end"), not walked.where("moved").isEmpty()
    roots = ends.join(vocabulary.select(F.col("id").alias("end"), F.col("word").alias("root")), "end").select("id", "root")
    return rows.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
