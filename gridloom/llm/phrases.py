"""Collocations: phrases whose words come together more often than their parts would tell, mined for each language.

1. Texts become blocks of one language: words parted by single spaces, pieces (what lies between full stops, commas and line
   ends) by line feeds, so that a space guards each word on both sides.
2. A count-min sketch for each length of phrase bounds its occurrences from above. Tasks count cells, cells are summed up, and the bits
   of those that reach the least count (a fixed number of bytes) are handed to all tasks. Longer phrases are counted
   only where the bounds of both shorter ones inside reach it.
3. Places whose bounds reach the least count are hot. Each task walks the hot places of some megabytes of a language's blocks
   through an automaton that steps from word to word: a state is a run of words, and it has states only for runs that start at a
   hot place. So every phrase that may be a candidate, and every single word, gives one row for each automaton that met it,
   with its occurrences there. Neither texts nor candidates are copied from share to share: the rows follow the input.
4. Sums of these rows are exact. Those below the least count go; the parts of a candidate are phrases that reach it too, so their
   sums are joined to it; the thresholds apply to them.

A sketch that is too small for its input lets more places be hot; results stay the same.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count again; a text of any
length is cut into blocks between pieces, and a longer piece is one block; extra columns are ignored; an empty table
gives an empty result; equal scores and counts are ranked by phrase in byte order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches_of, forget, mixed, shared_dir, stored, word_hashes

#: Bytes of a block; of a language's blocks that one automaton reads, and of all blocks that wait in a task.
BLOCK, SHARD, WAITING = 1 << 18, 4 << 20, 8 << 20
#: Bytes of an Arrow batch of blocks.
BATCH = "4m"
#: log2 of a sketch row's cells at most, and cells in a part of it that is summed up in one row.
LG_CELLS, PART = 25, 1 << 16
#: Rows of a sketch; rows of counts in one Arrow batch.
ROWS, OUT = 2, 50_000
#: Buckets in which a language's first phrases are found before they are put in order.
BUCKETS = 64

_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES, _BREAKS = re.compile(rb" {2,}"), re.compile(rb" ?\n[ \n]*")


def normalised(text: bytes) -> bytes:
    """Words of A-Z lower-cased with a space on both sides, pieces with a line feed between."""
    text = _BREAKS.sub(b" \n ", _SPACES.sub(b" ", b" " + text.translate(_TABLE) + b" "))
    return text if text.strip() else b""


def blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, block binary, words)``."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.make_valid_utf8(F.col(text_col).cast("string")).cast("binary").alias("block")).where("length(block) > 0")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(lang: str, parts: list[bytes]) -> pa.RecordBatch:
            block = b"\n".join(parts)
            return pa.RecordBatch.from_pydict({"lang": [lang], "block": [block], "words": pa.array([block.count(b" ") - block.count(b"\n") - 1], pa.int64())})

        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = normalised(text.as_py())
                lo = 0
                while lo < len(text):
                    hi = len(text) if len(text) - lo <= BLOCK else text.find(b"\n", lo + BLOCK)
                    hi = len(text) if hi < 0 else hi
                    if text[lo:hi].strip():
                        held.setdefault(lang, []).append(text[lo:hi])
                        size[lang] = size.get(lang, 0) + hi - lo
                    lo = hi + 1
                    if size.get(lang, 0) >= BLOCK:
                        yield out(lang, held.pop(lang))
                        size[lang] = 0
                if len(held) > 1000:
                    for lang in list(held):
                        yield out(lang, held.pop(lang))
                    size.clear()
        for lang, parts in held.items():
            yield out(lang, parts)

    return rows.mapInArrow(run, "lang string, block binary, words long")


class Scanner:
    """Hashes of the phrases of blocks, and which of them have bounds that reach the least count."""

    def __init__(self, lg: int, hot: dict[int, list[np.ndarray]]):
        self.mask, self.hot = np.uint64((1 << lg) - 1), hot

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return mixed(hashes + np.uint64(row) * np.uint64(0x9E3779B97F4A7C15)) & self.mask

    def reaches(self, hashes: np.ndarray, k: int) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for row, bits in enumerate(self.hot[k]):
            cell = self.cells(hashes, row)
            found &= (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found

    def phrases(self, lang: str, block: bytes, most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Of 1 to ``most`` words: the hashes and first words of phrases whose shorter ones all reach the count; places of words."""
        data = np.frombuffer(block, np.uint8)
        words, start, end = word_hashes(data)
        piece = np.cumsum(data == 10)[start]
        tongue = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]
        hashes = mixed(words + tongue)
        out, first = [(hashes, np.arange(len(words)))], np.arange(len(words))
        alive = np.ones(len(words), bool)
        for k in range(2, most + 1):
            n = len(words) - k + 1
            if n <= 0:
                out.append((words[:0], first[:0]))
                alive = alive[:0]
                continue
            longer = mixed(hashes[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + words[k - 1 :] + np.uint64(k))
            same = piece[:n] == piece[k - 1 :]
            if k > 2:
                met = np.zeros(len(alive), bool)
                met[alive] = self.reaches(hashes[: len(alive)][alive], k - 1)
                same &= met[:n] & met[1 : n + 1]
            hashes, alive = longer, same
            out.append((longer[same], np.flatnonzero(same)))
        return out, start, end


def _sketch(parts: DataFrame, lg: int, k: int, hot: dict, least: int) -> list[np.ndarray]:
    """The bits of the cells of a sketch of phrases of ``k`` words that reach ``least``, a row of the sketch each."""
    known = parts.sparkSession.sparkContext.broadcast(hot)
    size = 1 << lg
    part = min(PART, size)
    if least >= 1 << 16:
        raise ValueError("least is below 65536")
    small = "<u2" if least >= 256 else "u1"

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner, cells = Scanner(lg, known.value), np.zeros((ROWS, size), small)
        waiting: list[np.ndarray] = []

        def put() -> None:
            hashes = np.concatenate(waiting)
            waiting.clear()
            for row in range(ROWS):
                at, n = np.unique(scanner.cells(hashes, row), return_counts=True)
                cells[row, at] = np.minimum(cells[row, at] + n, least)  # a cell that has reached the count needs no more

        for batch in batches:
            for lang, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                waiting.append(scanner.phrases(lang, block.as_py(), k)[0][k - 1][0])
                if sum(map(len, waiting)) >= 1 << 20:
                    put()
        if waiting:
            put()
        for row in range(ROWS):
            for p in range(size // part):
                if len(at := np.flatnonzero(here := cells[row, p * part : (p + 1) * part])):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "part": pa.array([p], pa.int32()), "at": [at.astype("<u2").tobytes()], "n": [here[at].tobytes()]})

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, total = None, None

        def done() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"row": pa.array([now[0]], pa.int32()), "part": pa.array([now[1]], pa.int32()), "bits": [bits]})

        for batch in batches:
            for row, p, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (row, p):
                    if now:
                        yield done()
                    now, total = (row, p), np.zeros(part, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, small)
        if now:
            yield done()

    counted = parts.select("lang", "block").mapInArrow(count, "row int, part int, at binary, n binary")
    summed = counted.repartition("row", "part").sortWithinPartitions("row", "part").mapInArrow(add, "row int, part int, bits binary")
    out = [np.zeros(size // 8, np.uint8) for _ in range(ROWS)]
    for r in summed.toLocalIterator():  # size / 4 bytes in all, whatever the input
        out[r["row"]][r["part"] * part // 8 : (r["part"] + 1) * part // 8] = np.frombuffer(r["bits"], np.uint8)
    known.unpersist()
    return out


class Automaton:
    """Counts phrases and all runs of words inside them: a state is such a run, a step the next word. It starts at every word."""

    def __init__(self, phrases: list[bytes], most: int):
        words = b" ".join(phrases).split(b" ")
        self.words = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.size = np.fromiter((p.count(b" ") + 1 for p in phrases), np.int64, len(phrases))
        self.first = np.cumsum(self.size) - self.size
        end = np.repeat(self.first + self.size, self.size)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        #: State of the run of k words from each word of the phrases on; the steps to states of k words, in order.
        self.states, self.steps = [at], [np.arange(len(self.words))]
        for k in range(2, most + 1):
            n = max(0, len(at) - k + 1)
            step = self.states[-1][:n] * len(self.words) + at[k - 1 :]
            within = np.arange(n) + k <= end[:n]
            self.steps.append(np.unique(step[within]))
            self.states.append(np.where(within, np.searchsorted(self.steps[-1], step), -1))
        self.counts = [np.zeros(len(x), np.int64) for x in self.steps]

    @classmethod
    def of_places(cls, words: dict[bytes, int], at: np.ndarray, places: list[np.ndarray]) -> Automaton:
        """The automaton that has walked a text, given as numbers of ``words``, from each of its ``places``: those for runs
        of 2 words first, then of 3, each among those before. All occurrences of a run have to be among them."""
        new = cls.__new__(cls)
        new.words, new.steps, new.counts = words, [np.arange(len(words))], [np.bincount(at, minlength=len(words))]
        before, state = np.arange(len(at)), at
        for k, first in enumerate(places, 2):
            step = state[np.searchsorted(before, first)].astype(np.int64) * len(words) + at[first + k - 1]
            steps, state, counts = np.unique(step, return_inverse=True, return_counts=True)
            state, before = state.astype(np.int32), first
            new.steps.append(steps)
            new.counts.append(counts)
        return new

    def runs(self, k: int) -> list[np.ndarray]:
        """The words of each state of ``k`` words, as numbers: all first ones, all second ones, ..."""
        words, state = [], np.arange(len(self.steps[k - 1]))
        for steps in self.steps[k - 1 : 0 : -1]:
            state, last = np.divmod(steps[state], len(self.words))
            words.append(last)
        return [state, *words[::-1]]

    def read(self, block: bytes) -> None:
        text = block.split(b" ")
        at = np.fromiter(map(self.words.get, text, repeat(-1)), np.int64, len(text))
        where = np.flatnonzero(at >= 0)
        state = at[where]
        for k, counts in enumerate(self.counts, 1):
            if k > 1:
                go = where + k - 1 < len(at)
                where, state = where[go], state[go]
                go = at[where + k - 1] >= 0
                where, step = where[go], state[go] * len(self.words) + at[where[go] + k - 1]
                state = np.searchsorted(self.steps[k - 1], step)
                go = np.append(self.steps[k - 1], -1)[state] == step
                where, state = where[go], state[go]
            counts += np.bincount(state, minlength=len(counts))

    def of(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Occurrences of the runs of ``size`` words at those words of the phrases; 0 where the size is."""
        out = np.zeros(len(begin), np.int64)
        for k, (states, counts) in enumerate(zip(self.states, self.counts), 1):
            own = np.flatnonzero(size == k)
            out[own] = counts[states[begin[own]]]
        return out


def tallies(parts: DataFrame, most: int, least: int, lg: int, shard: int = SHARD) -> DataFrame:
    """``(lang, phrase, k, a)``: words and hot phrases of ``k`` words, up to ``most``, with their occurrences in one automaton's blocks."""
    hot: dict[int, list[np.ndarray]] = {}
    for k in range(2, most + 1):
        hot[k] = _sketch(parts, lg, k, hot, least)
    known = parts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        scanner = Scanner(lg, known.value)
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray], list[list[np.ndarray]]]] = {}
        size: dict[str, int] = {}

        def take(lang: str, block: bytes) -> None:
            """Numbers the words of a block, and finds its hot places."""
            words, texts, places = held.setdefault(lang, ({}, [], [[] for _ in range(most - 1)]))
            text = block.split()
            for w in set(text).difference(words):
                words[w] = len(words)
            base = sum(map(len, texts))
            texts.append(np.fromiter(map(words.__getitem__, text), np.int32, len(text)))
            for k, (hashes, first) in enumerate(scanner.phrases(lang, block, most)[0][1:], 2):
                places[k - 2].append((first[scanner.reaches(hashes, k)] + base).astype(np.int32))
            size[lang] = size.get(lang, 0) + len(block)

        def put(lang: str) -> Iterator:
            words, texts, places = held.pop(lang)
            size.pop(lang)
            machine = Automaton.of_places(words, np.concatenate(texts), [np.concatenate(p) for p in places])
            names = pa.array(list(words), pa.binary()).cast(pa.string())
            for k, counts in enumerate(machine.counts, 1):
                runs = machine.runs(k)
                for lo in range(0, len(counts), OUT):
                    phrase = pc.binary_join_element_wise(*(names.take(pa.array(r[lo : lo + OUT])) for r in runs), " ")
                    n = len(phrase)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), phrase, pa.array(np.full(n, k, np.int32)), pa.array(counts[lo : lo + n])], ["lang", "phrase", "k", "a"])

        for batch in batches:
            for lang, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                take(lang, block.as_py())
                if size[lang] >= shard:
                    yield from put(lang)
                while sum(size.values()) >= WAITING or len(size) > 1000:
                    yield from put(max(size, key=size.get))
        for lang in list(held):
            yield from put(lang)

    return parts.select("lang", "block").mapInArrow(run, "lang string, phrase string, k int, a long")


def _score(k: int) -> Column:
    """floor(1000000 * a * a / (l * r)) in exact decimals; null where a phrase has no cut after ``k`` words."""
    exact = lambda c: f"cast({c} as decimal(18,0))"
    score = f"(1000000 * cast({exact('a')} * {exact('a')} as decimal(31,0))) div ({exact(f'l{k}')} * {exact(f'r{k}')})"
    return F.when(F.col(f"l{k}") > 0, F.expr(score))


def mine_phrases(
    docs: DataFrame, most: int = 3, least: int = 10, cover: int = 50, first: int = 2000, text_col: str = "text", lang_col: str = "lang",
    lg_cells: int | None = None, shard: int = SHARD, path: str | None = None,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``first`` phrases of 2 to ``most`` words by score.

    A phrase occurs ``least`` times at least (a); the score of a cut is floor(1000000 * a * a / (l * r)), and the lowest
    scoring cut counts (ties: the first). A phrase inside a longer one that has ``cover`` percent of its occurrences is left out.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    parts = stored(blocks(docs, text_col, lang_col), f"{path}/blocks")
    totals = stored(parts.groupBy("lang").agg(F.sum("words").alias("n")), f"{path}/totals")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lg = lg_cells or max(16, min(LG_CELLS, int(words).bit_length()))
    with batches_of(spark, BATCH):
        counted = tallies(parts, most, least, lg, shard).groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a"))
        counted = stored(counted.where(F.col("a") >= least), f"{path}/counted")
    forget(spark, f"{path}/blocks")

    wanted = counted.where("k > 1")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda w: F.transform(F.sequence(F.lit(1), F.col("k") - w + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, w), " "))))
    covers = counted.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = wanted.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")
    # Each cut with the counts of its parts, which reach the least count as the whole does.
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"before": F.expr("substring_index(phrase, ' ', cut)"), "behind": F.expr("substring_index(phrase, ' ', cut - k)")})
    for part, count in (("before", "l1"), ("behind", "r1")):
        cuts = cuts.join(counted.select("lang", F.col("phrase").alias(part), F.col("a").alias(count)), ["lang", part])
    lowest = F.min(F.struct(_score(1).alias("score"), "cut", F.col("l1").alias("l"), F.col("r1").alias("r"))).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    bucket = Window.partitionBy("lang", "bucket").orderBy(*order)
    some = scored.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("rank", F.row_number().over(bucket)).where(F.col("rank") <= first)
    # At most BUCKETS * first rows of a language.
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals.select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
