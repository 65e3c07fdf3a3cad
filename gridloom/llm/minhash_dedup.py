"""Near-duplicate documents by HyperMinHash.

A document is the set of its 5-word shingles. One hash a shingle feeds 256 buckets; a bucket keeps of its smallest hash
the number of leading zeros and ``MANTISSA`` bits after the first one (16 bits in all). Empty buckets borrow from other
buckets of the same document by a fixed random probing, and the registers are banded; documents that agree on a band
are candidates. The share of equal registers, corrected for registers that agree by chance, estimates the Jaccard
similarity and sheds candidates far below the threshold; the rest are verified on their full sets of shingle hashes.

Equal sets are one class, represented by its smallest id, so copies are never paired. Only links between different
classes that are still in different components are tested: first every document against the smallest leader of its
bands and then against one drawn by hash, which merges groups of near copies; then small bands pair by pair. The members of large bands that still hold
several components are joined on their sets: two sets that similar share one of the rarest quarter of either's
shingles, so each document is listed under these, and pairs of one list are tested unless both belong to the list's
largest component. Frequent shingles come last in that order, so a line that a third of all documents hold lists
nothing. No pair of a band that is not yet connected stays untested, whatever the band's size.

Defined cases: null, empty and blank texts have no shingle, link with nothing and keep themselves; fewer than five
words make one shingle of the whole sequence; rows that repeat an id are one document of that id (equal texts) or
share its label; a null id is passed through as its own row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import checked_broadcast, components, forget, mixed, release, shared_dir, shingle_hashes, stored, text_bytes, unique_ids, word_hashes

BUCKETS = 256
MANTISSA = 10
#: 42 bands of 6 registers: a pair of similarity 0.75 shares one with probability 0.9997.
BANDS, ROWS = 42, 6
#: Candidates whose estimate lies this far below the threshold are shed (five standard errors of 256 registers).
MARGIN = 0.14
#: A band of at most so many members is compared pair by pair.
AT_ONCE = 12

_RNG = np.random.default_rng(31)
#: The bucket that an empty bucket asks at each attempt.
_ASK = _RNG.integers(0, BUCKETS, (400, BUCKETS))
_ORDER = _RNG.permutation(BUCKETS)[: BANDS * ROWS].reshape(BANDS, ROWS)
_MULT = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint16(0xFFFF)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct 64-bit hashes: the top 8 bits choose the bucket."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = hashes[first] & np.uint64((1 << 56) - 1)
    frac, exp = np.frexp(low.astype(np.float64))  # low = frac * 2 ** exp, frac in [0.5, 1)
    zeros = np.where(low == 0, 57, 56 - exp).astype(np.uint16)
    mantissa = np.where(low == 0, 0, ((frac - 0.5) * (2 << MANTISSA)).astype(np.int64)).astype(np.uint16)
    out = np.full(BUCKETS, _EMPTY)
    out[bucket[first]] = zeros << np.uint16(MANTISSA) | np.minimum(mantissa, (1 << MANTISSA) - 1)
    return out


def filled(reg: np.ndarray) -> np.ndarray:
    """Registers with empty buckets replaced by those they ask."""
    full = reg != _EMPTY
    if full.all() or not full.any():
        return reg
    out, todo = reg.copy(), np.flatnonzero(~full)
    for ask in _ASK:
        got = ask[todo]
        ok = full[got]
        out[todo[ok]] = reg[got[ok]]
        todo = todo[~ok]
        if not len(todo):
            return out
    near = np.flatnonzero(full)  # the next full bucket, around the ring
    out[todo] = reg[near[np.searchsorted(near, todo) % len(near)]]
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    r = filled(reg)[_ORDER].astype(np.uint64)
    key = mixed((r * _MULT).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows ``a`` and ``b`` of sets of ``n`` and ``m`` elements.

    Two minima of different elements fall in one cell (leading zeros, mantissa) with probability about
    0.72 * 2**-MANTISSA * nm / (n + m)**2; what that adds to the share of equal registers is taken off.
    """
    used = (a != _EMPTY) | (b != _EMPTY)
    share = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    chance = 0.72 * 2.0**-MANTISSA * n * m / np.maximum(n + m, 1) ** 2
    return (share - chance) / (1 - chance)


def _sets(docs: DataFrame, k: int, full: bool) -> DataFrame:
    """``(doc_id, n_shingles, set_key, registers)``, or ``(doc_id, shingles)`` with the sorted hashes, if ``full``."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            data, at = text_bytes(batch.column(1))
            out: list[tuple] = []
            size = 0
            for i, doc in enumerate(batch.column(0).to_pylist()):
                sh = np.unique(shingle_hashes(word_hashes(data[at[i] : at[i + 1]])[0], k))
                raw = sh.astype("<u8").tobytes()
                if full:
                    out.append((doc, raw))
                    size += len(raw)
                else:
                    out.append((doc, len(sh), hashlib.blake2b(raw, digest_size=16).digest() if len(sh) else None, registers(sh).tobytes() if len(sh) else None))
                if len(out) >= 2000 or size > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds())], names)
                    out, size = [], 0

    if full:
        names, schema = ["doc_id", "shingles"], "doc_id long, shingles binary"
    else:
        names, schema = ["doc_id", "n_shingles", "set_key", "registers"], "doc_id long, n_shingles long, set_key binary, registers binary"

    def kinds():
        import pyarrow as pa

        return [pa.int64(), pa.binary()] if full else [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    return docs.mapInArrow(run, schema)


def _banded(reps: DataFrame) -> DataFrame:
    """``(key, doc_id)``: the bands of each class representative."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                keys = [band_keys(np.frombuffer(r.as_buffer(), np.uint16)) for r in part.column(1)]
                ids = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], ["key", "doc_id"])

    return reps.select("doc_id", "registers").mapInArrow(run, "key long, doc_id long")


def _verified(pairs: DataFrame, sets: DataFrame, registers_of: DataFrame, threshold: float) -> DataFrame:
    """Of ``(a, b)``, the pairs whose sets reach ``threshold``: estimated on registers, then exact on full sets."""
    percent = round(threshold * 100)

    def close(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (2, 4))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in (3, 5))
                ok = (estimate(ra, rb, na, nb) >= threshold - MARGIN) & (np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb))
                # Few registers say little about small sets.
                ok |= (np.minimum(na, nb) < 64) & (np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    def exact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = np.intersect1d(x, y, assume_unique=True).size
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    def with_both(p: DataFrame, of: DataFrame, cols: list[str]) -> DataFrame:
        for side in ("a", "b"):
            named = of.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])
            p = p.join(named, side)
        return p.select("a", "b", *[f"{c}_{s}" for s in ("a", "b") for c in cols])

    near = with_both(pairs, registers_of, ["registers", "n_shingles"]).mapInArrow(close, "a long, b long")
    return with_both(near, sets, ["shingles"]).mapInArrow(exact, "u long, v long")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.75, k: int = 5, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: near-duplicate groups under links of Jaccard >= ``threshold``.

    ``component_id`` is the smallest id that links reach; ``kept`` marks the document of that id.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)

    def gone(*tables: str) -> None:
        for t in tables:
            forget(spark, f"{path}/{t}")
        release(spark)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(_sets(rows, k, full=False), f"{path}/signed")
    classes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = stored(
        signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").select("doc_id", "n_shingles", "rep"), f"{path}/member"
    )
    one = unique_ids(rows)  # of several texts of one number, the first stands for it
    own = signed if one is rows else _sets(one, k, full=False)
    own = own.where("set_key is not null").join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    reps = stored(own.select("doc_id", "n_shingles", "registers"), f"{path}/reps")
    gone("signed")
    bands = stored(_banded(reps), f"{path}/bands")
    # What is summed up by key is written before it is joined: so the joins have shuffles of their own, in which Spark
    # splits a key that many documents have.
    keys = stored(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1"), f"{path}/keys")
    bands = stored(bands.join(keys, "key"), f"{path}/shared")
    gone("bands", "keys")
    sets = stored(_sets(one.join(bands.select("doc_id").distinct(), "doc_id", "left_semi"), k, full=True), f"{path}/sets")

    # First round: each document against the smallest leader of its bands.
    first = bands.where("doc_id <> lead").groupBy("doc_id").agg(F.min("lead").alias("a")).select("a", F.col("doc_id").alias("b"))
    tested = stored(first, f"{path}/tested0")
    links = stored(_verified(tested, sets, reps, threshold), f"{path}/links0")
    release(spark)
    labels = stored(components(links, f"{path}/components0"), f"{path}/labels0")
    # Second round: in bands that are not yet one component, a leader drawn by hash.
    open_ = stored(_open_bands(bands, labels, f"{path}/parts0"), f"{path}/open0")
    gone("shared", "components0", "parts0")
    drawn = stored(open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "comp")).alias("l")), f"{path}/drawn")
    other = open_.join(drawn, "key").where("comp <> l.comp").groupBy("doc_id").agg(F.min("l").alias("l"))
    pairs = other.select(F.least("doc_id", "l.doc_id").alias("a"), F.greatest("doc_id", "l.doc_id").alias("b")).distinct()
    fresh = stored(pairs.join(tested, ["a", "b"], "left_anti"), f"{path}/tested01")
    tested = tested.unionByName(fresh)
    found = stored(_verified(fresh, sets, reps, threshold), f"{path}/links01")
    release(spark)
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = stored(components(links, f"{path}/components01"), f"{path}/labels01")
    open_ = stored(_open_bands(open_, labels, f"{path}/parts"), f"{path}/open")
    gone("open0", "components01", "parts", "drawn")
    left = open_.where(F.col("n") <= AT_ONCE).select("key", F.col("doc_id").alias("a"), F.col("comp").alias("ca"))
    right = left.select("key", F.col("a").alias("b"), F.col("ca").alias("cb"))
    pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    fresh = stored(pairs.join(tested, ["a", "b"], "left_anti"), f"{path}/tested1")
    tested = tested.unionByName(fresh)
    found = stored(_verified(fresh, sets, reps, threshold), f"{path}/links1")
    release(spark)
    if not found.isEmpty():
        links = links.unionByName(found)
        labels = stored(components(links, f"{path}/components1"), f"{path}/labels1")
    members = stored(_open_bands(open_.where(F.col("n") > AT_ONCE), labels, f"{path}/parts1").select("doc_id", "comp").distinct(), f"{path}/members")
    gone("open", "components1", "parts1")
    if not members.isEmpty():
        pairs = _prefix_pairs(members, sets, threshold, path)
        fresh = stored(pairs.join(tested, ["a", "b"], "left_anti"), f"{path}/tested2")
        gone("several")
        found = stored(_verified(fresh, sets, reps, threshold), f"{path}/links2")
        if not found.isEmpty():
            labels = stored(components(links.unionByName(found), f"{path}/components2"), f"{path}/labels2")
    gone("reps", "sets", "members", "components2", *[f"{t}{k}" for t in ("tested", "links") for k in ("0", "01", "1", "2")])
    label = labels.select(F.col("node").alias("rep"), "component")
    out = member.join(label, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open_bands(bands: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """``(key, doc_id, comp, n)`` of the bands whose members are not all in one component."""
    now = bands.select("key", "doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    now = now.select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    open_ = now.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    open_ = stored(open_.select("key", "n"), path)
    return now.join(checked_broadcast(open_, open_.count(), 16), "key")


def _prefix_pairs(members: DataFrame, sets: DataFrame, threshold: float, path: str) -> DataFrame:
    """``(a, b)``: pairs of different components that may reach the threshold, by the prefix of their rarest shingles.

    Of n shingles, any set of that similarity shares one of the first n - ceil(threshold * n) + 1 in a common order. The
    first that two sets share leaves room for no more than the shingles after it, so its places must let the overlap
    reach threshold / (1 + threshold) of both sizes; a set with many shingles of its own is not listed against others.
    """
    percent = round(threshold * 100)

    def spread(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc, comp, raw in zip(*(c.to_pylist() for c in batch.columns)):
                t = np.frombuffer(raw, "<u8").astype(np.int64)
                n = len(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, doc)), pa.array(np.full(n, comp)), pa.array(np.full(n, n, np.int32)), pa.array(t)], ["doc_id", "comp", "n", "shingle"])

    rows = members.join(sets, "doc_id").select("doc_id", "comp", "shingles")
    tokens = stored(rows.mapInArrow(spread, "doc_id long, comp long, n int, shingle long"), f"{path}/tokens")
    # Shingles of one document come first and list nothing; of the others the rarest.
    often = tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, "shingle")
    mine = Window.partitionBy("doc_id")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.col("n") - F.count("*").over(mine)
    place = F.row_number().over(mine.orderBy("df", "shingle"))
    listed = shared.withColumn("place", place).withColumn("alone", alone).withColumn("place", F.col("place") + F.col("alone"))
    listed = listed.where(F.col("place") <= prefix).select("shingle", "doc_id", "comp", "n", (F.col("n") - F.col("place") + 1).alias("rest"))
    listed = stored(listed, f"{path}/listed")
    forget(members.sparkSession, f"{path}/tokens")
    parts = listed.groupBy("shingle", "comp").agg(F.count("*").alias("size"))
    top = parts.groupBy("shingle").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    top = top.select("shingle", F.col("top.comp").alias("largest"))
    several = stored(listed.join(top, "shingle"), f"{path}/several")
    forget(members.sparkSession, f"{path}/listed")
    left = several.where("comp <> largest").select("shingle", F.col("doc_id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("rest").alias("rx"))
    right = several.select("shingle", F.col("doc_id").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("rest").alias("ry"))
    alike = (F.col("cx") != F.col("cy")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
    alike = alike & (F.least("rx", "ry") * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent)
    return left.join(right, "shingle").where(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
