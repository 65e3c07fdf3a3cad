"""Near-duplicate vectors by spherical-cap filters.

A random rotation splits each unit vector into two halves; each half has a code of random unit directions, and a filter
is a pair of codewords. A vector is list-decoded to all filters whose direction it exceeds ``alpha`` with, and to its
best ``LEAST`` ones at any rate: only codewords that can still reach the bound are combined, so the product code is
never enumerated. Several rotations have a code each. Vectors of one label that share a filter are compared by cosine
in double precision.

A code's size follows the number of vectors of the label, so that a filter holds about ``BUCKET`` of them; a label of
no more than ``BUCKET`` vectors has one filter, the whole sphere. ``alpha`` is set so that a vector has ``LISTED``
filters of a rotation on average. Measured on pairs of cosine 0.930 in 64 dimensions, a pair shares a filter with a
chance of 0.99 in labels of 20,000 vectors and 0.985 in labels of 200,000.

Equal vectors are one class and are compared once. A filter with more than ``CHUNK`` vectors is compared chunk by
chunk, strip by strip (``STRIP`` rows against a chunk), each pair of chunks a task's work of its own, so no vector is
left out of a full filter. A linked pair is counted at the smallest filter that it shares; a comparison yields counts
and a spanning forest of its links, not the pairs themselves.

Defined cases: a vector that is null, empty, zero or holds a null, NaN or infinity, and one without a label, links with
nothing; vectors of different lengths never link; rows of a repeated id are vectors of their own, and each takes the counts
of its vector; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import components, shared_dir, stored

#: Vectors that a filter holds on average, about.
BUCKET = 2048
#: Filters of a rotation that a vector is listed under: on average over all vectors, and at least.
LISTED, LEAST = 2, 2
#: Rotations of labels of up to 4 ** 4 * BUCKET vectors; beyond, one more for each 16-fold size.
TURNS = 3
#: Vectors of a filter that are compared in one task (with as many of another chunk).
CHUNK = 4096
#: Rows of a chunk that are multiplied at once.
STRIP = 256
_SEED = 77


class CapCode:
    """Filters of one rotation of vectors of ``dims`` dimensions: codewords of two halves and the bound ``alpha``."""

    def __init__(self, dims: int, n: int, bucket: int, turn: int):
        rng = np.random.default_rng((_SEED, turn))
        self.cut = max(1, dims // 2)
        self.words = max(2, math.ceil(math.sqrt(n * LISTED / bucket)))
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.halves = []
        for size in (self.cut, dims - self.cut):
            c = rng.standard_normal((self.words, size))
            self.halves.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))
        probe = rng.standard_normal((256, dims))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        # The bound that lists LISTED filters on average, from the largest sums of each probe.
        sums = np.concatenate([np.sort(np.add.outer(np.sort(a)[-200:], np.sort(b)[-200:]).ravel())[-4000:] for a, b in zip(*self._scores(probe))])
        self.alpha = float(np.sort(sums)[-min(len(sums), LISTED * len(probe))])

    def _scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.turn
        return y[:, : self.cut] @ self.halves[0].T, y[:, self.cut :] @ self.halves[1].T

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters of each row of ``x``: those that exceed the bound, and the best ``LEAST``."""
        a, b = self._scores(x)
        # The best sums are among the best codewords of each half.
        best = [np.sort(s, axis=1)[:, -LEAST:] for s in (a, b)]
        sums = (best[0][:, :, None] + best[1][:, None, :]).reshape(len(x), -1)
        bound = np.minimum(self.alpha, np.sort(sums, axis=1)[:, -LEAST])
        out = []
        for p, q, low, high_p, high_q in zip(a, b, bound, best[0][:, -1], best[1][:, -1]):
            i, j = np.flatnonzero(p >= low - high_q), np.flatnonzero(q >= low - high_p)
            r, s = np.nonzero(np.add.outer(p[i], q[j]) >= low)
            out.append(i[r] * self.words + j[s])
        return out


class CapCodes:
    """The codes of each size of label: size ``k`` is of labels of up to 4 ** k * ``bucket`` vectors."""

    def __init__(self, dims: int, most: int, bucket: int = BUCKET):
        self.bucket = bucket
        self.sizes: list[list[CapCode]] = [[]]
        while bucket * 4 ** (len(self.sizes) - 1) < most:
            k = len(self.sizes)
            self.sizes.append([CapCode(dims, bucket * 4**k, bucket, 100 * k + t) for t in range(TURNS + max(0, k - 3) // 2)])

    def decode(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        """The sorted filters of the unit vectors ``x`` of a label of ``n``."""
        k = 0
        while self.bucket * 4**k < n:
            k += 1
        if not k:
            return [np.zeros(1, np.int64)] * len(x)
        parts, base = [], 0
        for code in self.sizes[k]:
            parts.append([f + base for f in code.decode(x)])
            base += code.words**2
        return [np.sort(np.concatenate(p)) for p in zip(*parts)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listed(classes: DataFrame, codes: CapCodes, dims: int) -> DataFrame:
    """``(rep, label, copies, filters, listed)``; ``listed`` has the filters once more, as bytes."""
    shared = classes.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _unit(part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                n = part.column(3).to_numpy()
                filters: list = [None] * len(n)
                for size in np.unique(n):
                    mine = np.flatnonzero(n == size)
                    for i, f in zip(mine, shared.value.decode(x[mine], int(size))):
                        filters[i] = f
                raw = [f.astype("<i8").tobytes() for f in filters]
                cols = [*(part.column(i) for i in range(3)), pa.array(filters, pa.list_(pa.int64())), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "label", "copies", "filters", "listed"])

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("rep", "label", "copies", "n", "vector").mapInArrow(run, f"rep long, label {label}, copies long, filters array<long>, listed binary")


def _shared_before(lists: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, filter_: int) -> np.ndarray:
    """Whether each of ``rows`` and each of ``cols`` share a filter smaller than ``filter_``."""
    known = np.unique(np.concatenate([lists[i] for i in rows]))
    known = known[known < filter_]

    def marks(which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), len(known)), np.float32)
        flat = np.concatenate([lists[i] for i in which])
        row = np.repeat(np.arange(len(which)), [len(lists[i]) for i in which])
        at = np.searchsorted(known, flat)
        ok = at < len(known)
        ok[ok] = known[at[ok]] == flat[ok]
        out[row[ok], at[ok]] = 1
        return out

    if not len(known):
        return np.zeros((len(rows), len(cols)), bool)
    return marks(rows) @ marks(cols).T > 0


def _compare(
    reps: np.ndarray, vectors: np.ndarray, copies: np.ndarray, side: np.ndarray, lists: list[np.ndarray], filter_: int, crossed: bool, threshold: float
) -> np.ndarray:
    """``(rep, links, root)`` of the vectors of one chunk of a filter (or across a pair of chunks) that have links."""
    order = np.argsort(side, kind="stable")
    reps, x, copies = reps[order], _unit(vectors[order]), copies[order].astype(np.float64)
    lists = [lists[i] for i in order]
    # Rows of the first chunk against those of the second; of a chunk with itself, all against all.
    cut = int((side == side.min()).sum()) if crossed else len(reps)
    base = cut if crossed else 0
    if base == len(reps):  # only one of the two chunks has rows
        return np.empty((0, 3), np.int64)
    links, root, any_ = np.zeros(len(reps)), np.arange(len(reps)), np.zeros(len(reps), bool)
    for lo in range(0, cut, STRIP):
        hi = min(lo + STRIP, cut)
        linked = x[lo:hi] @ x[base:].T >= threshold
        if not crossed:
            linked[np.arange(hi - lo), np.arange(lo, hi)] = False
        some, to = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(some):
            continue
        any_[lo + some] = any_[base + to] = True
        fresh = linked[np.ix_(some, to)] & ~_shared_before(lists, lo + some, base + to, filter_)
        links[lo + some] += fresh @ copies[base + to]
        if crossed:
            links[base + to] += copies[lo + some] @ fresh
        for i in some:
            near = np.unique(np.append(root[base + np.flatnonzero(linked[i])], root[lo + i]))
            if len(near) > 1:
                root[np.isin(root, near)] = near[0]
    some = np.flatnonzero(any_)
    return np.stack([reps[some], links[some].astype(np.int64), reps[root[some]]], axis=1)


def _blocks(members: DataFrame, dims: int, threshold: float) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def flush(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
            *arrays, lists = zip(*rows)
            found = _compare(*map(np.concatenate, arrays), [f for part in lists for f in part], key[1], key[2] != key[3], threshold)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], ["rep", "links", "root"])

        key, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            reps, copies, side = (batch.column(i).to_numpy() for i in (4, 5, 6))
            vectors = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            lists = [np.frombuffer(f.as_buffer(), "<i8") for f in batch.column(8)]
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if keys[a] != key:
                    if rows:
                        yield flush(key, rows)
                    key, rows = keys[a], []
                rows.append((reps[a:b], vectors[a:b], copies[a:b], side[a:b], lists[a:b]))
        if rows:
            yield flush(key, rows)

    keys = ["label", "filter", "lo", "hi"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select(*keys, "rep", "copies", "chunk", "vector", "listed")
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, links long, root long")


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    bucket: int = BUCKET,
    path: str | None = None,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: links are pairs of one label with cosine >= ``threshold``."""
    spark = vectors.sparkSession
    path = path or shared_dir(spark)
    v = F.col(vector_col)
    sound = (
        F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.col(label_col).alias("label"), F.coalesce(sound, F.lit(False)).alias("sound"))
    good = rows.where("sound and vec_id is not null").withColumn("h", F.xxhash64("vector", "label"))
    # ``rep`` numbers the classes; written, so that it holds. An id may be the smallest of several classes.
    classes = good.groupBy("h", "label", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = stored(classes.select("*", F.monotonically_increasing_id().alias("rep")), f"{path}/classes")
    lengths = [r["dims"] for r in classes.select(F.size("vector").alias("dims")).distinct().orderBy("dims").collect()]  # few
    found = None
    for dims in lengths:
        part = _links(classes.where(F.size("vector") == dims), dims, threshold, bucket, f"{path}/d{dims}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, root long")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), f"{path}/components").withColumnRenamed("node", "rep")
    lowest = labels.join(classes.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("lowest"))
    labels = labels.join(lowest, "component").select("rep", "lowest")
    per_class = classes.join(counts, "rep", "left").join(labels, "rep", "left").select(
        "h", "label", "vector", F.coalesce("lowest", "low").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    linked = good.join(per_class, ["h", "label", "vector"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where("not sound or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, dims: int, threshold: float, bucket: int, path: str) -> DataFrame:
    """``(rep, links, root)`` rows; links are to be summed, and roots to be joined, by representative."""
    sizes = classes.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
    most = sizes.agg(F.max("n")).first()[0] or 1
    listed = stored(_listed(classes.join(sizes, "label"), CapCodes(dims, most, bucket), dims), f"{path}/listed")
    member = listed.select("rep", "label", F.explode("filters").alias("filter"))
    full = member.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1")
    member = member.join(full, ["label", "filter"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    member = member.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    member = member.select("rep", "label", "filter", "chunk", other.alias("other")).select(
        "rep", "label", "filter", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    )
    rows = member.join(listed.select("rep", "copies", "listed"), "rep").join(classes.select("rep", "vector"), "rep")
    return stored(_blocks(rows, dims, threshold), f"{path}/links")
