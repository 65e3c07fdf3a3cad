"""Helpers that the corpus operators share: shared scratch tables, component labels, word scanning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor and the driver can reach.

    Where the setting is absent, a temporary folder takes its place in local mode; on a cluster that is an error, as
    executors would not see it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and read it again: lineage ends at files that outlive executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have the driver's collector look for finished jobs: Spark deletes the shuffle files and broadcast tables of those that
    it finds unused, and the driver's heap shrinks, which else grows to its limit over many short jobs. What the driver's many
    threads have freed outside the heap goes back to the system too, where the JVM can do that (Linux, 17.0.9 on)."""
    spark._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Do what ``jcmd System.trim_native_heap`` does for the driver's JVM."""
    from py4j.protocol import Py4JJavaError

    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    args = new(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # By the interface, as the server's class is closed to others.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        call.invoke(server, args)
    except Py4JJavaError:  # a JVM that has no such command keeps the memory for later use
        pass


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Arrow batches of about ``size`` at most for jobs that run inside; a batch is held by the JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unique_ids(rows: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with one row for each number: of several, the first by text.

    ``rows`` itself if no number repeats; the texts of numbers that do not are never moved.
    """
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return rows
    one = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(again, "doc_id", "left_anti").unionByName(one)


def checked_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 8 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit in ``limit`` bytes; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 24))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # the small star drops repeated ones


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


#: Edges that one task joins up at once.
EDGES = 1 << 16


def _stars(batches: Iterator) -> Iterator:
    """Edges ``(u, v)`` as stars with the smallest id in the middle, up to EDGES of them at a time."""
    import pyarrow as pa

    def star(parts: list) -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate([*(p[0] for p in parts), *(p[1] for p in parts)]), return_inverse=True)
        a, b = ends.reshape(2, -1)
        label, before = np.arange(len(nodes)), None
        while before is None or (label != before).any():
            before = label.copy()
            low = np.minimum(before[a], before[b])
            for side in (a, b):
                np.minimum.at(label, before[side], low)
            while (label != label[label]).any():
                label = label[label]
        leaf = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[label[leaf]])], ["u", "v"])

    parts: list = []
    for batch in batches:
        for lo in range(0, batch.num_rows, EDGES):
            if sum(len(p[0]) for p in parts) + min(EDGES, batch.num_rows - lo) > EDGES:
                yield star(parts)
                parts = []
            parts.append([c.to_numpy() for c in batch.slice(lo, EDGES).columns])
    if parts:
        yield star(parts)


def components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """Label connected nodes by their smallest id: ``(node, component)`` for every node with an edge.

    ``edges`` has integer columns ``u`` and ``v``. Tasks join up EDGES edges at a time; where these are not all, large-star
    and small-star rounds alternate until the edge set no longer changes; each round is a written table, so a lost executor costs at most one round, and no node's edges are
    ever gathered in one place (the per-node minimum is a partial aggregate, joined back by key). Self-loops and rows
    with nulls are ignored.
    """
    cur = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    cur = stored(cur, f"{path}/edges")
    shares = -(-cur.count() // EDGES)
    cur = stored(cur.coalesce(max(1, shares)).mapInArrow(_stars, cur.schema), f"{path}/0")
    forget(edges.sparkSession, f"{path}/edges")
    seen = _fingerprint(cur) if shares > 1 else None
    for k in range(1, rounds + 1 if shares > 1 else 1):
        if not seen[0]:
            break
        cur = stored(_small_star(_large_star(cur)), f"{path}/{k}")
        forget(edges.sparkSession, f"{path}/{k - 1}")
        if k % 2 == 0:
            release(edges.sparkSession)
        now = _fingerprint(cur)
        if now == seen:
            break
        seen = now
    else:
        if shares > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    top = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)


# --- words and shingles, over the raw bytes of an Arrow batch -------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of a base that a worker keeps, up to so many.
_KEPT = (1 << 18) + (1 << 14)
_kept: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _kept.get(int(base), np.empty(0))
    if 0 < n <= len(known):
        return known[:n]
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        step = np.uint64(pow(int(base), k, 1 << 64))
        out[k : 2 * k] = out[: min(k, n - k)] * step
        k *= 2
    if n <= _KEPT:
        out.flags.writeable = False
        _kept[int(base)] = out
    return out[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data`` (UTF-8 bytes), with the bytes where each starts and ends.

    A-Z hash as a-z; the hash depends on the word alone, not on its place.
    """
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    n = len(data)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_P, n), dtype=np.uint64)))
    raw = (total[end] - total[start]) * _powers(_P_INV, n)[start]
    return mixed(raw + (end - start).astype(np.uint64) * _PLACE[0]), start, end


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of ``k`` words in order of place; fewer than ``k`` words make one run of all of them."""
    n = len(words)
    if not n:
        return words
    w = min(k, n)
    out = np.full(n - w + 1, np.uint64(w), np.uint64)
    for i in range(w):
        out = out + words[i : n - w + 1 + i] * _PLACE[i + 1]
    return mixed(out)


def places(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ..., lo + n - 1 of each range, one after another."""
    return np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column of an Arrow batch and the offsets of its rows; a null row is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    buf = arr.buffers()
    offsets = np.frombuffer(buf[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.empty(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows whose texts make about ``size`` bytes; a longer text is a range of its own."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def document_words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows ``lo`` to ``hi``, one row after another, and the place of each row's first word."""
    begin = offsets[lo:hi] - offsets[lo] + np.arange(hi - lo)
    apart = np.full(int(offsets[hi] - offsets[lo]) + hi - lo, 32, np.uint8)
    for i in range(lo, hi):
        at = begin[i - lo]
        apart[at : at + offsets[i + 1] - offsets[i]] = data[offsets[i] : offsets[i + 1]]
    words, start, _ = word_hashes(apart)
    return words, np.searchsorted(start, begin)
