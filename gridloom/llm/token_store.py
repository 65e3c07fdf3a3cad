"""Token ids in a binary store: every document a zstandard frame of its own under one shared dictionary.

Store layout, all written and read by Spark: ``dictionary`` (one row: SHA-256 and bytes of the dictionary, the width of
an id) and ``blocks``: rows in ascending order of document number, each holding up to ``BLOCK_DOCS`` documents: the
concatenated frames (``payload``), the dictionary's hash, and an index of little-endian columns (document numbers,
offset of each frame in the payload, numbers of ids). A short document is read by decompressing its own frame alone.

Serialized ids are little-endian, unsigned, 2 bytes wide if the vocabulary allows it and 4 if not. The dictionary is
trained on a bounded sample (``SAMPLE_DOCS`` documents of smallest id hash, ``SAMPLE_IDS`` ids of each); it changes
sizes only, never contents.

Defined cases: a null text is encoded as empty, so its document holds the end id alone; equal document numbers are
ordered by their frames' bytes; null numbers come first and read back as null; extra columns are ignored; an empty table
makes a store without blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import checked_broadcast, chunks, text_bytes
from gridloom.llm.tokens import encoder

BLOCK_DOCS = 256
SAMPLE_DOCS = 2000
SAMPLE_IDS = 1024
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
#: Documents that a file of blocks holds, about.
FILE_DOCS = 100_000

#: Stands for a null document number.
NO_ID = -(2**63)
BLOCK_SCHEMA = "shard int, block int, n_docs int, n_ids long, dict_sha256 string, doc_ids binary, offsets binary, n_tokens binary, payload binary"


def encode_documents(
    docs: DataFrame, vocabulary: str, end_id: int, width: int, words: bytes | None, id_col: str, text_col: str, bounds: list[int] = []
) -> DataFrame:
    """``(shard, doc_id, n_tokens, frame)``: whole texts encoded, ``end_id`` appended, ids as ``width``-byte integers.

    With ``words`` (a dictionary, perhaps empty) a frame is compressed, so that only frames are shuffled; with None it
    holds the integers as they are. ``shard`` numbers the range of ``bounds`` that holds the document's number.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, kind = encoder(vocabulary), np.dtype(f"<u{width}")
        edges = np.asarray(bounds, np.int64)
        press = (lambda b: b) if words is None else _compressor(words).compress
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for lo, hi in chunks(off):
                ids, at = enc.encode(data, off[lo : hi + 1], end_id)
                raw = memoryview(ids.astype(kind)).cast("B")
                cut = (at * width).tolist()
                frames = [bytes(press(raw[a:b])) for a, b in zip(cut, cut[1:])]
                names = batch.column(0).slice(lo, hi - lo)
                shard = np.searchsorted(edges, names.fill_null(NO_ID).to_numpy(), side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), names, pa.array(np.diff(at)), pa.array(frames, pa.binary())], ["shard", "doc_id", "n_tokens", "frame"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "shard int, doc_id long, n_tokens long, frame binary"
    )


def _compressor(words: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, width: int, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary from a bounded sample of serialized ids; empty if there is too little to learn from."""
    import zstandard

    rank = F.xxhash64(F.col(id_col).cast("string"), F.lit(11))
    top = docs.select(F.col(id_col).alias("_id"), rank.alias("rank")).orderBy("rank", "_id").limit(SAMPLE_DOCS).select("_id").distinct()
    some = docs.join(F.broadcast(top), docs[id_col] == top["_id"], "left_semi")
    ids = encode_documents(some, vocabulary, end_id, width, None, id_col, text_col)
    piece = F.substring("frame", 1, SAMPLE_IDS * width)
    rows = ids.select("doc_id", piece.alias("b")).orderBy("doc_id", "b").limit(SAMPLE_DOCS)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["b"]) for r in rows.collect()]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, vocabulary_size: int, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encode ``docs`` and write the store at ``path``; returns the path."""
    spark = docs.sparkSession
    width = 2 if vocabulary_size <= 1 << 16 else 4
    words = train_dictionary(docs, vocabulary, end_id, width, id_col, text_col)
    sha = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(sha, words, width)], "dict_sha256 string, dictionary binary, width int").write.parquet(f"{path}/dictionary")
    # Files by ranges of document numbers, whose bounds come from the number column alone: texts are encoded once.
    names = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n_docs = names.count()
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_docs // FILE_DOCS))
    marks = [i / files for i in range(1, files)]
    bounds = sorted(set(names.agg(F.percentile_approx("doc_id", marks, 100 * files)).first()[0] or [])) if marks else []

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shard, block, names, frames, counts = None, 0, [], [], []

        def flush():
            nonlocal block, names, frames, counts
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<i8")
            row = {
                "shard": shard, "block": block, "n_docs": len(frames), "n_ids": int(sum(counts)), "dict_sha256": sha,
                "doc_ids": np.asarray([NO_ID if x is None else x for x in names], "<i8").tobytes(),
                "offsets": offsets.tobytes(), "n_tokens": np.asarray(counts, "<i8").tobytes(), "payload": b"".join(frames),
            }
            block, names, frames, counts = block + 1, [], [], []
            return pa.RecordBatch.from_pylist([row], _block_arrow())

        for batch in batches:
            for at, doc, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if frames and (at != shard or len(frames) == BLOCK_DOCS):
                    yield flush()
                if at != shard:
                    shard, block = at, 0
                names.append(doc)
                counts.append(n)
                frames.append(frame)
        if frames:
            yield flush()

    frames = encode_documents(docs, vocabulary, end_id, width, words, id_col, text_col, bounds)
    ordered = frames.repartition(files, "shard").sortWithinPartitions("shard", "doc_id", "frame")
    ordered.mapInArrow(pack, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def _block_arrow():
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in BLOCK_SCHEMA.split(", "))])


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, block, start)``: ids in all blocks before, from sums by file and then within a file."""
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "n_ids")
    before = (Window.unboundedPreceding, -1)
    files = blocks.groupBy("shard").agg(F.sum("n_ids").alias("s"))
    files = files.select("shard", F.coalesce(F.sum("s").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(*before)), F.lit(0))
    return blocks.withColumn("in", inside).join(files, "shard").select("shard", "block", (F.col("base") + F.col("in")).alias("start"))


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files alone; with ``doc_ids``, only these documents' frames are opened.

    With ``digest`` the ids' crc32 (of little-endian unsigned 32-bit integers) takes their place as ``ids_crc32``.
    """
    head = spark.read.parquet(f"{path}/dictionary").first()
    words, sha, width = bytes(head["dictionary"]), head["dict_sha256"], head["width"]
    last = "ids_crc32" if digest else "ids"
    wanted = None if doc_ids is None else np.asarray(sorted(doc_ids), np.int64)

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dict_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                names, at, n = (np.frombuffer(row[c], "<i8") for c in ("doc_ids", "offsets", "n_tokens"))
                start = row["start"] + np.concatenate(([0], np.cumsum(n)[:-1]))
                pick = range(len(names)) if wanted is None else np.flatnonzero(np.isin(names, wanted))
                payload = memoryview(row["payload"])
                ids = [open_.decompress(payload[at[i] : at[i + 1]], max_output_size=int(n[i]) * width) for i in pick]
                pick = np.fromiter(pick, np.int64)
                if digest:
                    ids = [zlib.crc32(np.frombuffer(b, f"<u{width}").astype("<u4")) for b in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[pick], mask=names[pick] == NO_ID),
                        pa.array(start[pick]),
                        pa.array(n[pick]),
                        pa.array(ids, pa.int64() if digest else pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", last],
                )

    blocks = spark.read.parquet(f"{path}/blocks")
    starts = checked_broadcast(block_starts(spark, path), blocks.count(), 24)  # a row a block
    blocks = blocks.join(starts, ["shard", "block"])
    cols = ["dict_sha256", "doc_ids", "offsets", "n_tokens", "payload", "start"]
    return blocks.select(*cols).mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {last} {'long' if digest else 'binary'}")
