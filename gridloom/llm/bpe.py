"""Encoding of texts into token ids and back, over DataFrames (see ``transducer``).

Every match of the pattern is a piece; a piece that is a token is that token, any other one is merged by rank. The ids are
those of the ``tiktoken`` library's ordinary encoding. No shuffle: texts are encoded and decoded where they are read, row
by row, so memory follows the longest text.

Defined cases: a null or empty text has no ids and decodes to no bytes; bytes that are no UTF-8 are read as U+FFFD; repeated
rows and ids are encoded one by one; columns other than those named are left out (``keep`` names more); an empty table gives
an empty result; ids that the vocabulary does not have fail with an error when decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of texts in a batch that is handed on.
PART = 4 << 20


def _parts(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``PART`` bytes."""
    lo = hi = total = 0
    for size in sizes:
        hi, total = hi + 1, total + size
        if total >= PART:
            yield lo, hi
            lo, total = hi, 0
    if hi > lo:
        yield lo, hi


def encode_texts(
    docs: DataFrame, ranks: str, pattern: str, lone_space_begins: bool = False, text_col: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` and ``ids binary``: the ids of each text as little-endian unsigned 32-bit integers.

    ``lone_space_begins`` tells that a single space between two characters that are no blanks always begins a match of the
    pattern, and that a space and letters alone are one match.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("ids"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        from gridloom.llm.transducer import encoder

        encode = encoder(ranks, pattern, lone_space_begins).encode
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in _parts(pc.binary_length(texts).to_pylist()):
                ids = [encode(x.as_py().decode("utf-8", "replace")) for x in texts.slice(lo, hi - lo)]
                rest = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, texts.type)], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes of its ``ids``, and ``decoded_text``, those bytes read as a stream of UTF-8."""
    at = encoded.columns.index("ids")
    schema = encoded.select("*", F.col("ids").alias("decoded"), F.lit("").cast("string").alias("decoded_text")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        from gridloom.llm.transducer import Utf8Stream, decoder

        decode = decoder(ranks).decode
        for batch in batches:
            for lo, hi in _parts(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
                part, raw, text = batch.slice(lo, hi - lo), [], []
                for ids in part.column(at):
                    buffer, stream, whole, read = ids.as_py() or b"", Utf8Stream(), [], []
                    for i in range(0, len(buffer), PART):
                        whole.append(decode(buffer[i : i + PART]))
                        read.append(stream.feed(whole[-1]))
                    raw.append(b"".join(whole))
                    text.append("".join(read) + stream.close())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary()), pa.array(text, pa.string())], names=[*batch.schema.names, "decoded", "decoded_text"])

    return encoded.mapInArrow(run, schema)
