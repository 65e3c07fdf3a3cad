"""Language identification by the nearest of several centroids a language.

Training: a bounded sample of labelled documents becomes TF-IDF vectors of hashed byte 1- to 3-grams, scaled to
length one; each language's vectors are clustered by spherical k-means into a few centroids, and the distances of texts held
out from that clustering set, by length, the distance beyond which a text is rejected. Prediction: cosine with all centroids; the nearest decides.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; very long texts are read
whole; rows repeat as they come; with no labelled text every text is ``und``, and none with a letter is rejected, as
there is nothing to measure it by; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import forget, mixed, shared_dir, stored, text_bytes

#: Hashed n-gram space.
DIMS = 1 << 14
#: At most so many labelled documents a language are learned from, those of smallest id hash.
SAMPLE_PER_LANGUAGE = 500
CENTROIDS = 4
#: Bytes at which the length classes of the bounds part.
LENGTHS = (60, 200, 1000)
#: A text is rejected if its cosine is below this part of a low quantile of its language's held-out texts, by length class.
REJECT_PART = (0.4, 0.6, 0.6, 0.6)
REJECT_QUANTILE = 0.01
#: Languages of fewer texts, which cannot hold out any, have the lowest bound.
LEAST_TEXTS, LEAST_COSINE = 20, 0.05
_LETTER = r"\p{L}"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_FOLD[:65] = 32  # blanks, digits and punctuation part words and are alike
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of a text's bytes and how often each occurs."""
    b = _FOLD[data].astype(np.uint64)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0)
    h = b + np.uint64(1)
    counts = np.bincount((mixed(h) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)
    for n in (1, 2):
        if len(b) > n:
            h = h[:-1] * np.uint64(257) + b[n:] + np.uint64(1)
            counts = counts + np.bincount((mixed(h) % np.uint64(DIMS)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(float)


class CentroidModel:
    """Languages, IDF, centroids (a row each) and the least cosine of each language and length class."""

    def __init__(self, idf: np.ndarray, fitted: list[tuple[str, np.ndarray, np.ndarray]]):
        self.idf, self.langs = idf, [lang for lang, _, _ in fitted]
        self.owner = np.repeat(np.arange(len(fitted)), [len(c) for _, c, _ in fitted])
        self.least = [least for _, _, least in fitted]
        self.table = np.ascontiguousarray(np.concatenate([c for _, c, _ in fitted]).T) if fitted else np.zeros((DIMS, 0), np.float32)

    def predict(self, data: np.ndarray) -> tuple[str, float, bool]:
        at, n = grams(data)
        if not len(at) or not self.langs:
            return "und", 0.0, bool(self.langs)
        v = (1 + np.log(n)) * self.idf[at]
        cos = (v @ self.table[at]) / max(float(np.sqrt(v @ v)), 1e-12)
        k = int(cos.argmax())
        score = float(min(1.0, max(0.0, cos[k])))
        lang = self.owner[k]
        return self.langs[lang], score, bool(score < self.least[lang][np.searchsorted(LENGTHS, len(data), side="right")])


def fit_language(rows: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], idf: np.ndarray, clusters: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language's texts (hashed n-grams and their counts), and its least cosines by length class."""
    own = np.zeros((len(rows), DIMS), np.float32)
    for i, (at, n) in enumerate(rows):
        own[i, at] = (1 + np.log(n)) * idf[at]
        own[i] /= max(float(np.linalg.norm(own[i])), 1e-12)
    return _spherical_kmeans(own, clusters), _bounds(own, np.searchsorted(LENGTHS, sizes, side="right"), clusters)


def _bounds(own: np.ndarray, classes: np.ndarray, clusters: int) -> np.ndarray:
    """The least cosine of a language by length class, from every fifth text against centroids of the others."""
    out = np.full(len(LENGTHS) + 1, LEAST_COSINE)
    if len(own) < LEAST_TEXTS:
        return out
    held = np.arange(len(own)) % 5 == 0
    best = (own[held] @ _spherical_kmeans(own[~held], clusters).T).max(axis=1)
    for k, part in enumerate(REJECT_PART):
        alike = best[classes[held] == k]
        low = np.quantile(alike if len(alike) >= LEAST_TEXTS else best, REJECT_QUANTILE)
        out[k] = max(LEAST_COSINE, part * low)
    return out


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` unit centroids; seeds are spread (each the vector farthest from those before it), no chance."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> CentroidModel:
    """A model from at most ``sample`` documents of each language (those of smallest id hash; a documented bound).

    One scan of ids and languages chooses them, another reads their texts and counts their n-grams; each language is
    clustered in a task of its own, and the driver gets centroids. Chosen documents without a letter, and null ids, teach
    nothing.
    """
    rank = F.xxhash64(F.col(id_col).cast("string"), F.col(lang_col))
    names = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), rank.alias("rank")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "id"))
    chosen = names.withColumn("place", place).where(F.col("place") <= sample).select("id", "lang")

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, at = text_bytes(batch.column(1))
            found = [grams(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            raw = [[v.astype("<i4").tobytes() for v in pair] for pair in found]
            cols = [pa.array([r[k] for r in raw], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), *cols], ["lang", "size", "grams", "counts"])

    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    texts = texts.join(F.broadcast(chosen), ["id", "lang"]).where(F.col("t").rlike(_LETTER))  # at most sample rows a language
    texts = texts.groupBy("id", "lang").agg(F.min("t").alias("t")).select("lang", "t")
    path = shared_dir(labelled.sparkSession)
    counts = stored(texts.mapInArrow(counted, "lang string, size long, grams binary, counts binary"), path)

    def seen(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for g in batch.column(0):
                total[np.frombuffer(g.as_buffer(), "<i4")] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "seen"])

    parts = counts.select("grams").mapInArrow(seen, "n long, seen binary").where("n > 0").collect()  # DIMS counts a partition of the sample
    if not parts:
        forget(labelled.sparkSession, path)
        return CentroidModel(np.zeros(DIMS), [])
    idf = np.log((1 + sum(r["n"] for r in parts)) / (1 + sum(np.frombuffer(r["seen"], np.int64) for r in parts))) + 1

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def done() -> pa.RecordBatch:
            centroids, least = fit_language(rows, sizes, idf)
            return pa.RecordBatch.from_pylist([{"lang": lang, "centroids": centroids.astype("<f4").tobytes(), "least": least.tobytes()}])

        lang, rows, sizes = None, [], []
        for batch in batches:
            for who, size, g, c in zip(*(col.to_pylist() for col in batch.columns)):
                if who != lang and rows:
                    yield done()
                    rows, sizes = [], []
                lang = who
                rows.append((np.frombuffer(g, "<i4"), np.frombuffer(c, "<i4").astype(float)))
                sizes.append(size)
        if rows:
            yield done()

    ordered = counts.repartition("lang").sortWithinPartitions("lang", "grams", "counts")  # at most sample texts a language
    fitted = ordered.mapInArrow(fit, "lang string, centroids binary, least binary").collect()
    forget(labelled.sparkSession, path)
    return CentroidModel(idf, [(r["lang"], np.frombuffer(r["centroids"], "<f4").reshape(-1, DIMS), np.frombuffer(r["least"], float)) for r in sorted(fitted, key=lambda r: r["lang"])])


def identify(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` for every row; whole texts, one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x (languages * CENTROIDS) floats: bounded

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            letter = batch.column(2).to_pylist()
            out = [m.predict(data[at[i] : at[i + 1]]) if letter[i] else ("und", 0.0, True) for i in range(len(letter))]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    letters = F.coalesce(F.col(text_col).rlike(_LETTER), F.lit(False)).alias("letter")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), letters).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )
