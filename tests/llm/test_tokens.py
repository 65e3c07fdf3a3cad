import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import packing, token_store, tokens
from gridloom.llm.common import shared_dir, text_bytes
from gridloom.llm.tokens import StretchEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [
    "", " ", "  ", " a", "a ", "a  b", "x\n y", "x \ny", "é é ́x", "a\x1cb c", "<|endoftext|> a <|endoftext|>b",
    "don't 's I'll  it's", "a b c　 d", "\n\n a\n", "1 2 34 5six", "a ​ b", "a.,b", ". a", "a_, b",
    "á, b", "x.\n\ny", "x\n.y", "it's, I'm.", "² 3.5", "END!! the&&& | x", "a\x01 b", "퟿, \U0001f600.\n", "Ü, ß. À la",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_stretches_give_the_ids_of_whole_texts(name, monkeypatch):
    enc = StretchEncoder(public_tokenizers.path(name))
    rng = random.Random(3)
    bits = [*"abcXYZ019 .,\n\t'’éàßÉ×÷ñ_-–—!?()[]\"“”\u00a0\u3000\u0301\u03a3\u03c2жД日本\U0001f642\x00\x1c\r<|>", "  ", " \n", "\n\n", " .", ",,", "..", "<|endoftext|>", "'s", "'ll", " the", " é"]
    texts = ODD * 2 + [" ".join(ODD), "".join(ODD)] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    data, off = text_bytes(pa.array([*texts, None]))
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)] + [[]]
    for keep, part in ((1_500_000, 1 << 20), (50, 300)):  # at once, and in small parts with a table that is emptied again and again
        monkeypatch.setattr(tokens, "KEEP", keep)
        monkeypatch.setattr(tokens, "PART", part)
        for lo, hi in ((0, 40), (40, len(texts) + 1)):
            ids, at = enc.encode(data, off[lo : hi + 1], 7)
            assert at[-1] == len(ids)
            for k in range(lo, hi):
                assert ids[at[k - lo] : at[k - lo + 1]].tolist() == [*want[k], 7], k


def rows(spark):
    texts = [*ODD, None, "word " * 5000, "same", "same"]
    data = [(len(texts) - i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, ids string").repartition(3), data


def test_store_round_trip(spark):
    docs, data = rows(spark)
    path = token_store.write_store(docs, shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), 1, 49408)
    tok = StretchEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    got = {r["doc_id"]: r for r in token_store.read_store(spark, path).collect()}
    start = 0
    for doc, text, _ in sorted(data):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        r = got[doc]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert np.frombuffer(r["ids"], "<u2").tolist() == ids
        start += len(ids)
    assert len(got) == len(data)
    some = token_store.read_store(spark, path, [3, 5]).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 5]
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_store.read_store(spark, path, digest=True).collect()}
    assert crc[1] == zlib.crc32(np.asarray([*tok.encode("same").ids, 1], "<u4").tobytes())
    empty = token_store.write_store(docs.limit(0), shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"), 1, 49408)
    assert token_store.read_store(spark, empty).count() == 0


def check_plan(plan, counts, capacity):
    used = {}
    for items, n in plan:
        assert sum(items) <= capacity and n > 0
        for s in items:
            used[s] = used.get(s, 0) + n
    assert used == counts
    return sum(n for _, n in plan)


def brute(items, capacity):
    """The fewest bins, by search over set partitions."""
    best = [len(items)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for i, room in enumerate(bins):
            if room >= items[k] and room not in seen:
                seen.add(room)
                put(k + 1, [*bins[:i], room - items[k], *bins[i + 1 :]])
        put(k + 1, [*bins, capacity - items[k]])

    put(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(5)
    for _ in range(150):
        cap = int(rng.integers(10, 40))
        items = sorted((int(x) for x in rng.integers(1, cap + 1, rng.integers(1, 10))), reverse=True)
        counts = {s: items.count(s) for s in items}
        plan, bound = packing.bin_completion(counts, cap)
        n = check_plan(plan, counts, cap)
        best = brute(items, cap)
        assert bound <= best <= n
        assert n == best, (items, cap)


def test_bin_completion_meets_the_bound_on_many_items():
    rng = np.random.default_rng(6)
    sizes = np.minimum(2048, rng.lognormal(6.4, 0.8, 50_000).astype(int) + 1)
    counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan, bound = packing.bin_completion(counts, 2048)
    assert check_plan(plan, counts, 2048) <= bound * 1.002 + 1


def test_pack_places_every_piece_once(spark):
    docs, data = rows(spark)
    placed, tokens = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 64, 50257)
    got = placed.toPandas()
    tok = StretchEncoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    for doc, text, _ in data:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 64).all() and own.length.max() <= 64
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    seqs = packing.sequences(placed, tokens).collect()
    assert sum(r["n_tokens"] for r in seqs) == got.length.sum() and all(len(r["ids"]) == 2 * r["n_tokens"] for r in seqs)
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 0)[0].count() == 0
