import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from gridloom.llm.bpe import decode_ids, encode_texts
from gridloom.llm.transducer import Decoder, Encoder, MergeTransducer, Utf8Stream, read_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SOME = ["aab", "etaoin shrdlu", "'s'll're ", "0123456789", "éàüñ ß", "日本語テキスト", "\n \t\r\x85 ", "ab-=_*#", "😀👍🏽á", "\x00\x7f\x1c\x1d", "a b c. d", "  a \n b"]


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(rng.choice(SOME)) for _ in range(rng.randrange(120)))
        else:
            yield "".join(rng.choice(SOME[k % len(SOME)]) * rng.randrange(1, 40) for _ in range(8))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_library(name):
    path = public_tokenizers.path(name)
    want, decoder = library(path), Decoder(path)
    whole, cut = (Encoder(path, public_tokenizers.PATTERN, x) for x in (False, True))
    for text in odd_texts(1500):
        ids = whole.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text), text
        assert cut.encode(text) == ids, text
        assert decoder.decode(ids) == text.encode()


def test_long_pieces_and_forgetting(monkeypatch):
    import gridloom.llm.transducer as module

    for name, value in (("STEPS", 500), ("PIECES", 5), ("PAIRS", 50), ("WINDOW", 257)):
        monkeypatch.setattr(module, name, value)
    codec, want, rng = Encoder(RANKS, public_tokenizers.PATTERN), library(RANKS), random.Random(9)
    for letters in ("ab", "abcdefghij", "etaoinshrdlu", " ", "-", "é"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want.encode_ordinary(text)


def test_borders_against_the_merges():
    """Merges of random small vocabularies; some have tokens whose merges do not come in the order of ranks."""
    rng = random.Random(1)
    for trial in range(40):
        ranks = {bytes([b]): b for b in range(256)}
        tokens = [b"a", b"b", b"c"]
        while len(ranks) < 276:
            new = rng.choice(tokens) + rng.choice(tokens)
            if new not in ranks and len(new) < 12:
                ranks[new] = len(ranks)
                tokens.append(new)
        machine = MergeTransducer(ranks)
        want = tiktoken.Encoding("x", pat_str=r"[^ ]+| +", mergeable_ranks=ranks, special_tokens={})
        for _ in range(60):
            text = "".join(rng.choice("aabc") for _ in range(rng.randrange(1, 40)))
            assert machine.piece(text.encode()) == want.encode_ordinary(text), (trial, text)


def test_a_token_that_its_merges_do_not_make():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"abab": 258}
    machine = MergeTransducer(ranks)
    assert machine.piece(b"xyz") == [257]  # as a whole piece only
    assert machine.piece(b"xyzab") == [120, 121, 122, 256]
    assert machine.piece(b"ababab") == [258, 256]
    with pytest.raises(ValueError):
        MergeTransducer({b"a": 0})


def test_stream_of_characters():
    rng = random.Random(4)
    for k in range(600):
        raw = "".join(rng.choice("aé日😀́") for _ in range(12)).encode() if k % 2 else bytes(rng.choice(b"a\xc3\xa9\xe6\x97\xf0\x9f\x98\x80\xed\xa0\xff\xf4\x90") for _ in range(9))
        stream, out, at = Utf8Stream(), [], 0
        while at < len(raw):
            step = rng.randrange(1, 4)
            out.append(stream.feed(raw[at : at + step]))
            at += step
            assert len(stream.held) <= 3
        assert "".join(out) + stream.close() == raw.decode("utf-8", "replace"), raw
        if k % 2:
            assert "�" not in "".join(out)


def test_codec_streams_ids():
    text = "日本語 😀 text " * 50
    ids = Encoder(RANKS, public_tokenizers.PATTERN, True).encode(text)
    parts = list(Decoder(RANKS).stream(ids[i : i + 4] for i in range(0, len(ids), 4)))
    assert "".join(parts) == text and len(parts) > 100


def test_rows(spark):
    texts = [None, "", " ", "Hello, world's 123\n\n", "é日😀" * 3, "word " * 40_000, "x" * 30_000] + ["same"] * 30
    docs = spark.createDataFrame([(i // 2, t, b"i", "d") for i, t in enumerate(texts)], "doc_id long, text string, ids binary, decoded string").repartition(3)
    want = library(RANKS)
    out = decode_ids(encode_texts(docs, RANKS, public_tokenizers.PATTERN, True), RANKS)
    assert out.columns == ["doc_id", "ids", "decoded", "decoded_text"]
    rows = out.collect()
    assert sorted((r["doc_id"], r["decoded_text"]) for r in rows) == sorted((i // 2, t or "") for i, t in enumerate(texts))
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.encode_ordinary(r["decoded_text"]) and r["decoded"] == r["decoded_text"].encode()
    empty = encode_texts(docs.limit(0), RANKS, public_tokenizers.PATTERN)
    assert empty.count() == 0 and decode_ids(empty, RANKS).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(X'61C328FF' as string) as text")
    assert decode_ids(encode_texts(broken, RANKS, public_tokenizers.PATTERN), RANKS).first()["decoded_text"] == "a�(�"


def test_query(spark):
    import hashlib

    from gridloom.llm.queries import QUERIES

    want, sf = library(RANKS), "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op13_bpe_codec"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = want.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
