import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from gridloom.llm import phrases, spelling
from gridloom.llm.phrases import blocks, mine_phrases, normalised
from gridloom.llm.spelling import count_words, group_variants


def near_by_force(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_force(counts, ratio=2):
    near = {w: [v for v in counts if near_by_force(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    rows = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return rows


def test_variants_against_all_pairs(spark):
    rng = random.Random(2)
    counts = {}
    for _ in range(700):
        counts["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8)))] = rng.choice([1, 2, 3, 3, 6, 12, 40, 100])
    long = "".join(rng.choice("abc") for _ in range(3000))
    counts |= {long: 9, long[:100] + "z" + long[101:]: 3, long[:2000] + long[2001:]: 30, "q" * 2048: 5, "q" * 2049: 1, "aaaaaaaa": 7, "aaaaaaa": 70}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in group_variants(words).collect()}
    assert got == variants_by_force(counts)
    assert group_variants(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        group_variants(words, ratio=1)


def test_words_are_counted(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["House", "haus", "Straße", "garden", "gardens", "ÉTÉS", "x1y2longer", "it's"]) for _ in range(rng.randrange(300))) for _ in range(120)]
    data = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "garden gardén", "y", 2), (500, None, "z", 3), (501, "", "z", 3), (502, "!!! 12", "z", 3), (3, texts[3], "x", 1), (600, "wordy" * 4000, None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, word string, n int").repartition(4)
    want = Counter()
    for i, t, _, _ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {r["word"]: r["n"] for r in count_words(docs, every=7).collect()} == want
    assert count_words(docs.limit(0), every=7).count() == 0


def phrases_by_force(rows, most, least, cover, first):
    out = []
    f, n = {}, Counter()
    for text, lang in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            words = re.findall(r"[^\x20\x09]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in piece))
            n["und" if lang is None else lang] += len(words)
            for k in range(1, most + 1):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        rows.sort()
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(rows[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("most,lg,shard", [(3, None, 1 << 20), (4, 3, 40)])
def test_phrases_against_force(spark, monkeypatch, most, lg, shard):
    monkeypatch.setattr(phrases, "BLOCK", 3000)
    monkeypatch.setattr(phrases, "PART", 256)
    rng = random.Random(most)
    words = ["New", "york", "city", "the", "of", "a", "À", "à", "x-y", "日本", "\x00", "'s"] + [f"w{i}" for i in range(15)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\t ", ". ", "\n", " \n ", ",", "  ", "\r\n", "\x0b", " ;"]) for _ in range(n))
    rows = [(text(rng.randrange(60)), rng.choice(["en", "fr", None, "und", ""])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), (" \n\t. ,", "xx"), ("New York City " * 40 + "\n", "en"), (text(4000), "en"), ("a a a a a a a a a a a a a", "fr")] + [rows[5]] * 20
    docs = spark.createDataFrame([(i, t, lang, "p", 3) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, score int").repartition(3)
    got = mine_phrases(docs, most=most, least=10, cover=50, first=60, lg_cells=lg, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_force(rows, most, 10, 50, 60)
    assert mine_phrases(docs.limit(0)).count() == 0


def test_rows_of_counts_follow_the_input(spark):
    """Four times the text, of which each part has candidates of its own: four times the rows, not sixteen times."""
    rng = random.Random(8)
    made = {}
    for n in (1, 4):
        rows = [(" ".join(f"w{part}x{rng.randrange(30)}" for _ in range(6000)), "en") for part in range(n)]
        parts = blocks(spark.createDataFrame(rows, "text string, lang string").coalesce(1))
        made[n] = phrases.tallies(parts, 3, 2, 20, shard=10_000).count()
    assert 3.5 * made[1] < made[4] < 4.5 * made[1]


def test_an_automaton_of_places_counts_all_its_runs():
    rng = np.random.default_rng(6)
    text = rng.integers(0, 6, 500)
    words = {b"w%d" % i: i for i in range(6)}
    hot = [np.array([i for i in range(len(text) - k + 1) if text[i] < 3 and text[i + 1] < 3]) for k in (2, 3)]
    machine = phrases.Automaton.of_places(words, text, hot)
    for k in (1, 2, 3):
        runs = [tuple(text[i : i + k].tolist()) for i in (hot[k - 2] if k > 1 else range(len(text)))]
        assert dict(zip(zip(*(w.tolist() for w in machine.runs(k))), machine.counts[k - 1].tolist())) == {r: runs.count(r) for r in runs}


def test_blocks_keep_words(spark):
    text = "A  b,c\n\n d\te .;"
    assert normalised(text.encode()) == b" a b \n c \n d e \n "
    docs = spark.createDataFrame([(text, "en"), ("word " * 5, None), (",", "en")], "text string, lang string")
    assert {(r["lang"], r["words"]) for r in blocks(docs).groupBy("lang").sum("words").withColumnRenamed("sum(words)", "words").collect()} == {("en", 5), ("und", 5)}


def test_scores_past_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_001)], "a long, l1 long, r1 long")
    assert row.select(phrases._score(1).alias("s")).first()["s"] == 1_000_000 * 3_000_000_000_000**2 // (4_000_000_000_000 * 5_000_000_000_001)


def test_keys_of_letters():
    (k1, k2), of = spelling._keys(["abcde", "abxde", "abde", "aabcde"], "wildcard")
    keys = {}
    for a, b, w in zip(k1.tolist(), k2.tolist(), of.tolist()):
        keys.setdefault((a, b), set()).add(w)
    assert sorted(map(sorted, keys.values())).count([0, 1]) == 1 and len(keys) == 5 + 5 + 4 + 6 - 1
    (k1, k2), of = spelling._keys(["aabcde", "bbbb"], "deletion")
    assert of.tolist() == [0] * 5 + [1]
    (w1, w2), _ = spelling._keys(["abcde", "bbb"], "whole")
    assert w1[0] in k1[:5] and w2[0] in k2[:5] and w1[1] == k1[5] and w2[1] == k2[5]


def test_an_automaton_of_words_is_small_and_counts_runs():
    """A full shard of candidates takes less than 150 MB with all of its parts; counts are those of plain windows."""
    import tracemalloc

    rng = np.random.default_rng(5)
    text = [b"word%d" % x for x in rng.integers(0, 40, 3000)]
    text[1000] = b"\n"
    wanted = [b" ".join(text[i : i + k]) for i, k in [(3, 2), (9, 3), (20, 3), (33, 2)]] + [b"word1 nothing word2"]
    machine = phrases.Automaton(wanted, 3)
    machine.read(b" " + b" ".join(text) + b" ")
    plain = lambda p: sum(text[i : i + len(p)] == p for i in range(len(text)))
    for i, p in enumerate(w.split(b" ") for w in wanted):
        first = machine.first[i : i + 1]
        for k in range(len(p)):
            for n in range(1, len(p) - k + 1):
                assert machine.of(first + k, np.array([n]))[0] == plain(p[k : k + n])
    many = [b"word%d some%d thing%d" % tuple(x) for x in rng.integers(0, 9999, (phrases.SHARD // 29, 3))]
    assert phrases.SHARD * 0.9 < sum(map(len, many)) + 2 * len(many) < phrases.SHARD * 1.1
    tracemalloc.start()
    phrases.Automaton(many, 3)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
