import numpy as np
import pytest
from gridloom.llm.line_dedup import remove_boilerplate
from gridloom.llm.substring_dedup import compact_windows, repeated_passages


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 100_000, n)]


def test_compact_windows_hold_all_runs():
    rng = np.random.default_rng(1)
    for width in (1, 4, 9):
        h = rng.integers(1, 2**63, 80).astype(np.uint64)
        want = {}
        for i in range(80):
            for j in range(i + width - 1, 80):
                want[i, j] = i + int(np.argmin(h[i : j + 1]))
        got = {}
        for left, c, right in compact_windows(h, width):
            for i in range(left, c + 1):
                for j in range(max(c, i + width - 1), right + 1):
                    got[i, j] = c
        assert got == want


def passages_by_force(texts, words_, threshold):
    """(doc_id, place) of all passages with a similar one in an earlier document."""
    width = words_ - 4
    sets = {}
    for doc, t in texts.items():
        w = t.lower().split() if t else []
        sh = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        sets[doc] = [set(sh[i : i + width]) for i in range(len(sh) - width + 1)]
    return {
        (b, i) for b in sets for a in sets if a < b for i, x in enumerate(sets[b]) for y in sets[a]
        if len(x & y) >= threshold * len(x | y)
    }


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    long, short = words(rng, 90), words(rng, 40)
    changed = [*long[:45], "other", *long[46:]]
    texts = {i: " ".join(words(rng, 120)) for i in range(1, 5)}
    texts |= {i: " ".join([*words(rng, 60), *long, *words(rng, 30)]) for i in range(5, 25)}  # a passage of many documents
    texts |= {30: " ".join([*words(rng, 10), *changed]).upper(), 31: " ".join([*words(rng, 70), *short, *words(rng, 70)]), 32: " ".join([*short, *words(rng, 70)])}
    texts |= {40: None, 41: "", 42: "few words", 43: texts[1], 44: texts[1]}
    return texts


def test_repeated_passages(spark, corpus):
    docs = spark.createDataFrame([(k, v, "x") for k, v in corpus.items()], "doc_id long, text string, key string").repartition(3)
    got = repeated_passages(docs).collect()
    by_force = passages_by_force(corpus, 50, 0.75)
    assert {r["doc_id"] for r in got} == {d for d, _ in by_force} == {*range(6, 25), 30, 43, 44}
    for r in got:
        assert r["other_id"] < r["doc_id"]
        near = {i for d, i in by_force if d == r["doc_id"]}
        # Only places that have a similar passage lie in a span, and equal passages are covered whole.
        assert min(near) <= r["first_word"] and r["first_word"] + r["n_words"] <= max(near) + 50
    spans = {r["doc_id"]: (r["first_word"], r["first_word"] + r["n_words"]) for r in got}
    assert all(spans[d][0] <= 60 + 15 and spans[d][1] >= 150 - 15 for d in range(6, 25))
    assert spans[43][1] - spans[43][0] >= 100
    assert repeated_passages(docs.limit(0)).count() == 0


def test_passages_that_repeat_words_and_odd_rows(spark):
    rng = np.random.default_rng(21)
    loop = words(rng, 7) * 30  # few distinct shingles
    texts = {1: " ".join(loop), 2: " ".join([*words(rng, 30), *loop[3:]]), 3: " ".join(words(rng, 300)), 4: "word " * 400, 5: "word " * 90 + "x", 6: None, 7: " \n"}
    by_force = passages_by_force(texts, 50, 0.75)
    rows = [(k, v, 1) for k, v in texts.items()] + [(3, "zz", 1), (None, texts[1], 1)]  # a number of two texts, and none
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(3)).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in by_force} == {2, 5}
    for r in got:
        near = {i for d, i in by_force if d == r["doc_id"]}
        assert min(near) <= r["first_word"] and r["first_word"] + r["n_words"] <= max(near) + 50


def test_chains_in_a_large_key(spark):
    """Documents that share a passage too short to count, and of which pairs share the words beside it too."""
    rng = np.random.default_rng(17)
    hot, texts, want = words(rng, 30), {}, set()
    for k in range(40):
        side = words(rng, 40)
        for d in (2 * k, 2 * k + 1):
            texts[d] = " ".join([*words(rng, 20), *hot, *side, *words(rng, 30)])
        want.add((2 * k + 1, 2 * k))
    got = {(d, o) for d, _, _, _, o in spans_of(spark, texts)}
    assert got == want


def test_similar_passages_are_found(spark):
    """Passages of 60 words with words changed: nine of ten of those that have a similar passage are found."""
    rng = np.random.default_rng(23)
    texts = {}
    for k in range(150):
        one = words(rng, 60)
        two = list(one)
        for p in rng.integers(0, 60, 1 + k % 2):
            two[p] = f"z{p}"
        texts[2 * k], texts[2 * k + 1] = " ".join([*words(rng, 40), *one, *words(rng, 40)]), " ".join([*words(rng, 25), *two, *words(rng, 25)])
    by_force = {d for k in range(0, 300, 2) for d, _ in passages_by_force({k: texts[k], k + 1: texts[k + 1]}, 50, 0.75)}
    got = {d for d, *_ in spans_of(spark, texts)}
    assert got <= by_force and len(got) >= 0.95 * len(by_force) > 50


def spans_of(spark, texts, **how):
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {(r["doc_id"], r["first_word"], r["n_words"], r["n_passages"], r["other_id"]) for r in repeated_passages(frame, **how).collect()}


def test_short_exact_passages_in_other_surroundings_are_found_whole(spark):
    rng = np.random.default_rng(11)
    texts, want = {}, set()
    for k in range(60):
        n = 50 + k % 4
        hot = words(rng, n)
        a, b = int(rng.integers(0, 60)), int(rng.integers(0, 60))
        texts[2 * k] = " ".join([*words(rng, a), *hot, *words(rng, 60)])
        texts[2 * k + 1] = " ".join([*words(rng, b), *hot, *words(rng, 60)])
        want.add((2 * k + 1, b, n, 2 * k))
    by_force = passages_by_force({k: v for k, v in texts.items() if k < 20}, 50, 0.75)
    got = spans_of(spark, texts)
    assert {(d, o) for d, _, _, _, o in got} == {(d, o) for d, _, _, o in want}
    for d, at, n, _, _ in got:  # the whole passage; up to 6 strange words at an end stay alike
        first, size = next((w[1], w[2]) for w in want if w[0] == d)
        assert at <= first and at + n >= first + size
        if d < 20:
            near = sorted(i for e, i in by_force if e == d)
            assert (at, n) == (near[0], near[-1] - near[0] + 50)


def test_line_dedup(spark):
    data = [(i, f"unique {i}\n  shared line \nnear {i % 3}\n\n", f"s{i % 9}" if i % 9 else None, "z") for i in range(40)]
    data += [(100, None, "s1", "z"), (101, "", "s1", "z"), (102, "shared line", "s1", "z"), (102, "shared line", "s1", "z"), (None, "kept\nshared line", "q", "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, line string").repartition(3)
    got = sorted(remove_boilerplate(docs, min_sites=9).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(data)
    assert (got[0]["n_lines"], got[0]["n_removed"], got[0]["clean_text"]) == (3, 1, "unique 0\nnear 0\n\n")
    assert [(r["n_lines"], r["n_removed"], r["clean_text"]) for r in got[40:]] == [(0, 0, ""), (0, 0, ""), (1, 1, ""), (1, 1, ""), (2, 1, "kept")]
    assert remove_boilerplate(docs.limit(0)).count() == 0
    assert all(r["n_removed"] == 0 for r in remove_boilerplate(docs, min_sites=11).collect())


def test_short_exact_passages_of_a_large_key(spark):
    """Pairs of documents that share 52 words of which all documents share 40: every pair is found."""
    rng = np.random.default_rng(31)
    hot, texts, want = words(rng, 40), {}, set()
    for k in range(200):
        before = int(rng.integers(0, 13))
        one = [*words(rng, before), *hot, *words(rng, 12 - before)]
        for d in (2 * k, 2 * k + 1):
            texts[d] = " ".join([*words(rng, int(rng.integers(5, 40))), *one, *words(rng, 30)])
        want.add(2 * k + 1)
    got = {d for d, *_ in spans_of(spark, texts)}
    assert want <= got


def test_hashes_of_runs_of_words():
    from gridloom.llm.substring_dedup import _run_hashes

    rng = np.random.default_rng(3)
    words_ = rng.integers(1, 2**63, 6, dtype=np.uint64)[rng.integers(0, 6, 5000)]
    at = np.arange(len(words_) - 5 + 1)
    h1, h2 = _run_hashes(words_, at, 5)
    seen = {}
    for i in at.tolist():
        seen.setdefault(tuple(words_[i : i + 5].tolist()), set()).add((int(h1[i]), int(h2[i])))
    assert all(len(v) == 1 for v in seen.values()) and len({v for s in seen.values() for v in s}) == len(seen)


def test_large_keys_without_broadcast_joins(spark):
    """The partners of small and large keys come from two tables; their join must not rest on how either is dealt."""
    rng = np.random.default_rng(41)
    hot, texts = words(rng, 30), {}
    for k in range(20):
        side = words(rng, 40)
        for d in (2 * k, 2 * k + 1):
            texts[d] = " ".join([*words(rng, 20), *hot, *side, *words(rng, 30)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {d: o for d, _, _, _, o in spans_of(spark, texts)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {2 * k + 1: 2 * k for k in range(20)}


def test_similar_passages_of_a_large_key(spark):
    """Pairs that share 52 words but for one, of which all documents share 38: no 50 words are equal, every pair is found."""
    rng = np.random.default_rng(43)
    hot, texts = words(rng, 38), {}
    for k in range(120):
        one = [*words(rng, 6), *hot, *words(rng, 8)]
        for d in (2 * k, 2 * k + 1):
            texts[d] = " ".join([*words(rng, int(rng.integers(5, 40))), *one, *words(rng, 30)])
            one[-3] = "other"
    got = {(d, o) for d, _, _, _, o in spans_of(spark, texts)}
    assert got == {(2 * k + 1, 2 * k) for k in range(120)}


def test_rare_shingles_are_met_by_any_similar_passage():
    from gridloom.llm.substring_dedup import rare_shingles

    rng = np.random.default_rng(47)
    for width, percent in ((46, 75), (12, 60)):
        sh = rng.integers(0, 1000, 400).astype(np.uint32)
        sh[100:200] = rng.integers(0, 30, 100)  # shingles that repeat
        none, often, at = np.zeros(400, bool), sh % 7 == 0, np.arange(400 - width + 1)
        p, shingle, odd = rare_shingles(sh, at, none, often, width, percent)
        for i in at.tolist():
            own = set(sh[i : i + width].tolist())
            listed = {int(x) for x, q in zip(shingle, p) if q == i}
            plain = {int(x) for x, q, o in zip(shingle, p, odd) if q == i and not o}
            assert listed <= own
            # A similar passage lacks at most so many of the shingles.
            assert len(listed) > len(own) - -(-percent * len(own) // 100)
            if len(own) == width:
                assert len(plain) > width - -(-2 * percent * width // (100 + percent))
            else:
                assert plain == listed


def test_places_further_on_in_the_smallest_document(spark):
    """The smallest document of a key has it twice; others are alike the second place alone."""
    rng = np.random.default_rng(53)
    texts = {}
    for k in range(60):
        hot, one = words(rng, 38), words(rng, 14)
        passage = [*one[:6], *hot, *one[6:]]
        texts[2 * k] = " ".join([*words(rng, 20), *hot, *words(rng, 60), *passage, *words(rng, 30)])
        passage[-3] = "other"
        texts[2 * k + 1] = " ".join([*words(rng, 25), *passage, *words(rng, 30)])
    assert {(d, o) for d, _, _, _, o in spans_of(spark, texts)} == {(2 * k + 1, 2 * k) for k in range(60)}


def test_equal_windows_are_joined_once(spark):
    """Windows that hold the same go on as one; windows of one document, and of keys that one document has, do not stand for others."""
    from gridloom.llm.substring_dedup import _classes

    rows = [(1, 7, d, 5 << 32 | 3 << 16 | 1) for d in range(10, 60)] + [(1, 8, 10, 90 << 32), (1, 8, 10, 95 << 32), (1, 8, 33, 4 << 32)]
    rows += [(2, 7, 10, 1 << 32), (2, 7, 10, 2 << 32), (3, 9, 40, 0)]
    windows = spark.createDataFrame(rows, "key long, held long, doc_id long, place long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7", "1"):  # groups that go on from batch to batch
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {tuple(r) for r in _classes(windows).collect()}
            want = {(1, d, 5, 3, 1, 10, 5) for d in range(10, 60)} | {(1, 10, 90, 0, 0, 10, 90), (1, 10, 95, 0, 0, 10, 90), (1, 33, 4, 0, 0, 10, 90)}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_most_pairs_that_cannot_be_similar_are_not_made(spark, monkeypatch):
    """Documents share 31 words after words of their own that repeat: no passages of two are similar, and the last step makes few pairs (245 without marks)."""
    from gridloom.llm import substring_dedup as S

    rng = np.random.default_rng(41)
    hot, made, stored = words(rng, 31), [], S.stored

    def counted(df, path):
        out = stored(df, path)
        made.extend([out.count()] if path.endswith("/third_pairs") else [])
        return out

    monkeypatch.setattr(S, "stored", counted)
    texts = {d: " ".join([*words(rng, 20), *[f"again{d}"] * 30, *hot, *words(rng, 30)]) for d in range(16)}
    assert not passages_by_force(texts, 50, 0.75) and spans_of(spark, texts) == set()
    assert len(made) == 1 and made[0] < 100
