import re
from pathlib import Path

import numpy as np
from gridloom.llm import embedding_dedup
from gridloom.llm import exact_dedup as exact_module
from gridloom.llm import minhash_dedup as near
from gridloom.llm.embedding_dedup import near_vectors
from gridloom.llm.exact_dedup import exact_dedup, sha256


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_by_force(ids, linked):
    label = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                if a < b and label[a] != label[b] and linked(a, b):
                    low, high = sorted((label[a], label[b]))
                    label = {k: low if v == high else v for k, v in label.items()}
                    again = True
    return label


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    base, hot = words(80), words(30)
    texts = {}
    for i in range(40):  # near copies of one text, some only by way of others
        t = list(base)
        for k in rng.integers(0, 80, i % 5):
            t[k] = f"x{i}{k}"
        texts[i] = " ".join(t)
    for i in range(40, 80):  # a common passage in short texts
        texts[i] = " ".join([*hot, *words(12 + i % 9)])
    texts |= {80: None, 81: "", 82: " \t\n", 83: "One two", 84: "one  TWO", 85: "three", 86: texts[3].upper(), 87: " ".join(words(3000))}
    texts[88] = texts[87] + " more words here"
    docs = spark.createDataFrame([(k, v, "r", 1) for k, v in texts.items()] + [(None, "one two", "r", 1), (3, texts[3], "r", 1)], "doc_id long, text string, rep string, n int").repartition(3)
    sets = {k: shingles(v) for k, v in texts.items()}
    want = components_by_force(list(texts), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    for at_once in (12, 2):  # small bands pair by pair, and nearly all by the join on rare shingles
        monkeypatch.setattr(near, "AT_ONCE", at_once)
        got = near.near_duplicates(docs).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            if r["doc_id"] is not None:
                assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]])), r
                assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        c = np.random.default_rng(i % 40).standard_normal(16)
        rows.append((i, [float(x) for x in c + rng.standard_normal(16) * 0.18], i % 3))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] + [1.0] * 15, 0), (305, rows[0][1], None), (306, [None] + [1.0] * 15, 0), (307, [], 0)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, rep int").repartition(3)
    sound = {i: np.asarray(v, np.float32).astype(float) for i, v, lab in rows if lab is not None and v and not any(x is None or x != x for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    linked = lambda a, b: a in sound and b in sound and label[a] == label[b] and sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= 0.93
    ids = [r[0] for r in rows]
    comp = components_by_force(ids, linked)
    right = 0
    got = near_vectors(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        n = sum(linked(r["vec_id"], j) for j in ids if j != r["vec_id"])
        right += r["n_links"] == n and r["component_id"] == comp[r["vec_id"]]
        assert r["n_links"] <= n
    assert right >= 0.95 * len(rows)


def linked_by_force(x, label):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    want = np.arange(len(x))
    while (low := np.where(linked | np.eye(len(x), dtype=bool), want[None, :], len(x)).min(axis=1)).tolist() != want.tolist():
        want = low
    return linked, want


def hard_pairs(rng, n, dims=64):
    """Pairs of cosine 0.93 to 0.94, one after another."""
    base = rng.standard_normal((n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((n, dims))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    c = 0.93 + 0.01 * rng.random((n, 1))
    return np.stack([base, c * base + np.sqrt(1 - c * c) * other / np.linalg.norm(other, axis=1, keepdims=True)], axis=1).reshape(-1, dims)


def test_near_vectors_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = hard_pairs(rng, 700)
    x = np.concatenate([x, x[0] + rng.standard_normal((300, 64)) * 0.035]).astype(np.float32)  # and a dense cloud, partly linked by way of others
    label = np.asarray([i // 2 % 2 for i in range(1400)] + [0] * 300)
    linked, want = linked_by_force(x, label)
    assert linked.sum() > 1400 + 300
    frame = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").repartition(5)
    for chunk in (4096, 300):  # a label in one chunk, and pairs of chunks
        monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
        got = sorted(near_vectors(frame).collect())
        assert [(r["n_links"], r["component_id"]) for r in got] == list(zip(linked.sum(axis=1).tolist(), want.tolist()))
        many = sorted(near_vectors(frame, bucket=100).collect())  # several rotations and many filters
        assert all(r["n_links"] <= n for r, n in zip(many, linked.sum(axis=1)))
        assert sum(r["n_links"] for r in many) >= 0.99 * linked.sum()
        assert np.mean([r["component_id"] == c for r, c in zip(many, want)]) >= 0.99


def test_filters_find_pairs_in_large_labels():
    x = hard_pairs(np.random.default_rng(9), 1500)
    for n in (20_000, 200_000):
        lists = embedding_dedup.CapCodes(64, n).decode(x, n)
        both = [np.intersect1d(a, b).size > 0 for a, b in zip(lists[::2], lists[1::2])]
        assert np.mean(both) >= 0.98 and np.mean([len(f) for f in lists]) < 14


def test_exact_dedup(spark):
    data = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, None, "z"), (5, "", "z"), (6, "a ", "z"), (3, "a", "y"), (None, "b", "q"), (9, "c" * 100_000, "q")]
    docs = spark.createDataFrame(data, "doc_id long, text string, digest string").repartition(3)
    big = {r["doc_id"]: r for r in exact_dedup(docs, keep="largest").collect()}
    assert [big[i]["keep_id"] for i in (1, 2, 3, 4, 5, 6, 9)] == [3, 2, 3, 5, 5, 6, 9] and big[1]["group_size"] == 3
    small = {r["doc_id"]: r for r in exact_dedup(docs, keep="smallest").collect()}
    assert small[3]["keep_id"] == 1 and small[1]["kept"] and not small[3]["kept"]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_of_repeated_ids_and_of_one_digest_for_several_texts(spark):
    from collections import defaultdict

    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    data = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "lone"), (None, "lone"), (7, None), (8, "")]
    data += [(int(rng.integers(10, 300)), f"text {rng.integers(0, 120)}") for _ in range(400)]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, copies int").repartition(7)
    for keep, best in (("smallest", min), ("largest", max)):
        ids = defaultdict(list)
        for i, t in data:
            ids[t or ""].append(i)
        chosen = {t: best([i for i in v if i is not None], default=None) for t, v in ids.items()}
        want = sorted((repr(i), repr(chosen[t or ""]), len(ids[t or ""]), i == chosen[t or ""]) for i, t in data)
        for digest in (sha256, lambda t: F.substring(sha256(t), 1, 1)):  # and 256 digests for all texts
            got = exact_dedup(docs, keep=keep, memtables=5, digest=digest).collect()
            assert sorted((repr(r["doc_id"]), repr(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == want


def test_near_vectors_of_a_repeated_id(spark):
    """One id with two vectors: each row takes the counts of its own vector."""
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near_b = [0.1, 1.0, 0.0, 0.0]
    rows = [(1, a, 5), (1, b, 5), (2, near_b, 5), (3, c, 5), (0, c, 5), (4, a, 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(map(tuple, near_vectors(frame).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 0, False), (4, 0, 4, True)]


def test_the_driver_is_cleared_between_jobs(spark, monkeypatch):
    """Broadcast tables and shuffles of finished jobs do not wait for the driver's heap to fill up: it is told to collect."""
    for module, find in ((near, near.near_duplicates), (exact_module, exact_dedup)):
        told = []
        monkeypatch.setattr(module, "release", lambda s: told.append(s))
        docs = spark.createDataFrame([(i, f"a text of some words {i // 2}") for i in range(8)], "doc_id long, text string")
        assert find(docs).where("kept").count() == 4 and len(told) >= 4


def test_few_edges_need_no_rounds(spark, tmp_path, monkeypatch):
    """Edges that fit in one task are joined up there; more of them give the same labels in rounds."""
    from gridloom.llm import common

    rng = np.random.default_rng(59)
    ids = rng.permutation(400).tolist()
    edges = [(a, b) for k in range(0, 400, 80) for a, b in zip(ids[k : k + 80], ids[k + 1 : k + 80])]
    want = {a: min(ids[k : k + 80]) for k in range(0, 400, 80) for a in ids[k : k + 80]}
    frame = spark.createDataFrame([*edges, *edges[:9], (7, 7), (None, 5)], "u long, v long").repartition(3)
    assert dict(map(tuple, common.components(frame, f"{tmp_path}/one", rounds=1).collect())) == want
    monkeypatch.setattr(common, "EDGES", 1)
    assert dict(map(tuple, common.components(frame.limit(0), f"{tmp_path}/none").collect())) == {}
    monkeypatch.setattr(common, "EDGES", 90)
    assert dict(map(tuple, common.components(frame, f"{tmp_path}/more").collect())) == want


def test_what_the_driver_frees_outside_its_heap_goes_back(spark):
    """Memory that lies free below what is still in use is given back to the system as well."""
    from gridloom.llm.common import release

    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    data, out = bytearray(np.random.default_rng(3).bytes(60_000)), bytearray(60_000)
    jvm.System.gc()
    made = []
    for _ in range(300):
        made.append(one := jvm.java.util.zip.Deflater())
        one.setInput(data)
        one.deflate(out)
    for one in made[:-1]:
        one.end()
    jvm.System.gc()
    before = held()
    release(spark)
    assert held() < before - 20
    made[-1].end()
