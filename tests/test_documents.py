import json
import random
import re

import pytest
from gridloom.sources.documents import documents, first_documents

SCHEMA = "id long, run long, fitness double, name string, tags array<string>"


@pytest.fixture
def store(tmp_path):
    rng, rows = random.Random(3), []
    for run in range(5):
        folder = tmp_path / f"run={run}"
        folder.mkdir()
        for part in range(3):
            own = [{"id": 100 * run + 10 * part + k, "fitness": rng.choice([0.5, 1.0, 2.5, 3, None]), "name": rng.choice("abc"), "tags": ["x"] * (k % 2)} for k in range(9)]
            (folder / f"{part}.jsonl").write_text("\n".join(map(json.dumps, own)))
            rows += [d | {"run": run} for d in own]
    return str(tmp_path), rows


@pytest.fixture
def pushing(spark):
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.set("spark.sql.python.filterPushdown.enabled", was)


def best(rows, n):
    return [d["id"] for d in sorted(rows, key=lambda d: (d["fitness"] is None, -(d["fitness"] or 0), str(d["id"])))[:n]]


def test_all_documents(spark, store):
    path, rows = store
    got = documents(spark, path, SCHEMA)
    assert got.count() == len(rows)
    assert {r["id"]: (r["run"], r["fitness"], r["name"], r["tags"]) for r in got.collect()} == {d["id"]: (d["run"], d["fitness"], d["name"], d["tags"]) for d in rows}


@pytest.mark.parametrize("push", [True, False])
def test_first_documents(spark, store, request, push):
    path, rows = store
    if push:
        request.getfixturevalue("pushing")
    for where, test in (
        (None, lambda d: True),
        ("run >= 2 and name = 'b'", lambda d: d["run"] >= 2 and d["name"] == "b"),
        ("run in (0, 3) and fitness < 3", lambda d: d["run"] in (0, 3) and d["fitness"] is not None and d["fitness"] < 3),
        ("size(tags) > 0 and fitness > 0.5", lambda d: d["tags"] and d["fitness"] is not None and d["fitness"] > 0.5),  # Spark tests the first
        ("name like '%a%'", lambda d: "a" in d["name"]),
        ("run = 77", lambda d: False),
    ):
        for n in (1, 7, 1000):
            got = [r["id"] for r in first_documents(spark, path, SCHEMA, "fitness", n, where).collect()]
            assert got == best([d for d in rows if test(d)], n), (where, n)


def test_what_is_pushed(spark, store, pushing):
    path, _ = store
    plan = documents(spark, path, SCHEMA).where("run = 1 and fitness > 1")
    assert plan.rdd.getNumPartitions() == 1  # other runs are not opened
    assert plan.count() > 0
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", text), text  # Spark has nothing left to test


def test_broken_lines_are_named(spark, tmp_path):
    (tmp_path / "run=1").mkdir()
    (tmp_path / "run=1" / "0.jsonl").write_text('{"id": 1}\nnothing')
    with pytest.raises(Exception, match="0.jsonl: a line is no JSON object"):
        documents(spark, str(tmp_path), SCHEMA).collect()
    assert documents(spark, str(tmp_path / "none"), SCHEMA).count() == 0
