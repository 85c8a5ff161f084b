"""Inverted-file search, queue, key-value store and message extraction against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import scalars
from loomtrace.operators import ivf, queueing, search, tables


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(5)
    middles = [[r.gauss(0, 4) for _ in range(6)] for _ in range(12)]
    rows = [(i, [m + r.gauss(0, 0.5) for m in middles[i % 12]]) for i in range(1500)]
    odd = [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 6), (9004, [None] * 6), (9005, [])]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_all_clusters_equal_exact(vectors, metric):
    query = [0.5, -1.0, 2.0, 0.0, 1.0, 3.0]
    index = ivf.Index.over(vectors, 6, 10, metric)
    exact = search.knn(vectors.where(ivf.usable(F.col("embedding"), 6)), query, 20, metric)
    assert [r["vec_id"] for r in index.search(query, 20, nprobes=10).collect()] == [r["vec_id"] for r in exact.collect()]


def test_saved_index_has_recall(spark, vectors, tmp_path):
    index = ivf.Index.over(vectors, 6).save(str(tmp_path / "i"))
    assert index.rows.count() == 1500 and len(index.centroids) == 39
    again = ivf.Index.over(vectors, 6)
    assert (again.centroids == index.centroids).all()
    hits = 0
    for q in vectors.where("vec_id < 10").collect():
        exact = {r["vec_id"] for r in search.knn(index.rows, q["embedding"], 10).collect()}
        hits += len(exact & {r["vec_id"] for r in index.search(q["embedding"], 10, nprobes=6).collect()})
    assert hits >= 90
    with pytest.raises(ValueError):
        index.search([1.0], 1)


def test_no_vectors(vectors):
    assert ivf.Index.over(vectors.where("vec_id > 9000"), 6).search([0.0] * 6, 3).count() == 0


def test_queue(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in (0, 1, 2, 70000, 70001, 140000)], "idx long, v string")
    assert [r["v"] for r in queueing.by_indices(rows, [70000, 0, 9, 0]).collect()] == ["v70000", "v0", "v0"]
    assert [r["idx"] for r in queueing.get(rows, 2, 1).collect()] == [1, 2]
    left = queueing.clear(rows, spark.createDataFrame([(1,), (70000,)], "idx long"))
    assert [tuple(r) for r in left.orderBy("idx").collect()] == [(0, "v0"), (1, "v2"), (2, "v70001"), (3, "v140000")]
    ledger = spark.createDataFrame([("a", 0), ("b", 1)], "task string, idx long")
    ledger = queueing.mark(ledger, rows.where("idx < 2"), "a")
    assert sorted(map(tuple, ledger.collect())) == [("a", 0), ("a", 1), ("b", 1)]
    assert queueing.ready(rows, ledger, "a").count() == 4 and queueing.ready(rows, queueing.reset(ledger, "a"), "a").count() == 6


def test_key_value(spark, tmp_path):
    store = queueing.KeyValue(tables.Table(spark, str(tmp_path / "kv"), ("hash", "key", 3)))
    items = lambda *rows: spark.createDataFrame(list(rows), store.SCHEMA)
    assert [r["value"] for r in store.get(["a"]).collect()] == [None]
    store.put(items(("a", "1", {"t": "x"}), ("b", "2", {"t": "y"}), ("c", "3", None)))
    store.put(items(("a", "9", {"t": "x", "u": "z"})))
    assert [r["value"] for r in store.get(["c", "none", "a"]).collect()] == ["3", None, "9"]
    assert [r["key"] for r in store.list(t="x").collect()] == ["a"] and store.list().count() == 3
    with pytest.raises(ValueError):
        store.put(items(("d", "1", None), ("d", "2", None)))
    store.clear(["a"])
    assert store.list().count() == 2
    store.clear()
    assert store.list().count() == 0


def test_messages():
    assert scalars.message("hi") == ("hi", ["text"], 2) and scalars.message("") == ("", [], 0) and scalars.message(None, True) == ("", ["tool_call"], 0)
    mixed = [{"type": "text", "text": "é"}, {"content": "b", "image_url": {"url": "x"}}, {"input_audio": []}, {"image": False, "nested": [{"text": "<tool_call>"}]}]
    assert scalars.message(mixed) == ("é b <tool_call>", ["text", "image", "tool_call"], 15)


def test_wire_calls(spark):
    one = {"id": "1", "function": {"name": "f", "arguments": '{"a": 1}'}}
    body = {"choices": [{"message": {"tool_calls": [one, one, {"id": "2"}]}}], "content": [{"type": "tool_use", "name": "g", "input": [2]}, {"type": "text", "name": "h"}]}
    assert scalars.tool_calls(body) == [("1", "f", '{"a":1}'), (None, "g", "[2]")]
    rows = spark.createDataFrame([('{"tool_calls":[{"name":"f","arguments":"x"}]}',), ("{",), (None,)], "v string")
    assert [r[0] for r in rows.select(scalars.wire_tool_calls("v")).collect()] == [[(None, "f", '"x"')], [], []]
