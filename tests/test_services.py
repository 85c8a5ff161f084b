"""Text index, queue, plan execution, attempt registry, exports and scalar functions without SQL."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import scalars
from loomtrace.operators import exchange, execution, queueing, search, tables
from loomtrace.relations import over_tables

SF = "/root/testdata/sf0.001"


def test_text_index_equals_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = search.TextIndex(spark, str(tmp_path / "fts"))
    index.add(docs.where("doc_id < 120"))
    index.add(docs.where("doc_id >= 100"))  # twenty are replaced
    scan = lambda rows: [(r["doc_id"], round(r["score"], 9)) for r in search.bm25(rows, ["the", "que"], k=30).collect()]
    found = lambda: [(r["id"], round(r["score"], 9)) for r in index.search(["The", "que"], 30).collect()]
    assert found() == scan(docs) and len(index.list()) == 2
    index.delete(docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))
    assert found() == scan(docs.where("doc_id % 3 > 0"))
    index.rebuild()
    assert found() == scan(docs.where("doc_id % 3 > 0")) and len(index.list()) == 1


def test_queue(spark, tmp_path):
    queue = queueing.Queue(tables.Table(spark, str(tmp_path / "q")), "a long, b string", batch=4)
    queue.put_batch([{"a": i, "b": f"x{i}"} for i in range(6)])
    assert queue.total_count() == 6 and [r["a"] for r in queue.get(4, 2)] == [2, 3, 4, 5]
    assert [len(b) for b in queue.get_stream(10, 1, step=3)] == [3, 2] and list(queue.get_stream(5, 6, wait=True, timeout=0.01)) == []
    assert [r["b"] for r in queue.get_by_indices([5, 0, 5, 9])] == ["x5", "x0", "x5"]
    rows, offset = queueing.sampled_batch(queue, queueing.GroupSampler(2), 4, 1)
    assert [r["a"] for r in rows] == [1, 2, 3, 4] and offset == 5 and queueing.sampled_batch(queue, queueing.SequentialSampler(), 4, 6) == ([], 6)
    again = queueing.Queue(tables.Table(spark, str(tmp_path / "q")), "a long, b string")
    assert again.total_count() == 6


def test_execute_and_registry(spark, tmp_path):
    def run(task):
        if task["n"] % 5 == 0:
            raise ValueError("no")
        return task["n"] * 2

    tasks = spark.createDataFrame([(f"t{i}", i) for i in range(12)] + [("t1", 99)], "task_id string, n long")
    got = {r["task_id"]: r for r in execution.execute(tasks, run, done=tasks.where("n = 3")).collect()}
    assert len(got) == 11 and got["t1"]["result"] == "2" and got["t5"]["status"] == "quarantined" and got["t5"]["attempts"] == 3 and "no" in got["t5"]["error"]
    now = [0.0]
    r = execution.AttemptRegistry(spark, str(tmp_path / "r"), lambda: now[0])
    assert r.publish_active("run", "a", 1, 10) and not r.publish_active("run", "b", 1, 10) and r.get("run")["alive"]
    now[0] = 11
    assert not r.get("run")["alive"] and r.heartbeat("run", "a", 1, 10) and r.get("run")["alive"]
    assert r.publish_active("run", "b", 2, 10) and not r.heartbeat("run", "a", 1, 10) and not r.publish_terminal("run", "a", 1, "failed")
    assert r.publish_terminal("run", "b", 2, "succeeded") and not r.publish_terminal("run", "b", 2, "failed") and r.get("run")["state"] == "succeeded" and r.get("other") is None


def test_har_and_spans(spark):
    record = lambda **p: json.dumps({"payload": p})
    rows = [
        (0, 0, "llm.request", "s", "c1", "t", record(http={"method": "POST", "url": "/u", "version": "2", "headers": {"b": 1, "a": "x"}, "body": {"q": [1]}}, degraded=True)),
        (1, 1, "llm.response.stream", "s", "c1", "t", record(http={"status": 200, "duration_ms": 3.5, "response_body": "text"})),
        (2, 2, "llm.request", "s", None, None, record(path="/p", method=7)), (3, 3, "http.response", "s", "c2", None, record(status=1)), (4, 4, "note", "s", "c1", None, record()),
    ]
    df = spark.createDataFrame(rows, "append_pos long, seq long, kind string, session_id string, call_id string, trace_id string, payload_json string").withColumns(
        {"timestamp": F.lit("2026-01-01 00:00:00").cast("timestamp"), "event_id": F.lit("e")}
    )
    log = json.loads(exchange.har_json(df).first()["har"])["log"]
    assert log["version"] == "1.2" and len(log["entries"]) == 2
    one, two = log["entries"]
    assert one["time"] == 3.5 and one["request"]["method"] == "POST" and one["request"]["headers"] == [{"name": "a", "value": "x"}, {"name": "b", "value": "<redacted>"}]
    assert json.loads(one["request"]["postData"]["text"]) == {"q": [1]} and one["response"]["status"] == 200 and one["response"]["content"]["text"] == "text" and one["_loomtrace"]["degraded"] is True
    assert two["_loomtrace"]["call_id"] == "seq-2" and two["request"]["url"] == "/p" and two["request"]["method"] == "" and two["response"]["status"] == 0
    back = exchange.spans_from_json(exchange.spans_json(df), "otlp").orderBy("seq").collect()
    assert [(r["kind"], r["source"], r["session_id"], r["trace_id"]) for r in back][0] == ("otel.span", "otel", "s", "t") and len(back) == 5
    held = json.loads(back[0]["payload_json"])["payload"]
    assert held["degraded"] is True and held["replayable"] is False and held["otel"]["name"] == "llm.request" and held["otel"]["attributes"]["loomtrace.seq"] == "0"


def test_embedding_by_hand(spark):
    def want(text, dim):
        out = [0.0] * dim
        for w in text.split():
            w = w.strip(".,!")
            if w:
                h = 0xCBF29CE484222325
                for b in w.lower().encode():
                    h = ((h ^ b) * 0x100000001B3) % 2**64
                out[h % dim] += 1
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out

    texts = ["The cat, the hat.", "!!!", "Ünï code code"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in df.select("i", scalars.embed_text(F.col("t"), 8).alias("e")).collect():
        assert r["e"] == pytest.approx(want(texts[r["i"]], 8), abs=1e-6)


def test_events_of_the_declared_schema_suffice(spark):
    events = over_tables(spark, SF).events
    from loomtrace.relations import EVENTS

    assert events.columns == ["_file_", *EVENTS.names]


def test_calls_summary():
    calls = execution.Calls()
    calls.record("add", 1.0, rows=3)
    calls.record("add", 3.0, failed=True)
    assert calls.summary() == {"add": {"calls": 2, "errors": 1, "rows": 3, "bytes": 0, "seconds": 4.0, "slowest": 3.0, "mean_seconds": 2.0}}
