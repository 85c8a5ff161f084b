"""Decoders, catalog, gate, tables, samplers and streaming on small inputs of our own."""

import json

import pytest

from loomtrace.catalog import Catalog
from loomtrace.operators import analysis, projection, queueing, tables
from loomtrace.plans import gate
from loomtrace.sources import decode
from loomtrace.streaming import sync

TICKET = {
    "schema_version": "ATIF-v1.7", "session_id": "s-1", "trajectory_id": "t-1", "agent": {"name": "helper", "version": "1", "model_name": "m"},
    "steps": [
        {"step_id": 1, "source": "user", "message": "hi", "timestamp": "2026-01-01T00:00:00Z"},
        {"step_id": 2, "source": "agent", "message": "ok", "model_name": "m", "tool_calls": [{"tool_call_id": "c1", "function_name": "look", "arguments": {"a": 1}}], "observation": {"results": [{"source_call_id": "c1", "content": "x"}]}},
    ],
}
REPAIR = {"task_id": "task", "attempts": {"1": {"correct": True, "trajectory": {"schema_version": "ACTF_v1.0", "steps": [{"step_id": 1, "assistant_content": {"content": "a"}, "metric": {"env_action_ms": 25.0, "llm_infer_ms": 10}, "tools": [{"id": "t", "name": "Bash", "input": {}}], "started_at": "2026-08-01 10:00:00+00:00"}]}}}}
TALK = [{"session_id": "o", "step_id": 1, "created_at": 1785578400, "messages": [{"role": "user", "content": "q"}], "response": {"role": "assistant", "content": "r"}, "agent_model": "m"}]


@pytest.fixture
def folder(tmp_path):
    for name, value in (("a.json", TICKET), ("b.json", REPAIR), ("c.json", TALK)):
        (tmp_path / name).write_text(json.dumps(value))
    return tmp_path


def test_formats_and_overview(spark, folder):
    (folder / "bad.json").write_text("{")
    r = Catalog(spark, str(folder)).relations()
    row = analysis.overview(r).first().asDict()
    assert row == {"sources": 4, "ready_sources": 3, "error_sources": 1, "trajectories": 3, "agents": 3, "steps": 5, "user_steps": 2, "agent_steps": 3, "tool_calls": 2, "models": 1}
    assert [t.asDict() for t in analysis.tools(r).collect()][0] == {"function_name": "Bash", "calls": 1, "trajectories": 1, "sources": 1, "duration_samples": 1, "total_duration_ms": 25}
    assert r.tool_calls.where("function_name = 'look'").first()["results_json"] == '["x"]'


def test_pruned_files_are_not_read_and_changes_fail(spark, folder):
    catalog = Catalog(spark, str(folder))
    assert catalog.relations("a%").steps.count() == 2
    (folder / "b.json").write_text("{}")
    with pytest.raises(RuntimeError):
        catalog.relations()


def test_sql_gate_and_join_safety(spark, folder):
    catalog = Catalog(spark, str(folder))
    assert catalog.sql("SELECT source, count(*) AS n FROM steps GROUP BY source ORDER BY source") == [{"source": "agent", "n": 3}, {"source": "user", "n": 2}]
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO t VALUES (1)"):
        with pytest.raises(gate.Rejected):
            catalog.sql(bad)
    with pytest.raises(gate.Rejected):
        catalog.sql("SELECT * FROM runs r JOIN steps s ON r.session_id = s.session_id")
    assert len(catalog.sql("SELECT r._file_ FROM runs r JOIN steps s ON r.session_id = s.session_id AND r._file_ = s._file_")) == 5
    with pytest.raises(gate.Exhausted):
        catalog.sql("SELECT * FROM steps", max_rows=1)


def test_encoders_and_timestamps():
    assert gate.encode([{"a": 1}, {"a": 2, "b": None}], "csv", 100) == b"a,b\n1,\n2,\n"
    with pytest.raises(gate.Exhausted):
        gate.encode([{"a": 1}], "jsonl", 3)
    assert decode.nanoseconds("2026-01-01T00:00:00.000000001Z") % 10 == 1
    assert decode.nanoseconds(1.5) == 1_500_000_000 and decode.nanoseconds("1969-12-31T23:59:59Z") == -(10**9)
    for bad in ("yesterday", "2026-01-01T00:00:00.0000000001Z", 1e300):
        with pytest.raises(ValueError):
            decode.nanoseconds(bad)


def test_partition_conditions():
    fits = lambda c, v: tables.partition_matches(c, "p", v)
    assert fits("p >= '2' AND p <= '3'", "2") and not fits("p >= '2' AND p <= '3'", "4")
    assert fits("p IN ('a', 'b') OR 'c' = p", "c") and not fits("p LIKE 'a'", "a") and not fits("p = 'a' NOT", "a")


def test_tables_keep_generations(spark, tmp_path):
    table = tables.Table(spark, str(tmp_path / "t"), ("hash", "k", 4))
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k long, v string")
    table.add(rows)
    table.upsert(spark.createDataFrame([(3, "new"), (11, "more")], "k long, v string"), ["k"])
    assert table.count_rows() == 11 and table.read().where("k = 3").first()["v"] == "new"


def test_samplers(spark):
    assert queueing.SequentialSampler().sample([0, 1, 2, 3], 2) == ([0, 1], [0, 1])
    rank = queueing.RankAwareSampler()
    assert rank.sample([0, 1, 2], 2)[0] == [0, 1] == rank.sample([5, 6], 2)[0]
    assert queueing.GroupSampler(2).sample([0, 1, 3, 4, 6, 7], 4)[0] == [0, 1, 3, 4]
    found = queueing.runs_of(spark.createDataFrame([(i,) for i in (0, 1, 3, 4, 5, 65535, 65536, 65537, 65538)], "idx long"), 2)
    assert sorted(r["idx"] for r in found.collect()) == [0, 1, 3, 4, 65535, 65536, 65537, 65538]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"s{i % 3}", f"c{i // 2}", "llm.request" if i % 2 == 0 else "llm.response", f"p{i}", f"2026-01-01 00:00:{i:02d}") for i in range(24)]
    log = spark.createDataFrame(rows, "append_pos long, session_id string, call_id string, kind string, payload_json string, t string").selectExpr("append_pos", "concat('s', cast(call_id = 'c1' as string)) as session_id", "call_id", "kind", "payload_json", "to_timestamp(t) as timestamp")
    path, target = str(tmp_path / "log"), tables.Table(spark, str(tmp_path / "fold"))
    for part in (log.where("append_pos < 9"), log.where("append_pos >= 9")):
        part.write.mode("append").parquet(path)
        sync.follow(spark, path, log.schema, target, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, target.read().collect())) == sorted(map(tuple, projection.fold(log).collect()))
