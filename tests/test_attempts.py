"""Event-log attempts: turns, results attached to calls, gaps, sessions."""

import json

from loomtrace.catalog import Catalog
from loomtrace.sources import attempts

LOG = [
    {"type": "session", "id": "x", "cwd": "/w"}, {"type": "model_change", "modelId": "m-1"}, {"type": "other"},
    {"type": "message", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": [{"type": "text", "text": "do"}, {"type": "image"}, {"type": "text", "text": "it"}]}},
    {"type": "message", "message": {"role": "assistant", "model": "m-1", "usage": {"input": 3}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "toolCall", "id": "c1", "name": "run", "arguments": {"a": 1}}, {"type": "toolCall", "id": "", "name": "none"}]}},
    {"type": "message", "message": {"role": "toolResult", "toolCallId": "c1", "toolName": "run", "content": "out", "details": {"exitCode": 0, "durationMs": 7}}},
    {"type": "message", "message": {"role": "toolResult", "toolCallId": "lost", "content": "gone"}},
    {"type": "message", "message": {"role": "toolResult", "content": "loose"}}, {"type": "message", "message": {"role": "robot"}}, {"type": "message"},
    {"type": "message", "timestamp": "2026-01-01T00:00:09Z", "message": {"role": "assistant", "content": "done"}},
]


def test_turns():
    made, env, model = attempts.turns(LOG)
    assert env == {"id": "x", "state": {"cwd": "/w"}} and model == "m-1"
    assert [(t["id"], t["src"], t["msg"]) for t in made] == [(1, "user", "do\nit"), (2, "agent", "ok"), (5, "agent", "loose"), (6, "agent", "done")]
    call = made[1]["tool_calls"][0]
    assert len(made[1]["tool_calls"]) == 1 and call["result"] == "out" and call["duration_ms"] == 7 and call["response"] == {"exit_code": 0} and made[1]["reason"] == "hm"
    assert attempts.turns([]) == ([], {}, None)


def test_in_a_catalog(spark, tmp_path):
    steps = {"trajectory": {"steps": [{"step_id": 1, "assistant_content": {"content": "a"}}]}}
    (tmp_path / "t.json").write_text(json.dumps({"task_id": "t", "attempts": {"1": {"trajectory": LOG, "correct": True}, "2": {"trajectory": {"events": LOG}}, "3": steps}}))
    r = Catalog(spark, str(tmp_path), report_errors=False).relations()
    assert sorted((x["session_id"], x["agent_model_name"]) for x in r.runs.collect()) == [("t#attempt-1", "m-1"), ("t#attempt-2", "m-1"), ("t#attempt-3", None)]
    assert r.steps.groupBy("document_id").count().orderBy("document_id").toPandas()["count"].tolist() == [4, 4, 1]
    call = r.tool_calls.first()
    assert json.loads(call["results_json"]) == ["out"] and call["response_json"] == '{"exit_code":0}' and call["duration_ms"] == 7
