"""Fields that a dialect does not define survive the way through the relations."""

import json

import pytest

from loomtrace.catalog import Catalog
from loomtrace.sources import decode, encode, unknown

DOC = {
    "schema_version": "ATIF-v1.7", "session_id": "s", "new/one": [1], "agent": {"name": "a", "version": "1", "mood": "~"},
    "steps": [{"step_id": 1, "source": "user", "message": "q", "lang": None}, {"step_id": 2, "source": "agent", "message": "r", "lang": "en", "tool_calls": [{"tool_call_id": "c", "function_name": "f", "arguments": {"x": 1}, "retry": 2}]}],
}
TASK = {"task_id": "t", "attempts": {"1": {"correct": True, "trajectory": {"schema_version": "ACTF_v1.0", "seed": 4, "steps": [{"step_id": 1, "assistant_content": {"content": "a", "mood": 1}, "tools": [], "observation": [], "host": "h"}]}}}}


def test_collected_and_counted():
    run = decode.decode(json.dumps(DOC))[1][0][1]
    assert json.loads(run["unknown_fields_json"]) == {"atif": {"/new~1one": [1], "/agent/mood": "~", "/steps/0/lang": None, "/steps/1/lang": "en", "/steps/1/tool_calls/0/retry": 2}}
    assert json.loads(run["unknown_key_counts_json"])["atif"] == {"/new~1one": 1, "/agent/mood": 1, "/steps/*/lang": 2, "/steps/*/tool_calls/*/retry": 1}


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    (tmp_path / "b.json").write_text(json.dumps(TASK))
    r = Catalog(spark, str(tmp_path)).relations()
    assert json.loads(encode.export(r, "atif", r.runs["_file_"] == "a.json").first()["text"]) == DOC
    back = json.loads(encode.export(r, "actf", r.runs["_file_"] == "b.json").first()["text"])["attempts"]["1"]["trajectory"]
    assert back["seed"] == 4 and back["steps"][0]["host"] == "h" and back["steps"][0]["assistant_content"]["mood"] == 1


def test_restore_never_overwrites():
    value = {"a": [{"b": 1}]}
    unknown.restore(value, {"/a/0/b": 2, "/a/0/c~1d": 3})
    assert value == {"a": [{"b": 1, "c/d": 3}]}
    for pointer in ("/a/9/x", "/z/x", "/a/b"):
        with pytest.raises(ValueError):
            unknown.restore(value, {pointer: 1})
