"""The hub document in JSON and Markdown: rows, round trips, broken documents."""

import json

import pytest

from loomtrace.catalog import Catalog
from loomtrace.sources import decode, encode, storyline

DOC = {
    "schema_version": "storyline/v1", "run": "r-1", "trajectory": "t-1", "session": "s-1", "agent": {"id": "a", "ver": "1.2", "model": "m", "tools": [{"name": "look"}]},
    "parent": {"psid": "p-1", "scid": "c-0"}, "children": ["s-2"], "notes": "read -->", "final_metrics": {"score": 1},
    "turns": [
        {"id": 1, "ts": "2026-01-01T00:00:00.5Z", "src": "user", "msg": "two\n\n<!-- tracer:block:user -->\nlines\n"},
        {"id": 7, "src": "agent", "msg": [{"type": "text", "text": "é -->"}], "reason": "why", "latency_ms": 50, "copied": False, "extra": {"note": "a --> b"},
         "tool_calls": [{"tcid": "c-1", "fn": "look", "args": {"q": "x"}, "duration_ms": 12}], "observation": {"results": [{"source_call_id": "c-1", "content": "ok"}]}},
        {"id": 8, "src": "agent", "msg": "", "tool_calls": []},
    ],
}


def test_rows_and_round_trips(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    (tmp_path / "b.md").write_text(storyline.to_markdown(DOC))
    r = Catalog(spark, str(tmp_path)).relations()
    assert sorted((x["_file_"], x["format"], x["status"]) for x in r.sources.collect()) == [("a.json", "storyline", "ready"), ("b.md", "agenticmd", "ready")]
    steps = [x.asDict() for x in r.steps.where("_file_ = 'b.md'").orderBy("turn_ordinal").collect()]
    assert [(s["step_id"], s["effective_kind"], s["had_tool_calls"]) for s in steps] == [(1, "dialogue", False), (7, "autonomous", True), (8, "dialogue", True)]
    assert r.tool_calls.first()["results_json"] == '["ok"]' and r.runs.first()["parent_json"] == '{"psid":"p-1","scid":"c-0"}'
    for form, read in (("storyline", json.loads), ("agenticmd", storyline.from_markdown)):
        texts = [x["text"] for x in encode.export(r, form).collect()]
        assert len(texts) == 2 and all(read(x) == DOC for x in texts)


def test_blocks_by_hand():
    assert storyline.blocks("  plain\n") == ({}, [({"source": "system"}, "plain")])
    assert storyline.blocks("\n \n") == ({}, []) and storyline.from_markdown(storyline.to_markdown(DOC, "other-tool")) == DOC
    head, found = storyline.blocks("---\nformat: tracer\n---\n\n<!-- tracer:block:assistant -->\n\none\n\n<!-- tracer:block user {\"k\":1} -->\ntwo")
    assert head == {"format": "tracer"} and found == [({"source": "agent"}, "one"), ({"k": 1, "source": "user"}, "two")]


@pytest.mark.parametrize("change", [
    {"schema_version": "storyline/v9"}, {"session": ""}, {"other": 1}, {"agent": {}}, {"turns": [{"id": 1, "src": "user", "msg": ""}] * 2}, {"turns": [{"id": 1, "src": "robot", "msg": ""}]},
    {"turns": [{"id": i, "src": "agent", "msg": "", "tool_calls": [{"tcid": "c", "fn": "f", "args": {}}]} for i in (1, 2)]},
])
def test_broken_documents(change):
    with pytest.raises(storyline.Invalid):
        decode.decode(json.dumps(DOC | change))


@pytest.mark.parametrize("content", ["---\nstoryline: {}", "plain", "<!-- tracer:block:user {\"length\":9} -->\n\nab", "<!-- tracer:block:user -->\n\nab"])
def test_broken_markdown(content):
    with pytest.raises(storyline.Invalid):
        storyline.from_markdown(content)
