"""The nested hub document, as JSON and as Markdown with front matter, to and from relation rows.

In Markdown the front matter holds the document without its turns, and each turn is a block: a comment line with the
turn's fields and the byte length of the message that follows. A block without a length ends at the next one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from .common_rows import CALL, RUN, STEP, Row, effective_kind, stamp, text

try:  # only for front matter that is not written with JSON values
    import yaml
except ImportError:
    yaml = None

VERSION = "storyline/v1"
#: Opening of a block: a comment of any writer's name.
BLOCK = re.compile(rb"<!-- [A-Za-z][\w-]*:block")
WRITER = "trace"
SPEAKERS = {"user": "user", "assistant": "agent", "agent": "agent"}

#: Wire keys and the relation columns that hold them; a column ending in ``_json`` holds the value as JSON text.
HEAD = {
    "schema_version": "schema_version", "origin": "origin_json", "run": "run_id", "attempt_id": "attempt_id", "session": "session_id", "parent": "parent_json", "children": "child_session_ids_json",
    "notes": "notes", "task": "task_json", "prompt": "prompt_json", "started_at": "started_at_json", "finished_at": "finished_at_json", "final_metrics": "final_metrics_json",
    "continued_trajectory_ref": "continued_trajectory_ref", "extra": "extra_json", "meta": "meta_json", "unknown_fields": "unknown_fields_json", "unknown_key_counts": "unknown_key_counts_json",
}
AGENT = {"id": "agent_id", "name": "agent_name", "ver": "agent_version", "model": "agent_model_name", "tools": "agent_tool_definitions_json", "extra": "agent_extra_json"}
TURN = {
    "id": "step_id", "kind": "kind", "ts": "timestamp_source_json", "src": "source", "msg": "message_json", "reason": "reasoning_content", "effort": "reasoning_effort_json", "observation": "observation_json",
    "metrics": "metrics_json", "model": "model_name", "nllm": "llm_call_count", "copied": "is_copied_context", "latency_ms": "latency_ms", "ttft_ms": "ttft_ms", "extra": "extra_json", "env": "env_json",
    "prompt": "prompt_json", "finished_at": "finished_at_json",
}
TOOL = {"tcid": "tool_call_id", "fn": "function_name", "args": "arguments_json", "result": "result_json", "duration_ms": "duration_ms", "extra": "extra_json", "kind": "kind", "response": "response_json"}


class Invalid(ValueError):
    """A document that breaks the format's rules."""


def _columns(value: dict, names: dict[str, str], own: tuple[str, ...] = ()) -> dict:
    if unknown := value.keys() - names.keys() - set(own):
        raise Invalid(f"unknown fields {sorted(unknown)}")
    return {column: text(value[key]) if column.endswith("_json") else value[key] for key, column in names.items() if value.get(key) is not None}


def _wire(row: dict, names: dict[str, str]) -> dict:
    return {key: json.loads(row[column]) if column.endswith("_json") else row[column] for key, column in names.items() if row.get(column) is not None}


def decode(doc: dict) -> Iterator[Row]:
    """Rows of one document; unknown fields, repeated ids and missing identities are errors."""
    if doc.get("schema_version") != VERSION:
        raise Invalid(f"unsupported version {doc.get('schema_version')!r}")
    agent = doc.get("agent") or {}
    if not doc.get("session") or not agent.get("id"):
        raise Invalid("a document without session or agent id")
    ids = {"document_id": doc.get("trajectory") or doc["session"], "session_id": doc["session"], "run_id": doc.get("run")}
    yield RUN, _columns(doc, HEAD, ("trajectory", "agent", "turns")) | _columns(agent, AGENT) | ids | {"trajectory_id_explicit": bool(doc.get("trajectory"))}
    turns, called = set(), set()
    for ordinal, turn in enumerate(doc["turns"]):
        if turn["src"] not in ("user", "agent", "system"):
            raise Invalid(f"unknown source {turn['src']!r}")
        if turn["id"] in turns:
            raise Invalid(f"turn {turn['id']} stands twice")
        turns.add(turn["id"])
        calls = turn.get("tool_calls") or []
        seen = turn.get("observation")
        results = _results(seen)
        yield STEP, {"message_json": text("")} | _columns(turn, TURN, ("tool_calls",)) | ids | {
            "turn_ordinal": ordinal, "timestamp": stamp(turn.get("ts")), "effective_kind": effective_kind(turn.get("kind"), turn["src"], calls),
            "had_tool_calls": turn.get("tool_calls") is not None, "had_observation": seen is not None,
        }
        for index, call in enumerate(calls):
            if call["tcid"] in called:
                raise Invalid(f"tool call {call['tcid']!r} stands twice")
            called.add(call["tcid"])
            yield CALL, {"arguments_json": "{}"} | _columns(call, TOOL) | ids | {"step_id": turn["id"], "call_index": index, "results_json": text(results.get(call["tcid"], []))}


def _results(observation: object) -> dict[str, list]:
    """Contents of an observation's results by the call they answer."""
    found: dict[str, list] = {}
    for r in observation.get("results") or [] if isinstance(observation, dict) else []:
        if isinstance(r, dict):
            found.setdefault(r.get("source_call_id") or r.get("tool_call_id"), []).append(r.get("content"))
    return found


def encode(row: dict, steps: list[dict]) -> dict:
    """The document of a run row and its step rows, which hold their call rows in ``calls``."""
    if not row["session_id"] or not row["agent_id"]:
        raise Invalid("a document without session or agent")
    turns = []
    for s in steps:
        turn = {"msg": ""} | _wire(s, TURN)
        if "ts" not in turn and s.get("timestamp") is not None:
            turn["ts"] = s["timestamp"]
        calls = [_wire(c, TOOL) for c in s.get("calls") or []]
        turns.append(turn | ({"tool_calls": calls} if calls or s.get("had_tool_calls") else {}))
    head = _wire(row, HEAD) | {"schema_version": VERSION}
    named = {"trajectory": row["document_id"]} if row.get("trajectory_id_explicit") else {}
    return head | named | {"agent": _wire(row, AGENT), "turns": turns}


def _compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def to_markdown(doc: dict, writer: str = WRITER) -> str:
    """The Markdown text; ``writer`` is the name in the front matter and the block comments."""
    head = {k: v for k, v in doc.items() if k != "turns"}
    out = [f"---\nformat: {writer}\nstoryline: {_compact(head)}\n---\n\n"]
    for turn in doc["turns"]:
        said = turn["msg"]
        form, body = ("text", said) if isinstance(said, str) else ("json", json.dumps(said, ensure_ascii=False, indent=2))
        fields = {"type": form, "length": len(body.encode()), "message_encoding": form, "source": turn["src"], "step_id": turn["id"], "storyline": {k: v for k, v in turn.items() if k != "msg"}}
        # a comment ends at its first "-->", so that the fields must not hold one
        out.append(f"<!-- {writer}:block:{turn['src']} {_compact(fields).replace('-->', '--' + chr(92) + 'u003e')} -->\n\n{body}\n\n")
    return "".join(out)


def _front(content: bytes) -> tuple[dict, bytes]:
    if not content.startswith(b"---"):
        return {}, content
    matter, fence, body = content[3:].partition(b"\n---")
    if not fence:
        raise Invalid("unclosed front matter")
    lines = [x for x in matter.decode().split("\n") if x.strip()]
    try:
        found = {k.strip(): json.loads(v) if v.lstrip()[:1] in ("{", "[", '"') else v.strip() for k, _, v in (x.partition(":") for x in lines if x[0] not in " #") if v.strip()}
        plain = all(x[0] not in " -" and x.partition(":")[2].strip() for x in lines)
    except ValueError:
        plain = False
    if not plain:
        if yaml is None:
            raise Invalid("this front matter needs a YAML reader")
        found = yaml.safe_load(matter) or {}
    return found, body.removeprefix(b"\n")


def _blank(content: bytes, at: int) -> int:
    """Past blank lines."""
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        if content[at:end].strip():
            return at
        at = end + 1
    return len(content)


def blocks(content: str) -> tuple[dict, list[tuple[dict, str]]]:
    """Front matter and (fields, body) of each block; text without any block is one of the system."""
    head, body = _front(content.encode())
    if not body.strip():
        return head, []
    if not BLOCK.search(body):
        return head, [({"source": "system"}, body.strip().decode())]
    found, at = [], _blank(body, 0)
    while at < len(body):
        end = body.find(b"\n", at)
        end = len(body) if end < 0 else end
        line = body[at:end].strip()
        if not (mark := BLOCK.match(line)):
            raise Invalid(f"expected a block at byte {at}")
        if not line.endswith(b"-->"):
            raise Invalid("unclosed block comment")
        speaker, brace, rest = line[mark.end() : -3].lstrip(b":").partition(b"{")
        fields = json.loads(brace + rest) if brace else {}
        if speaker.strip() and not fields.keys() & {"source", "role"}:
            fields["source"] = SPEAKERS.get(speaker.strip().decode(), "system")
        length = fields.get("length")
        start = min(end + 1, len(body))
        if length is None:
            start = _blank(body, start)
            after = BLOCK.search(body, start)
            stop = after.start() if after else len(body)
            said = body[start:stop].rstrip(b"\r\n")
        else:
            start += 2 if body[start : start + 2] == b"\r\n" else 1 if body[start : start + 1] == b"\n" else 0
            stop = start + length
            if stop > len(body):
                raise Invalid("a block's body ends past the file")
            said = body[start:stop]
        found.append((fields, said.decode()))
        at = _blank(body, stop)
    return head, found


def from_markdown(content: str) -> dict:
    """The document in a Markdown text; without its metadata in front matter and blocks it is an error."""
    head, found = blocks(content)
    if not isinstance(head.get("storyline"), dict):
        raise Invalid("no document metadata in the front matter")
    turns = []
    for k, (fields, body) in enumerate(found):
        if not isinstance(fields.get("storyline"), dict):
            raise Invalid(f"no turn metadata in block {k}")
        turns.append(fields["storyline"] | {"msg": json.loads(body) if fields.get("message_encoding") == "json" else body})
    return head["storyline"] | {"turns": turns}
