"""Attempts that are recorded as an event log: messages become turns, and tool results go to the calls they answer."""

from __future__ import annotations

from .storyline import VERSION

#: Keys of a result's details and the names they have in an observation.
DETAILS = {"status": "status", "exitCode": "exit_code", "durationMs": "duration_ms", "aggregated": "aggregated_output"}


def events_of(attempt: dict) -> list[dict] | None:
    """The event log of an attempt that has no steps; None for one with steps."""
    path = attempt.get("trajectory")
    if isinstance(path, list):
        return path
    return path["events"] if isinstance(path, dict) and path.get("events") and not path.get("steps") else None


def _said(content: object, kind: str) -> str:
    if isinstance(content, str):
        return content
    parts = [p.get(kind, p.get("text")) for p in content if isinstance(p, dict) and p.get("type") == kind] if isinstance(content, list) else []
    return "\n".join(p for p in parts if isinstance(p, str))


def _given(**fields: object) -> dict:
    return {k: v for k, v in fields.items() if v is not None}


def _calls(content: object) -> list[dict]:
    found = [p for p in content if isinstance(p, dict) and p.get("type") == "toolCall"] if isinstance(content, list) else []
    return [{"tcid": p["id"], "fn": p["name"], "args": p.get("arguments", {}), "kind": "function"} for p in found if p.get("id") and p.get("name")]


def _result(message: dict) -> dict:
    details = message["details"] if isinstance(message.get("details"), dict) else {}
    key = message.get("toolCallId")
    named = _given(tool_use_id=key, source_call_id=key, name=message.get("toolName"))
    return {"content": _said(message.get("content"), "text")} | named | {name: details[k] for k, name in DETAILS.items() if k in details}


def turns(events: list[dict]) -> tuple[list[dict], dict, str | None]:
    """(turns, environment of the session, last model). A result that names its call is no turn of its own, answered or not."""
    made, results, env, model = [], [], {}, None
    number = 0
    for event in events:
        kind, message = event.get("type"), event.get("message")
        if kind == "session":
            state = {"cwd": event["cwd"]} if isinstance(event.get("cwd"), str) else None
            env = _given(id=event.get("id") or None, state=state) or env
        elif kind == "model_change":
            model = event.get("modelId") or None
        if kind != "message" or not isinstance(message, dict) or message.get("role") not in ("user", "assistant", "toolResult"):
            continue
        number += 1  # numbers of messages; results that are taken up leave gaps
        content = message.get("content")
        turn = _given(id=number, ts=event.get("timestamp") if isinstance(event.get("timestamp"), str) else None, msg=_said(content, "text"))
        if message["role"] == "user":
            made.append(turn | {"src": "user"} | _given(model=message.get("model")))
        elif message["role"] == "assistant":
            calls = _calls(content)
            acts = {"kind": "autonomous", "tool_calls": calls} if calls else {}
            made.append(turn | {"src": "agent", "nllm": 1} | acts | _given(reason=_said(content, "thinking") or None, metrics=message.get("usage"), model=message.get("model")))
        elif isinstance(message.get("toolCallId"), str):
            results.append(_result(message))
        else:
            made.append(turn | {"src": "agent", "observation": {"results": [_result(message)]}, "extra": {"role": "toolResult"} | _given(toolName=message.get("toolName"))})
    owners = {call["tcid"]: (turn, call) for turn in made for call in turn.get("tool_calls", ())}
    for r in results:
        if (owner := owners.get(r["source_call_id"])) is None:
            continue
        turn, call = owner
        call["result"] = r["content"]
        if isinstance(r.get("duration_ms"), int):
            call["duration_ms"] = r["duration_ms"]
        if answer := _given(status=r.get("status"), exit_code=r.get("exit_code")):
            call["response"] = answer
        turn.setdefault("observation", {"results": []})["results"].append(r)
    return made, env, model


def document(task: dict, name: str, attempt: dict, session: str) -> dict:
    """The hub document of one event-log attempt."""
    events = events_of(attempt) or []
    made, env, model = turns(events)
    path = attempt["trajectory"] if isinstance(attempt["trajectory"], dict) else {}
    stamps = [e["timestamp"] for e in events if isinstance(e.get("timestamp"), str)]
    head = {k: v for k, v in task.items() if k != "attempts"} | ({"env": env} if env else {})
    return {
        "schema_version": VERSION, "origin": {"format": "actf", "schema_version": "ACTF_v1.0"}, "run": task["task_id"], "attempt_id": name, "session": session,
        "agent": _given(id="actf-agent", name="ACTF Agent", model=model), "task": head, "final_metrics": {k: v for k, v in attempt.items() if k != "trajectory"}, "turns": made,
    } | _given(started_at=path.get("started_at") or (stamps[0] if stamps else None), finished_at=path.get("finished_at") or (stamps[-1] if stamps else None))
