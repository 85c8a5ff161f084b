"""Encoders: relations back to the JSON trajectory dialects, one text per document (one per task for attempts).

A document's steps and calls are gathered by key and encoded in Arrow batches. What cannot be rebuilt (steps without a
run, gaps in ordinals, repeated step ids) is an error, never a shorter document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import Relations
from . import storyline as hub
from . import unknown

DOCUMENT = ["_file_", "document_id"]
ROLES = {"agent": "assistant"}


def rebuild(r: Relations) -> DataFrame:
    """Runs with their steps (by turn) and the steps' calls (by index) as JSON text in ``steps``."""
    order = lambda *names: F.struct(*names)
    calls = r.tool_calls.groupBy(*DOCUMENT, "step_id").agg(F.array_sort(F.collect_list(order("call_index", *[c for c in r.tool_calls.columns if c not in (*DOCUMENT, "step_id", "call_index")]))).alias("calls"))
    steps = r.steps.join(calls, [*DOCUMENT, "step_id"], "full")
    columns = [c for c in steps.columns if c not in (*DOCUMENT, "turn_ordinal")]
    nested = steps.groupBy(*DOCUMENT).agg(F.array_sort(F.collect_list(order("turn_ordinal", *columns))).alias("steps"))
    joined = r.runs.withColumn("__run", F.lit(True)).join(nested, DOCUMENT, "full")
    return joined.withColumn("steps", F.to_json("steps"))


def _value(text: str | None) -> object:
    return None if text is None else json.loads(text)


def _present(**fields: object) -> dict:
    return {k: v for k, v in fields.items() if v is not None}


def checked(row: dict) -> list[dict]:
    """The steps of a rebuilt row; raises where keys or ordinals do not hold."""
    if row.get("__run") is not True:
        raise ValueError(f"steps of {row['document_id']!r} have no run")
    steps = json.loads(row["steps"]) if row["steps"] else []
    if [s.get("turn_ordinal") for s in steps] != list(range(len(steps))):
        raise ValueError(f"turns of {row['document_id']!r} are not contiguous")
    if len({s["step_id"] for s in steps}) < len(steps):
        raise ValueError(f"a step id of {row['document_id']!r} stands twice")
    for s in steps:
        if [c["call_index"] for c in s.get("calls", [])] != list(range(len(s.get("calls", [])))):
            raise ValueError(f"calls of step {s['step_id']} in {row['document_id']!r} are not contiguous")
    return steps


def _stamp(step: dict) -> object:
    given = _value(step.get("timestamp_source_json"))
    return given if given is not None else step.get("timestamp")


def _carried(row: dict, form: str) -> dict:
    """Fields that the dialect did not define when the document was read from it."""
    return (_value(row.get("unknown_fields_json")) or {}).get(form) or {}


def atif(row: dict) -> dict:
    steps = []
    for s in checked(row):
        metrics = _value(s.get("metrics_json")) or {}
        for name in ("latency_ms", "ttft_ms"):
            if s.get(name) is not None and isinstance(metrics, dict) and not {"latency_ms": {"latency_ms", "elapsed_ms", "duration_ms"}}.get(name, {name}) & metrics.keys():
                metrics[name] = s[name]
        calls = []
        for c in s.get("calls", []):
            extra = _value(c.get("extra_json")) or {}
            if c.get("duration_ms") is not None and isinstance(extra, dict):
                extra["duration_ms"] = c["duration_ms"]
            calls.append(_present(tool_call_id=c["tool_call_id"], function_name=c["function_name"], arguments=_value(c.get("arguments_json")), result=_value(c.get("result_json")), extra=extra or None))
        steps.append(_present(
            step_id=s["step_id"], timestamp=_stamp(s), source=s["source"], model_name=s.get("model_name"), reasoning_effort=_value(s.get("reasoning_effort_json")), message=_value(s.get("message_json")),
            reasoning_content=s.get("reasoning_content"), tool_calls=calls or None, observation=_value(s.get("observation_json")), metrics=metrics or None, extra=_value(s.get("extra_json")),
            llm_call_count=s.get("llm_call_count"), is_copied_context=s.get("is_copied_context"),
        ))
    if not row["session_id"] or not row["agent_id"]:
        raise ValueError("a document without session or agent")
    version = row["schema_version"] if (row["schema_version"] or "").startswith("ATIF") else "ATIF-v1.7"
    agent = _present(name=row["agent_name"] or row["agent_id"], version=row["agent_version"] or "unknown", model_name=row["agent_model_name"], tool_definitions=_value(row["agent_tool_definitions_json"]), extra=_value(row["agent_extra_json"]))
    made = _present(
        schema_version=version, session_id=row["session_id"], trajectory_id=row["document_id"] if row["trajectory_id_explicit"] is True else None, agent=agent, steps=steps, notes=row["notes"],
        final_metrics=_value(row["final_metrics_json"]), continued_trajectory_ref=row["continued_trajectory_ref"], extra=_value(row["extra_json"]),
    )
    unknown.restore(made, _carried(row, "atif"))
    return made


def actf(row: dict) -> dict:
    """The task with this document's one attempt; ``tasks`` brings the attempts of a task together."""
    steps = []
    for s in checked(row):
        prompt = _value(s.get("prompt_json")) or {}
        tools = [_present(type=c.get("kind"), id=c["tool_call_id"], name=c["function_name"], input=_value(c.get("arguments_json"))) for c in s.get("calls", [])]
        steps.append(_present(
            step_id=s["step_id"], assistant_content=_present(content=_value(s.get("message_json")), reasoning_content=s.get("reasoning_content")), metric=_value(s.get("metrics_json")), tools=tools,
            observation=_value(s.get("observation_json")) or [], started_at=_stamp(s), finished_at=_value(s.get("finished_at_json")), system_prompt=prompt.get("system"), user_content=prompt.get("user"),
        ))
    task, _, attempt = row["session_id"].partition("#attempt-")
    head = _value(row["task_json"]) or {"task_id": task}
    path = {"schema_version": "ACTF_v1.0", "steps": steps}
    unknown.restore(path, _carried(row, "actf"))
    return head | {"attempts": {attempt or "1": (_value(row["final_metrics_json"]) or {}) | {"trajectory": path}}}


def openai(row: dict) -> list[dict]:
    """One row per agent turn that is no context, with the turns asked since the one before."""
    out, asked = [], []
    for s in checked(row):
        said = {"role": ROLES.get(s["source"], s["source"]), "content": _value(s.get("message_json"))}
        if s["source"] != "agent" or s.get("is_copied_context"):
            asked.append(said)
            continue
        calls = [{"id": c["tool_call_id"], "type": "function", "function": {"name": c["function_name"], "arguments": c.get("arguments_json")}} for c in s.get("calls", [])]
        answer = said | _present(reasoning_content=s.get("reasoning_content"), tool_calls=calls or None)
        out.append(_present(session_id=row["session_id"], step_id=len(out) + 1, created_at=_stamp(s), agent_id=row["agent_id"], run_id=row["run_id"], llm_model=s.get("model_name"), meta_json=row["meta_json"], messages=asked, response=answer))
        asked = []
    if asked:
        raise ValueError(f"the last turns of {row['session_id']!r} have no answer")
    return out


def storyline(row: dict) -> dict:
    return hub.encode(row, checked(row))


def agenticmd(row: dict) -> str:
    return hub.to_markdown(hub.encode(row, checked(row)))


FORMS = {"atif": atif, "actf": actf, "openai": openai, "storyline": storyline, "agenticmd": agenticmd}


def tasks(encoded: DataFrame) -> DataFrame:
    """ACTF texts with all attempts of a task in one document; a repeated attempt is an error."""
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file, task, texts in rows.itertuples(index=False):
                parts = [json.loads(t) for t in texts]
                attempts = [a for p in parts for a in p["attempts"].items()]
                if len(dict(attempts)) < len(attempts):
                    raise ValueError(f"an attempt of {task!r} stands twice")
                out.append((file, task, json.dumps(parts[0] | {"attempts": dict(attempts)}, ensure_ascii=False, separators=(",", ":"))))
            yield pd.DataFrame(out, columns=["_file_", "document_id", "text"])

    task = F.get_json_object("text", "$.task_id").alias("document_id")
    return encoded.groupBy("_file_", task).agg(F.array_sort(F.collect_list("text")).alias("texts")).mapInPandas(merge, "_file_ string, document_id string, text string")


def export(r: Relations, form: str, where: Column | None = None, most: int | None = None) -> DataFrame:
    """_file_, document_id and text (JSON; one per line for message rows) of the selected documents.

    More documents than ``most`` is an error. Every text is whole or the job fails.
    """
    encode = FORMS[form]
    runs = r.runs if where is None else r.runs.where(where)
    if most is not None and runs.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} documents")
    if where is not None:
        chosen = runs.select(*DOCUMENT)
        r = Relations(runs, r.steps.join(chosen, DOCUMENT, "left_semi"), r.tool_calls.join(chosen, DOCUMENT, "left_semi"), r.events)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
                made = encode(row)
                lines = made if isinstance(made, list) else [made]
                out.append((row["_file_"], row["document_id"], made if isinstance(made, str) else "\n".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in lines)))
            yield pd.DataFrame(out, columns=["_file_", "document_id", "text"])

    return rebuild(r).mapInPandas(write, "_file_ string, document_id string, text string")
