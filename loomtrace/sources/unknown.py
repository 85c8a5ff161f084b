"""Fields that a dialect does not define: kept by JSON pointer beside the document and put back when it is written again."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

Shape = dict[str, "Shape | list[Shape] | None"]


def _token(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def collect(value: object, shape: Shape, at: str = "") -> Iterator[tuple[str, object]]:
    """(pointer, value) of every field outside ``shape``; None in a shape is a field whose inside is kept whole."""
    if not isinstance(value, dict):
        return
    for key, child in value.items():
        path = f"{at}/{_token(key)}"
        if key not in shape:
            yield path, child
        elif isinstance(shape[key], dict):
            yield from collect(child, shape[key], path)
        elif isinstance(shape[key], list) and isinstance(child, list):
            for k, item in enumerate(child):
                yield from collect(item, shape[key][0], f"{path}/{k}")


def restore(value: object, fields: dict[str, object]) -> None:
    """Insert the fields; what has come to be defined since is not overwritten, a place that is gone is an error."""
    for pointer, found in fields.items():
        *path, last = (t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:])
        node = value
        try:
            for token in path:
                node = node[int(token)] if isinstance(node, list) else node[token]
            if not isinstance(node, dict):
                raise KeyError(last)
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise ValueError(f"no place for the field {pointer}") from e
        node.setdefault(last, found)


def counts(fields: dict[str, object]) -> dict[str, int]:
    """Occurrences by pointer, positions in arrays as ``*``."""
    return dict(Counter(re.sub(r"/\d+(?=/)", "/*", p) for p in fields))


def _shape(text: str, **inner: object) -> Shape:
    return dict.fromkeys(text.split()) | inner


#: The fields that each dialect defines.
ATIF = _shape(
    "schema_version session_id trajectory_id notes final_metrics continued_trajectory_ref extra subagent_trajectories", agent=_shape("id name version model_name tool_definitions extra"),
    steps=[_shape("step_id timestamp source kind model_name reasoning_effort message reasoning_content observation metrics extra llm_call_count is_copied_context", tool_calls=[_shape("tool_call_id function_name arguments result extra")])],
)
ACTF_TRAJECTORY = _shape("schema_version", steps=[_shape("step_id metric observation started_at finished_at system_prompt user_content", assistant_content=_shape("content reasoning_content tool_calls"), tools=[_shape("type id name input")])])
