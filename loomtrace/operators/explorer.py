"""Explorer over run summaries and steps: search, sorting, pages, tools, unknown keys, run resolution and linking of subagents."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SORT_KEYS = {"session": "session_id", "events": "row_count", "status": "status", "agent": "agent_id"}
RUN_PAGE, TURN_PAGE = 200, 500
#: Prompts shorter than this in bytes are never compared, longer ones on at most so many.
PROMPT_LEAST, PROMPT_MOST = 40, 80
#: Words of a run's status in its metadata.
DONE_WORDS, FAILED_WORDS = frozenset({"complete", "completed", "ok", "success", "succeeded"}), frozenset({"cancelled", "canceled", "error", "failed", "failure"})


class Ambiguous(LookupError):
    """A selector that fits several runs."""


def folded(text: Column) -> Column:
    """A-Z in small letters; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def contains(needle: str | None, *columns: str) -> Column:
    """Whether the columns, joined by blanks, hold the needle; blank needles fit all."""
    needle = (needle or "").strip().translate(str.maketrans(UPPER, LOWER))
    return F.contains(folded(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))), F.lit(needle)) if needle else F.lit(True)


def fits(column: str, wanted: str | None) -> Column:
    """Equality without regard to case; blank or ``all`` is no filter."""
    wanted = (wanted or "").strip().translate(str.maketrans(UPPER, LOWER))
    return F.lit(True) if wanted in ("", "all") else folded(F.coalesce(F.col(column), F.lit(""))) == wanted


def under(column: str, path: str | None) -> Column:
    """The path itself or what lies below it."""
    path = (path or "").strip()
    return (F.col(column) == path) | F.startswith(F.col(column), F.lit(path + "/")) if path else F.lit(True)


def run_path(dataset: Column, file: Column, document: Column, session: Column, run: Column, parent: Column) -> Column:
    """Place of a run in the tree: in a store (file ``.``) by document, in files by root session."""
    root = F.coalesce(parent, F.when(run != session, run))
    stored = F.when(parent != session, F.concat_ws("/", dataset, parent, F.lit("subagents"), document)).otherwise(F.concat_ws("/", dataset, document))
    filed = F.when(root != session, F.concat_ws("/", dataset, file, root, session)).otherwise(F.concat_ws("/", dataset, file, session))
    return F.when(file == ".", stored).otherwise(filed)


def search_runs(runs: DataFrame, q: str | None = None, path: str | None = None, **wanted: str | None) -> DataFrame:
    """Summaries that hold ``q`` in agent, session, root session, status or path, lie under ``path`` and fit the filters."""
    columns = [c for c in ("agent_id", "session_id", "root_session_id", "status", "path") if c in runs.columns]
    condition = contains(q, *columns) & under("path", path)
    for name, value in wanted.items():
        condition &= fits(name, value)
    return runs.where(condition)


def search_turns(steps: DataFrame, q: str | None = None, source: str | None = None) -> DataFrame:
    return steps.where(fits("source", source) & contains(q, *(c for c in ("source", "effective_kind", "call_id", "message", "message_json") if c in steps.columns)))


def sorted_runs(runs: DataFrame, sort: str = "session", descending: bool = False, order: str = "path") -> DataFrame:
    """Sorted by a key, ties in the given order; descending is the exact reverse."""
    keys = [SORT_KEYS.get(sort, "session_id"), order]
    return runs.orderBy(*(F.desc_nulls_last(k) if descending else F.asc_nulls_first(k) for k in keys))


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    next_offset: int | None

    @property
    def has_more(self) -> bool:
        return self.next_offset is not None


def paginate(rows: DataFrame, offset: int = 0, limit: int = 50, most: int = RUN_PAGE) -> Page:
    """A page of sorted rows; the offset is held within the total, the limit within 1 and ``most``."""
    total, limit = rows.count(), min(max(limit, 1), most)
    offset = min(max(offset, 0), total)
    return Page(rows.offset(offset).limit(limit), total, offset + limit if offset + limit < total else None)


def tool_errors(calls: DataFrame, failed_steps: DataFrame, keys: Sequence[str] = ("_file_", "document_id", "step_id")) -> DataFrame:
    """Per tool: calls, duration samples, total, mean and longest duration (null without samples), calls in steps that failed."""
    marked = calls.join(failed_steps.select(*keys).distinct().withColumn("__bad", F.lit(1)), list(keys), "left")
    total = F.sum("duration_ms")
    return marked.groupBy(F.col("function_name").alias("name")).agg(
        F.count("*").alias("count"), F.count("duration_ms").alias("duration_sample_count"), total.alias("total_duration_ms"),
        (total / F.count("duration_ms")).alias("average_duration_ms"), F.max("duration_ms").alias("max_duration_ms"), F.count("__bad").alias("error_associated_count"),
    )


def unknown_keys(pointers: DataFrame, form: str = "format", pointer: str = "pointer") -> DataFrame:
    """How often each unknown JSON pointer occurs per format; array places count as one."""
    return pointers.groupBy(form, F.regexp_replace(pointer, r"/\d+(?=/|$)", "/*").alias(pointer)).agg(F.count("*").alias("occurrences"))


def resolve(runs: DataFrame, agent: str, session: str, root: str | None = None, **wanted: str | None) -> Row:
    """The one run of an agent (or model) and session; the root session only decides between several."""
    named = (F.col("agent_id") == agent) | (F.col("model_name").eqNullSafe(F.lit(agent)))
    condition = named & (F.col("session_id") == session)
    for name, value in wanted.items():
        if value:
            condition &= F.col(name) == value
    found = runs.where(condition).limit(1001).collect()  # several is an error, whatever their number
    if len(found) > 1 and root:
        found = runs.where(condition & F.col("root_session_id").eqNullSafe(F.lit(root))).limit(2).collect()
    if not found:
        raise LookupError("no such run")
    if len(found) > 1:
        raise Ambiguous("several runs fit; name dataset, _file_ and session_id")
    return found[0]


def aligned(rows: DataFrame, ids: Sequence[str], key: str = "document_id") -> DataFrame:
    """Rows in the order of the requested ids, null where there is none; a repeated id is an error."""
    if len(set(ids)) < len(ids):
        raise ValueError("an id is asked for twice")
    wanted = rows.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], f"request long, {key} string")
    return F.broadcast(wanted).join(rows, key, "left").orderBy("request") if len(ids) <= 10_000 else wanted.join(rows, key, "left").orderBy("request")


def link_subagents(hints: DataFrame, agents: DataFrame) -> DataFrame:
    """session_id, hint (its number), agent_id (null if none): each spawn's agent, by target document, else by prompt.

    ``hints`` has session_id, hint, doc_target, prompt; ``agents`` has session_id, agent_id, doc_target, first_prompt.
    Hints choose in order, an agent is used once, and of several the smallest id is taken.
    """
    def squeezed(text: str | None) -> bytes:
        return "".join((text or "").split()).encode()

    def link(spawned: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("agent_id")
        free = {a: (d, squeezed(p)) for a, d, p in zip(known["agent_id"], known["doc_target"], known["first_prompt"], strict=True)}
        out = []
        for session, number, target, prompt in spawned.sort_values("hint")[["session_id", "hint", "doc_target", "prompt"]].itertuples(index=False):
            found = next((a for a, (d, _) in free.items() if target is not None and d == target), None)
            said = squeezed(prompt)
            if found is None and len(said) >= PROMPT_LEAST:
                alike = lambda p: len(p) >= PROMPT_LEAST and p[: (n := min(PROMPT_MOST, len(p), len(said)))] == said[:n]
                found = next((a for a, (_, p) in free.items() if alike(p)), None)
            free.pop(found, None)
            out.append((session, number, found))
        return pd.DataFrame(out, columns=["session_id", "hint", "agent_id"])

    return hints.groupBy("session_id").cogroup(agents.groupBy("session_id")).applyInPandas(link, "session_id string, hint long, agent_id string")


def _under_key(value: object, key: str, kind: type) -> object:
    """A value of a kind under the key, or under a JSON pointer that ends in it, before those of the children."""
    if isinstance(value, dict):
        if isinstance(value.get(key), kind):
            return value[key]
        for name, child in value.items():
            if name.rsplit("/", 1)[-1] == key and isinstance(child, kind):
                return child
        value = list(value.values())
    for child in value if isinstance(value, list) else ():
        if (found := _under_key(child, key, kind)) is not None:
            return found
    return None


def metadata_status(texts: Sequence[str | None]) -> str:
    """Status of a run from its metrics, extras and unknown fields (JSON texts, in this order)."""
    values = []
    for text in texts:
        try:
            values.append(json.loads(text) if text else None)
        except ValueError:
            continue
    for key in ("status", "state"):
        for value in values:
            if (word := _under_key(value, key, str)) is not None:
                word = word.strip().lower()
                return "completed" if word in DONE_WORDS else "failed" if word in FAILED_WORDS else "active"
    done = any(_under_key(v, k, bool) is True for v in values for k in ("is_session_completed", "is_terminal"))
    return "completed" if done else "active"


@F.pandas_udf(T.StringType())
def run_status(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for parts in batches:
        yield pd.Series([metadata_status(x) for x in zip(*parts, strict=True)], dtype=object)
