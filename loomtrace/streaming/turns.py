"""Turns of a session: a request with a user's text opens a dialogue, the first other one an autonomous turn.

Internal requests and all later ones belong to the turn that is open; responses and cancellations to the
turn of their own call. In batches this is three window functions; as a stream, state is kept per session. Both give
the same turns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANSWERS = ("llm.response", "llm.response.stream", "llm.call.cancelled")
ROWS = "session_id string, append_pos long, kind string, call_id string, turn_index long"
STATE = "opened long, calls string"


def prepared(events: DataFrame, internal: Column, user_text: Column) -> DataFrame:
    """session_id, append_pos, kind, call_id, internal, spoken (a user's text is there), as both forms read it."""
    return events.select("session_id", "append_pos", "kind", F.coalesce("call_id", F.lit("unknown")).alias("call_id"), F.coalesce(internal, F.lit(False)).alias("internal"), user_text.isNotNull().alias("spoken"))


def assign(events: DataFrame) -> DataFrame:
    """``prepared`` events with turn_index (from 0; null before the first turn)."""
    session = Window.partitionBy("session_id").orderBy("append_pos")
    call = Window.partitionBy("session_id", "call_id").orderBy("append_pos").rowsBetween(Window.unboundedPreceding, 0)
    asks, answers = F.col("kind") == "llm.request", F.col("kind").isin(*ANSWERS)
    outer = asks & ~F.col("internal")
    marked = events.withColumn("outer", F.count(F.when(outer, 1)).over(session))
    opens = outer & (F.col("spoken") | (F.col("outer") == 1))
    opened = marked.withColumn("open", F.nullif(F.count(F.when(opens, 1)).over(session), F.lit(0)) - 1)
    asked = F.last(F.when(asks, F.col("open")), ignorenulls=True).over(call)
    answered = F.first(F.when(answers, F.col("open")), ignorenulls=True).over(call)
    turn = F.when(answers, F.coalesce(asked, answered)).otherwise(F.col("open"))
    return opened.select("session_id", "append_pos", "kind", "call_id", turn.cast("long").alias("turn_index"))


class Machine:
    """One session's turns, event by event."""

    def __init__(self, opened: int = 0, calls: dict[str, int] | None = None):
        self.opened, self.calls = opened, calls or {}

    def observe(self, kind: str, call: str, internal: bool, spoken: bool) -> int | None:
        if kind == "llm.request" and not internal and (spoken or not self.opened):
            self.opened += 1
        open_turn = self.opened - 1 if self.opened else None
        if kind == "llm.request":
            turn = open_turn
        elif kind in ANSWERS:
            turn = self.calls.get(call, open_turn)
        else:
            return open_turn
        if turn is not None:
            self.calls[call] = turn
        return turn


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    opened, calls = state.get if state.exists else (0, "{}")
    machine = Machine(opened, json.loads(calls))
    rows = pd.concat(list(batches)).sort_values("append_pos")
    found = [machine.observe(*x) for x in rows[["kind", "call_id", "internal", "spoken"]].itertuples(index=False)]
    state.update((machine.opened, json.dumps(machine.calls)))
    yield rows[["session_id", "append_pos", "kind", "call_id"]].assign(turn_index=pd.array(found, dtype="Int64"))


def follow(stream: DataFrame) -> DataFrame:
    """A stream of ``prepared`` events with turn_index; events of a session must come in append order between batches."""
    return stream.groupBy("session_id").applyInPandasWithState(_advance, ROWS, STATE, "append", GroupStateTimeout.NoTimeout)
