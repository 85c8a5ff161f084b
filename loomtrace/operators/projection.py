"""Event log: ordered reads, folding calls into turns, and keeping the fold up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .documents import ANSWERS as RESPONSE
from .documents import ASKS as REQUEST


def append_range(events: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of the half-open range of append positions, in order."""
    return events.where((F.col("append_pos") >= start) & (F.col("append_pos") < end)).orderBy("append_pos")


def history(events: DataFrame, sessions: Sequence[str] | DataFrame, max_rows: int | None = None) -> DataFrame:
    """All rows of some sessions in append order; more than ``max_rows`` is an error, not a cut."""
    if isinstance(sessions, DataFrame):
        rows = events.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    else:
        rows = events.where(F.col("session_id").isin(list(sessions)))
    if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return rows.orderBy("append_pos")


def page(events: DataFrame, offset: int, limit: int) -> DataFrame:
    return events.orderBy("append_pos").offset(offset).limit(limit)


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, marked as missing or extra."""
    missing = expected.join(actual, keys, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.join(expected, keys, "left_anti").withColumn("side", F.lit("extra")))


def call_pairs(events: DataFrame) -> DataFrame:
    """Request and response (records as structs) of each call, the last of either winning; calls without a request are left out.

    An event without a call id is a call of its own, ``seq-`` and its number.
    """
    key = F.coalesce("call_id", F.concat(F.lit("seq-"), F.col("seq").cast("string"))).alias("call_id")
    asks = F.instr("kind", "request") > 0
    answers = ~asks & (F.instr("kind", "response") > 0)
    record = F.struct("timestamp", "trace_id", F.get_json_object("payload_json", "$.payload").alias("payload"))
    return events.groupBy("session_id", key).agg(F.max_by(record, F.when(asks, F.col("append_pos"))).alias("request"), F.max_by(record, F.when(answers, F.col("append_pos"))).alias("response")).where("request is not null")


def fold(events: DataFrame) -> DataFrame:
    """Turns per session from calls that have both sides, numbered by the call's first event."""
    is_request, is_response = F.col("kind").isin(*REQUEST), F.col("kind").isin(*RESPONSE)
    ms = lambda c: F.unix_micros(F.to_timestamp(c))
    calls = events.groupBy("session_id", "call_id").agg(
        F.min("append_pos").alias("first_pos"), F.min(F.when(is_request, F.col("append_pos"))).alias("asked"), F.max(F.when(is_response, F.col("append_pos"))).alias("answered"),
        F.max_by("payload_json", F.when(is_response, F.col("append_pos"))).alias("answer"), F.min(F.when(is_request, F.col("timestamp"))).alias("t0"), F.max(F.when(is_response, F.col("timestamp"))).alias("t1"),
    )
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("first_pos")).cast("long")
    whole = F.floor(ms("t1") / 1000) - F.floor(ms("t0") / 1000)
    return calls.where("asked is not null and answered is not null").select("session_id", "call_id", turn.alias("turn"), "answer", whole.alias("latency_ms"))


def sync(folded: DataFrame, events: DataFrame, watermark: int) -> DataFrame:
    """``folded`` brought up to date: sessions with rows from ``watermark`` on are folded anew from their full history."""
    touched = events.where(F.col("append_pos") >= watermark).select("session_id").distinct()
    fresh = fold(events.join(touched, "session_id", "left_semi"))
    return folded.join(touched, "session_id", "left_anti").unionByName(fresh)


def remaining(tasks: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Tasks in neither ledger."""
    return tasks.join(done.select(key).unionAll(failed.select(key)), key, "left_anti")
