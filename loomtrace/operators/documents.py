"""The whole fold of an event log into documents, and documents kept in three tables that change as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..relations import EVENTS, RUNS, STEPS, TOOL_CALLS, Relations

#: Kinds of events that ask and answer.
ASKS = ("llm.request", "http.request")
ANSWERS = ("llm.response", "llm.response.stream", "http.response", "http.response.stream")
SESSION = ["_file_", "session_id"]
CALL = [*SESSION, "call_id"]
_PART = "array<struct<type string, id string, name string, arguments string, signature string, call_id string, content string>>"
_ASKED = f"struct<messages array<struct<parts {_PART}>>>"
_ANSWERED = f"struct<model string, candidates array<struct<message struct<parts {_PART}>>>>"


def quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, 2, F.length(listed) - 2))


def _of(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("wire", f"$.{path}", kind)


def _text(path: str) -> Column:
    """A text under a path of the payload; other kinds of values are no text."""
    found = _of(path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", _of(path))


def _read(events: DataFrame) -> DataFrame:
    """Events with what the fold reads of their payloads."""
    payload = F.get_json_object("payload_json", "$.payload")
    held = events.withColumn("payload", payload).withColumn("wire", F.try_parse_json("payload"))
    messages = F.from_json(F.get_json_object("payload", "$.messages"), "array<struct<role string, content string>>")
    users = F.filter(messages, lambda m: (m.role == "user") & m.content.isNotNull())
    return held.select(
        *CALL, "append_pos", "seq", "kind", "timestamp", "payload", _text("model").alias("model"),
        F.coalesce(_text("user_content"), F.try_element_at(users, F.lit(-1)).content).alias("user_text"),
        F.get_json_object("payload", "$.messages").alias("messages"),
        F.coalesce(_text("assistant_content"), _text("choices[0].message.content"), _text("content")).alias("answer"),
        F.get_json_object("payload", "$.usage").alias("usage"), _of("ttft_ms", "long").alias("ttft"), _of("usage.ttft_ms", "long").alias("usage_ttft"), _of("latency_ms", "long").alias("latency"),
        F.from_json(F.get_json_object("payload", "$.llm_request.request"), _ASKED).alias("asked"),
        F.from_json(F.get_json_object("payload", "$.llm_response.response"), _ANSWERED).alias("answered"),
    )


def _calls(read: DataFrame) -> DataFrame:
    """One row per call of a session: its last request, and what its responses say, the last one winning."""
    asks, answers, at = F.col("kind").isin(*ASKS), F.col("kind").isin(*ANSWERS), F.col("append_pos")
    last = lambda c, when: F.max_by(c, F.when(when, at))
    first = lambda c, when: F.min_by(c, F.when(when, at))
    request = F.struct(F.col("timestamp").alias("t"), "model", "user_text", "messages")
    response = F.struct(F.col("timestamp").alias("t"), "answer", "ttft")
    return read.where("call_id <> ''").groupBy(CALL).agg(
        F.min(at).alias("first_pos"), first("timestamp", F.lit(True)).alias("first_t"), last(request, asks).alias("q"), last(response, answers).alias("a"),
        first("seq", asks).alias("q_seq"), first("seq", answers).alias("a_seq"), first("answered.model", answers & F.col("answered.model").isNotNull()).alias("a_model"),
        last("usage", answers & F.col("usage").isNotNull()).alias("usage"), last("usage_ttft", answers & F.col("usage").isNotNull()).alias("usage_ttft"),
        first("latency", answers & F.col("latency").isNotNull()).alias("latency"),
    )


def _turns(read: DataFrame) -> DataFrame:
    """The turns of every session, numbered from 1: those of calls in order of their first events, then the session's own records."""
    user, answer = F.col("q.user_text"), F.col("a.answer")
    said = F.when(answer.isNotNull() | user.isNull(), "agent").otherwise("user")
    none = F.lit(None)
    agent = said == "agent"
    ms = lambda c: F.floor(F.unix_micros(c) / 1000)
    latency = F.coalesce("latency", ms(F.col("a.t")) - ms(F.col("q.t")))
    main_seq = F.when(answer.isNotNull(), F.col("a_seq")).when(user.isNotNull(), F.col("q_seq")).otherwise(F.coalesce("a_seq", "q_seq"))

    def turn(place: int, kind, when, source, text, seq, messages, usage, model, latency, ttft) -> Column:
        return F.struct(
            F.lit(place).alias("place"), kind.alias("kind"), when.alias("timestamp"), source.alias("source"), text.alias("message"), seq.alias("seq"), messages.alias("request_messages"),
            usage.cast("string").alias("metrics_json"), model.cast("string").alias("model_name"), latency.cast("long").alias("latency_ms"), ttft.cast("long").alias("ttft_ms"),
        )

    asked = turn(0, F.lit("llm.request"), F.coalesce(F.col("q.t"), F.col("first_t")), F.lit("user"), user, F.col("q_seq"), F.lit(None).cast("string"), none, none, none, none)
    main = turn(
        1, F.when(answer.isNull() & user.isNotNull(), "llm.request").otherwise("llm.response"), F.coalesce("a.t", "q.t", "first_t"), said, F.coalesce(answer, user, F.lit("")), main_seq,
        F.col("q.messages"), F.col("usage"), F.coalesce("q.model", "a_model"), F.when(agent, latency), F.when(agent, F.coalesce("a.ttft", "usage_ttft")),
    )
    both = F.when(user.isNotNull() & answer.isNotNull(), F.array(asked, main)).otherwise(F.array(main))
    rows = _calls(read).select(*CALL, "first_pos", F.explode(both).alias("t")).select(*CALL, "first_pos", F.lit(False).alias("own"), "t.*")
    own = read.where("coalesce(call_id, '') = '' and (kind like 'session.%' or kind = 'note')")
    record = F.concat(F.lit('{"kind":'), quoted(F.col("kind")), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    internal = turn(0, F.lit("internal"), F.col("timestamp"), F.lit("system"), record, F.col("seq"), F.lit(None).cast("string"), none, none, none, none)
    rows = rows.unionByName(own.select(*SESSION, F.lit(None).cast("string").alias("call_id"), F.col("append_pos").alias("first_pos"), F.lit(True).alias("own"), internal.alias("t")).select(*CALL, "first_pos", "own", "t.*"))
    order = Window.partitionBy(SESSION).orderBy("own", "first_pos", "place")
    return rows.withColumn("step_id", F.row_number().over(order).cast("long"))


def _shaped(rows: DataFrame, schema) -> DataFrame:
    """``rows`` in a declared schema, null where they have no such column."""
    return rows.select("_file_", *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def fold_events(events: DataFrame) -> Relations:
    """Documents of an event log (``_file_`` and the columns of EVENTS): one per session, with turns and tool calls.

    A call's request is its last one; of its responses the last one's text holds, and the first latency that is told. A call with
    both sides is a user's and an agent's turn. What carries no call id is a turn only if it is the session's own record or a note.
    A tool call, named by a response's part, has the last result that any request of the session brings for its id.
    Events without a session id belong to no document.
    """
    read = _read(events.where("session_id <> ''"))
    turns = _turns(read)
    part = lambda c, kind: F.filter(c, lambda p: p.type == kind)
    brought = read.where("asked is not null").select(*SESSION, "append_pos", F.posexplode(part(F.flatten(F.transform("asked.messages", lambda m: m.parts)), "tool_result")).alias("i", "p"))
    results = brought.where("p.call_id <> ''").groupBy(*SESSION, F.col("p.call_id").alias("tool_call_id")).agg(F.max_by("p.content", F.struct("append_pos", "i")).alias("result"))
    made = read.where("call_id <> '' and answered is not null").select(*CALL, "append_pos", F.posexplode(part(F.flatten(F.transform("answered.candidates", lambda c: c.message.parts)), "tool_call")).alias("i", "p"))
    place = F.struct("append_pos", "i")
    named = made.where("p.id <> ''").groupBy(*CALL, F.col("p.id").alias("tool_call_id")).agg(F.min(place).alias("first"), F.max_by("p", place).alias("p"))
    main = turns.where("place = 1").select(*CALL, "step_id")
    calls = named.join(main, CALL).join(results, [*SESSION, "tool_call_id"], "left").withColumn("call_index", (F.row_number().over(Window.partitionBy(CALL).orderBy("first")) - 1).cast("long"))
    json_value = lambda c: F.when(F.try_parse_json(c).isNotNull(), c).otherwise(quoted(c))
    tool_calls = calls.select(
        "_file_", F.col("session_id").alias("document_id"), "session_id", "step_id", "call_index", "tool_call_id", F.col("p.name").alias("function_name"), json_value(F.col("p.arguments")).alias("arguments_json"),
        json_value(F.col("result")).alias("result_json"), F.when(F.col("p.signature").isNotNull(), F.concat(F.lit('{"signature":'), quoted(F.col("p.signature")), F.lit("}"))).alias("extra_json"),
    )
    counted = named.groupBy(CALL).agg(F.lit(True).alias("had"))
    extra = F.when(F.col("own"), F.concat(F.lit('{"seq":'), F.col("seq"), F.lit(',"event_seq":'), F.col("seq"), F.lit("}"))).otherwise(
        F.concat(F.lit('{"call_id":'), quoted(F.col("call_id")), F.when(F.col("place") == 1, F.concat(F.lit(',"request_messages":'), F.coalesce("request_messages", F.lit("null")))).otherwise(""),
                 F.coalesce(F.concat(F.lit(',"seq":'), F.col("seq").cast("string")), F.lit("")), F.lit("}")))
    steps = turns.join(counted, CALL, "left").withColumns({
        "document_id": F.col("session_id"), "turn_ordinal": F.col("step_id") - 1, "effective_kind": F.col("kind"), "message_json": F.when(F.col("own"), F.col("message")).otherwise(quoted(F.col("message"))),
        "llm_call_count": F.when((F.col("place") == 1) & (F.col("source") == "agent"), 1), "had_tool_calls": (F.col("place") == 1) & F.coalesce("had", F.lit(False)), "extra_json": extra,
    })
    model = turns.where("model_name is not null").groupBy(SESSION).agg(F.max_by("model_name", "step_id").alias("agent_model_name"))
    runs = events.where("session_id <> ''").groupBy(SESSION).agg(F.coalesce(F.max_by("agent_id", F.when(F.col("agent_id").isNotNull(), F.col("append_pos"))), F.lit("unknown")).alias("agent_id"))
    runs = runs.join(model, SESSION, "left").withColumns({"document_id": F.col("session_id"), "agent_name": F.col("agent_id"), "origin_json": F.lit('{"format":"canonical_event"}')})
    return Relations(_shaped(runs, RUNS), _shaped(steps, STEPS), _shaped(tool_calls, TOOL_CALLS), _shaped(events, EVENTS))


def linked_events(steps: DataFrame, events: DataFrame) -> DataFrame:
    """``_file_``, session_id, step_id, seq: the events of every turn, by the sequence number it records, else all of its call."""
    seq = F.coalesce(F.get_json_object("extra_json", "$.seq"), F.get_json_object("extra_json", "$.event_seq")).try_cast("long")
    held = steps.select(*SESSION, "step_id", seq.alias("seq"), F.get_json_object("extra_json", "$.call_id").alias("call_id"))
    direct = held.where("seq is not null").select(*SESSION, "step_id", "seq")
    return direct.unionByName(held.where("seq is null and call_id is not null").drop("seq").join(events.select(*CALL, "seq"), CALL).select(*SESSION, "step_id", "seq"))
