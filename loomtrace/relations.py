"""The engine's relations: explicit schemas, and their form over the supplied tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"s": T.StringType(), "l": T.LongType(), "b": T.BooleanType(), "t": T.TimestampType()}[k], True) for n, k in (x.split(":") for x in text.split())])


RUNS = _schema(
    "schema_version:s origin_json:s document_id:s storage_ordinal:l trajectory_id_explicit:b run_id:s attempt_id:s session_id:s agent_id:s agent_name:s agent_version:s "
    "agent_model_name:s agent_tool_definitions_json:s agent_extra_json:s parent_json:s child_session_ids_json:s notes:s final_metrics_json:s continued_trajectory_ref:s "
    "extra_json:s meta_json:s unknown_fields_json:s unknown_key_counts_json:s task_json:s started_at_json:s finished_at_json:s prompt_json:s"
)
STEPS = _schema(
    "document_id:s run_id:s session_id:s step_id:l turn_ordinal:l kind:s effective_kind:s timestamp:t timestamp_source_json:s source:s message_json:s reasoning_content:s "
    "reasoning_effort_json:s metrics_json:s model_name:s llm_call_count:l is_copied_context:b latency_ms:l ttft_ms:l had_tool_calls:b had_observation:b observation_json:s "
    "extra_json:s env_json:s finished_at_json:s prompt_json:s"
)
TOOL_CALLS = _schema(
    "document_id:s run_id:s session_id:s step_id:l call_index:l tool_call_id:s function_name:s arguments_json:s result_json:s results_json:s duration_ms:l extra_json:s kind:s response_json:s"
)
EVENTS = _schema("append_pos:l seq:l event_id:s timestamp:t kind:s source:s agent_id:s session_id:s call_id:s trace_id:s parent_call_id:s model:s payload_json:s")
SOURCES = _schema("_file_:s format:s kind:s snapshot_ref:s projection_status:s projection_generation:s projection_candidates:l size_bytes:l last_modified:s status:s error:s")
REVISIONS = _schema("revision_id:s parent_revision_ids_json:s kind:s canonical_snapshot:s recipe_json:s status:s created_at:s output_refs_json:s")


@dataclass(frozen=True)
class Relations:
    """DataFrames of one Dataset; each begins with ``_file_``, the source that a row is from."""

    runs: DataFrame
    steps: DataFrame
    tool_calls: DataFrame
    events: DataFrame
    sources: DataFrame | None = None


#: The same relations as DuckDB CTEs.
CTES = """
    runs AS (SELECT DISTINCT 'part-' || (conv_id % 4) AS _file_, 'c' || conv_id AS document_id, conv_id, 's' || conv_id AS session_id, 'agent-' || (conv_id % 5) AS agent_id,
        CASE WHEN conv_id % 2 > 0 THEN 'name-' || (conv_id % 4) END AS agent_name, CASE WHEN conv_id % 3 > 0 THEN 'v' || (conv_id % 3) END AS agent_version,
        CASE WHEN conv_id % 7 > 0 THEN 'model-' || (conv_id % 3) END AS agent_model_name FROM conversations),
    steps AS (SELECT 'part-' || (conv_id % 4) AS _file_, 'c' || conv_id AS document_id, turn AS step_id, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS source, text AS message,
        CASE WHEN turn % 5 > 0 THEN 'm' || length(text) END AS message_json,
        CASE WHEN role = 'assistant' THEN 'model-' || (conv_id % 4) END AS model_name, CASE WHEN role = 'assistant' THEN length(text) * 7 % 12000 END AS latency_ms FROM conversations),
    calls AS (SELECT 'part-' || (user_id % 4) AS _file_, 'c' || user_id AS document_id, event_id // 3 AS step_id, event_id AS call_index, event_type AS function_name, props AS arguments_json,
        CASE WHEN event_type <> 'error' THEN '[' || event_id || ']' END AS results_json, CASE WHEN event_type <> 'error' THEN floor(value * 10)::BIGINT END AS duration_ms FROM events),
    log AS (SELECT 'part-' || (user_id % 4) AS _file_, event_id AS append_pos, event_id // 2 AS seq, CASE WHEN event_id % 17 > 0 THEN 'e' || (event_id - event_id % 97 // 96) END AS event_id, ts AS timestamp,
        CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 20 < 2 THEN 'session.ended' WHEN event_id % 3 = 0 THEN 'tool.result' ELSE 'session.started' END
            WHEN 'purchase' THEN 'llm.request' WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'http.request' ELSE 'llm.request' END
            WHEN 'view' THEN CASE event_id % 4 WHEN 0 THEN 'http.response' WHEN 1 THEN 'llm.response.stream' ELSE 'llm.response' END
            ELSE CASE event_id % 60 WHEN 0 THEN 'run.failed' WHEN 1 THEN 'run.cancelled' WHEN 2 THEN 'run.completed' ELSE 'llm.error' END END AS kind,
        'gateway' AS source, 'agent-' || (user_id % 5) AS agent_id, 's' || user_id AS session_id, CASE WHEN event_id % 13 > 0 THEN 'call-' || (event_id // 400) END AS call_id, 'trace-' || user_id AS trace_id,
        CASE WHEN event_id % 29 = 0 THEN 'call-0' END AS parent_call_id, CASE WHEN event_id % 3 > 0 THEN 'model-' || (user_id % 3) END AS model,
        '{"payload":{"exit_code":' || CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '"1"' WHEN 2 THEN '3' ELSE 'null' END || ',"method":"POST","path":"/v1/' || event_type || '","status":' || (200 + event_id % 3 * 100)
            || ',"duration_ms":' || (event_id % 50) || '.5,"headers":{"x-k":"a","n":1},"body":' || props
            || CASE WHEN event_type IN ('purchase', 'click') THEN ',"model":"m' || (event_id % 3) || '"' || CASE WHEN event_id % 5 > 0 THEN ',"user_content":"ask ' || event_id || '"' ELSE '' END
                || CASE WHEN event_id % 2 = 0 THEN ',"llm_request":{"request":{"messages":[{"parts":[{"type":"tool_result","call_id":"t' || (event_id % 50) || '","content":{"n":' || event_id || '}}]}]}}' ELSE '' END
                WHEN event_type = 'view' THEN CASE WHEN event_id % 7 > 0 THEN ',"content":"answer ' || event_id || '"' ELSE '' END || CASE WHEN event_id % 6 = 0 THEN ',"latency_ms":' || (event_id % 900) ELSE '' END
                || CASE WHEN event_id % 3 = 0 THEN ',"usage":{"prompt_tokens":' || event_id || ',"ttft_ms":' || (event_id % 70) || '}' ELSE '' END
                || CASE WHEN event_id % 2 > 0 THEN ',"llm_response":{"response":{"candidates":[{"message":{"parts":[{"type":"tool_call","id":"t' || (event_id % 50) || '","name":"f' || (event_id % 4) || '","arguments":{"a":' || event_id || '}}]}}]}}' ELSE '' END
                ELSE '' END || '}}' AS payload_json FROM events)"""


def _file(key: str):
    return F.concat(F.lit("part-"), (F.col(key) % 4).cast("string")).alias("_file_")


def _tag(prefix: str, value) -> object:
    return F.concat(F.lit(prefix), value.cast("string"))


def _said(form: str, *values) -> object:
    """``form`` with each {} replaced by a value."""
    parts = form.split("{}")
    return F.concat(*[x for part, value in zip(parts, [*values, None], strict=True) for x in ([F.lit(part)] if value is None else [F.lit(part), value.cast("string")])])


def over_tables(spark: SparkSession, sf_dir: str) -> Relations:
    """Conversations as runs and steps, events as tool calls and as the event log."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    conv, agent = F.col("conv_id"), F.col("role") == "assistant"
    runs = talk.select("conv_id").distinct().select(
        _file("conv_id"), _tag("c", conv).alias("document_id"), "conv_id", _tag("s", conv).alias("session_id"), _tag("agent-", conv % 5).alias("agent_id"),
        F.when(conv % 2 > 0, _tag("name-", conv % 4)).alias("agent_name"), F.when(conv % 3 > 0, _tag("v", conv % 3)).alias("agent_version"), F.when(conv % 7 > 0, _tag("model-", conv % 3)).alias("agent_model_name"),
    )
    chars = F.char_length("text").cast("long")
    steps = talk.select(
        _file("conv_id"), _tag("c", conv).alias("document_id"), F.col("turn").alias("step_id"), F.when(agent, "agent").otherwise(F.col("role")).alias("source"), F.col("text").alias("message"),
        F.when(F.col("turn") % 5 > 0, _tag("m", chars)).alias("message_json"), F.when(agent, _tag("model-", conv % 4)).alias("model_name"), F.when(agent, chars * 7 % 12000).alias("latency_ms"),
    )
    eid, user = F.col("event_id"), F.col("user_id")
    kind_of, fine = F.col("event_type"), F.col("event_type") != "error"
    calls = log.select(
        _file("user_id"), _tag("c", user).alias("document_id"), F.expr("event_id div 3").alias("step_id"), eid.alias("call_index"), kind_of.alias("function_name"), F.col("props").alias("arguments_json"),
        F.when(fine, F.concat(F.lit("["), eid.cast("string"), F.lit("]"))).alias("results_json"), F.when(fine, F.floor(F.col("value") * 10)).alias("duration_ms"),
    )
    kind = (
        F.when(kind_of == "signup", F.when(eid % 20 < 2, "session.ended").when(eid % 3 == 0, "tool.result").otherwise("session.started"))
        .when(kind_of == "purchase", "llm.request").when(kind_of == "click", F.when(eid % 4 == 0, "http.request").otherwise("llm.request"))
        .when(kind_of == "view", F.when(eid % 4 == 0, "http.response").when(eid % 4 == 1, "llm.response.stream").otherwise("llm.response"))
        .otherwise(F.when(eid % 60 == 0, "run.failed").when(eid % 60 == 1, "run.cancelled").when(eid % 60 == 2, "run.completed").otherwise("llm.error"))
    )
    code = F.when(eid % 4 == 0, "0").when(eid % 4 == 1, '"1"').when(eid % 4 == 2, "3").otherwise("null")
    payload = F.concat(
        F.lit('{"payload":{"exit_code":'), code, F.lit(',"method":"POST","path":"/v1/'), kind_of, F.lit('","status":'), (200 + eid % 3 * 100).cast("string"),
        F.lit(',"duration_ms":'), (eid % 50).cast("string"), F.lit('.5,"headers":{"x-k":"a","n":1},"body":'), F.col("props"),
        F.when(
            kind_of.isin("purchase", "click"),
            F.concat(
                _said(',"model":"m{}"', eid % 3), F.when(eid % 5 > 0, _said(',"user_content":"ask {}"', eid)).otherwise(""),
                F.when(eid % 2 == 0, _said(',"llm_request":{"request":{"messages":[{"parts":[{"type":"tool_result","call_id":"t{}","content":{"n":{}}}]}]}}', eid % 50, eid)).otherwise(""),
            ),
        ).when(
            kind_of == "view",
            F.concat(
                F.when(eid % 7 > 0, _said(',"content":"answer {}"', eid)).otherwise(""), F.when(eid % 6 == 0, _said(',"latency_ms":{}', eid % 900)).otherwise(""),
                F.when(eid % 3 == 0, _said(',"usage":{"prompt_tokens":{},"ttft_ms":{}}', eid, eid % 70)).otherwise(""),
                F.when(eid % 2 > 0, _said(',"llm_response":{"response":{"candidates":[{"message":{"parts":[{"type":"tool_call","id":"t{}","name":"f{}","arguments":{"a":{}}}]}}]}}', eid % 50, eid % 4, eid)).otherwise(""),
            ),
        ).otherwise(""), F.lit("}}"),
    )
    events = log.select(
        _file("user_id"), eid.alias("append_pos"), F.expr("event_id div 2").alias("seq"), F.when(eid % 17 > 0, _tag("e", eid - F.expr("event_id % 97 div 96"))).alias("event_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        kind.alias("kind"), F.lit("gateway").alias("source"), _tag("agent-", user % 5).alias("agent_id"), _tag("s", user).alias("session_id"), F.when(eid % 13 > 0, _tag("call-", F.expr("event_id div 400"))).alias("call_id"),
        _tag("trace-", user).alias("trace_id"), F.when(eid % 29 == 0, "call-0").alias("parent_call_id"), F.when(eid % 3 > 0, _tag("model-", user % 3)).alias("model"), payload.alias("payload_json"),
    )
    return Relations(runs, steps, calls, events)
