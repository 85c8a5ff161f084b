"""Queries of the engine's own operators over the supplied tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars
from .operators import analysis, documents, eventlog, exchange, explorer, ivf, projection, queueing, results, search, tables
from .plans import routing
from .relations import CTES, over_tables
from .streaming import turns

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, relations: bool = True):
    """Register a query under its function's name; ``sql`` may use the relations as CTEs."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {CTES} {', ' + sql[5:] if sql.startswith('WITH ') else sql}" if relations else sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- scans, projection, predicates -------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, coalesce(o_orderpriority, '') AS priority FROM orders", relations=False)
def scan_project(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"), F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT (l_discount > 0.05) AND l_shipdate IS NOT NULL", relations=False)
def filter_predicates(spark, d):
    c = F.col
    return _t(spark, d, "lineitem").where(c("l_quantity").between(10, 20) & c("l_returnflag").isin("A", "R") & ~(c("l_discount") > 0.05) & c("l_shipdate").isNotNull()).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%_t%' OR p_brand LIKE 'Brand#1!_%' ESCAPE '!'", relations=False)
def like_filter(spark, d):
    return _t(spark, d, "part").where("p_name LIKE 's%_t%' OR p_brand LIKE 'Brand#1!_%' ESCAPE '!'").select("p_partkey", "p_name")


@query("SELECT _file_, document_id, step_id, source FROM steps WHERE document_id = 'c7' ORDER BY 1, 2, 3 LIMIT 51")
def find_identity(spark, d):
    return analysis.find(over_tables(spark, d).steps.select("_file_", "document_id", "step_id", "source"), 50, document_id="c7")


@query("SELECT append_pos, session_id, kind FROM log WHERE append_pos >= 100 AND append_pos < 900")
def event_range_scan(spark, d):
    return projection.append_range(over_tables(spark, d).events, 100, 900).select("append_pos", "session_id", "kind")


@query("SELECT append_pos, session_id, kind FROM log WHERE session_id IN ('s3', 's5', 's8')")
def keyed_history_scan(spark, d):
    return projection.history(over_tables(spark, d).events, ["s3", "s5", "s8"]).select("append_pos", "session_id", "kind")


@query("SELECT _file_, count(*)::BIGINT AS n FROM steps WHERE _file_ IN ('part-1', 'part-3') AND _file_ LIKE 'part-%' GROUP BY _file_")
def file_pruned_scan(spark, d):
    return over_tables(spark, d).steps.where("_file_ IN ('part-1', 'part-3') AND _file_ LIKE 'part-%'").groupBy("_file_").agg(F.count("*").alias("n"))


@query("SELECT append_pos, event_id, substr(payload_json, 1, 30) AS preview FROM log WHERE session_id = 's3'")
def content_preview(spark, d):
    return over_tables(spark, d).events.where("session_id = 's3'").select("append_pos", "event_id", F.substring("payload_json", 1, 30).alias("preview"))


# -- joins ------------------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name, count(*)::BIGINT AS orders FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey, n_name", relations=False)
def inner_join(spark, d):
    # orders are counted per customer before they meet anything
    counted = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return counted.join(_t(spark, d, "customer"), "c_custkey").join(F.broadcast(_t(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name", "orders")


@query("SELECT r._file_, r.document_id, count(s.step_id)::BIGINT AS steps FROM runs r LEFT JOIN steps s ON s._file_ = r._file_ AND s.document_id = r.document_id AND s.source = 'system' GROUP BY 1, 2")
def left_join(spark, d):
    r = over_tables(spark, d)
    return r.runs.join(r.steps.where("source = 'system'").groupBy(analysis.DOCUMENT).agg(F.count("*").alias("steps")), analysis.DOCUMENT, "left").select(*analysis.DOCUMENT, F.coalesce("steps", F.lit(0)).alias("steps"))


@query("SELECT s.document_id, count(*)::BIGINT AS pairs FROM steps s JOIN calls t ON s.document_id = t.document_id WHERE s.source = 'agent' GROUP BY 1")
def cross_dataset_join(spark, d):
    r = over_tables(spark, d)
    calls = r.tool_calls.groupBy("document_id").agg(F.count("*").alias("t"))
    return r.steps.where("source = 'agent'").groupBy("document_id").agg(F.count("*").alias("s")).join(calls, "document_id").select("document_id", (F.col("s") * F.col("t")).alias("pairs"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", relations=False)
def semi_join(spark, d):
    big = _t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("WITH a AS (SELECT DISTINCT user_id, event_id % 50 AS k FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, event_id % 50 AS k FROM events WHERE event_type = 'view') "
       "SELECT user_id, k, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, k, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)", relations=False)
def anti_reconcile(spark, d):
    keys = lambda kind: _t(spark, d, "events").where(F.col("event_type") == kind).select("user_id", (F.col("event_id") % 50).alias("k")).distinct()
    return projection.reconcile(keys("click"), keys("view"), ["user_id", "k"])


@query("SELECT document_id, (SELECT count(*) FROM steps s WHERE s._file_ = r._file_ AND s.document_id = r.document_id)::BIGINT AS steps, (SELECT count(*) FROM runs)::BIGINT AS runs FROM runs r")
def scalar_subquery_counts(spark, d):
    r = over_tables(spark, d)
    steps = r.steps.groupBy(analysis.DOCUMENT).agg(F.count("*").alias("steps"))
    return r.runs.join(steps, analysis.DOCUMENT, "left").join(r.runs.agg(F.count("*").alias("runs"))).select("document_id", F.coalesce("steps", F.lit(0)).alias("steps"), "runs")


@query("""WITH t AS (SELECT session_id, append_pos AS turn, call_id, CASE WHEN append_pos % 3 = 0 THEN seq END AS own FROM log WHERE kind = 'llm.request')
    SELECT t.session_id, turn, own AS seq FROM t WHERE own IS NOT NULL UNION ALL SELECT t.session_id, turn, e.seq FROM t JOIN log e ON t.session_id = e.session_id AND t.call_id = e.call_id WHERE own IS NULL""")
def turn_event_link(spark, d):
    e = over_tables(spark, d).events
    extra = F.to_json(F.struct("call_id", F.when(F.col("append_pos") % 3 == 0, F.col("seq")).alias("event_seq")))
    turns = e.where("kind = 'llm.request'").select("_file_", "session_id", F.col("append_pos").alias("step_id"), extra.alias("extra_json"))
    return documents.linked_events(turns, e).select("session_id", F.col("step_id").alias("turn"), "seq")


# -- analyses -----------------------------------------------------------------------------------------


@query("""SELECT (SELECT count(*) FROM runs)::BIGINT AS trajectories, (SELECT count(DISTINCT agent_id) FROM runs)::BIGINT AS agents, (SELECT count(*) FROM steps)::BIGINT AS steps,
    (SELECT count(*) FROM steps WHERE source = 'user')::BIGINT AS user_steps, (SELECT count(*) FROM steps WHERE source = 'agent')::BIGINT AS agent_steps, (SELECT count(*) FROM calls)::BIGINT AS tool_calls,
    (SELECT count(DISTINCT m) FROM (SELECT agent_model_name AS m FROM runs UNION SELECT model_name FROM steps))::BIGINT AS models""")
def analysis_overview(spark, d):
    return analysis.overview(over_tables(spark, d))


@query("""WITH s AS (SELECT _file_, document_id, count(*) AS n, count(*) FILTER (source = 'user') AS u, count(*) FILTER (source = 'agent') AS a FROM steps GROUP BY ALL),
    t AS (SELECT _file_, document_id, count(*) AS n FROM calls GROUP BY ALL)
    SELECT agent_id, coalesce(agent_name, '') AS agent_name, coalesce(agent_version, '') AS agent_version, count(*)::BIGINT AS trajectories, count(DISTINCT r._file_)::BIGINT AS sources, coalesce(sum(s.n), 0)::BIGINT AS steps,
           coalesce(sum(u), 0)::BIGINT AS user_steps, coalesce(sum(a), 0)::BIGINT AS agent_steps, coalesce(sum(t.n), 0)::BIGINT AS tool_calls
    FROM runs r LEFT JOIN s USING (_file_, document_id) LEFT JOIN t USING (_file_, document_id) GROUP BY agent_id, agent_name, agent_version""")
def analysis_agents(spark, d):
    return analysis.agents(over_tables(spark, d))


@query("""WITH m AS (SELECT agent_model_name AS model, 1 AS d, 0 AS o FROM runs UNION ALL SELECT model_name, 0, 1 FROM steps)
    SELECT model, sum(d)::BIGINT AS declared_trajectories, sum(o)::BIGINT AS observed_steps FROM m WHERE model <> '' GROUP BY model""")
def analysis_models(spark, d):
    return analysis.models(over_tables(spark, d))


@query("""SELECT function_name, count(*)::BIGINT AS calls, count(DISTINCT (_file_, document_id))::BIGINT AS trajectories, count(DISTINCT _file_)::BIGINT AS sources, count(duration_ms)::BIGINT AS duration_samples,
    coalesce(sum(duration_ms), 0)::BIGINT AS total_duration_ms FROM calls GROUP BY function_name""")
def analysis_tools(spark, d):
    return analysis.tools(over_tables(spark, d))


_EVENT_STATS = """WITH v AS (SELECT _file_, session_id, count(*)::BIGINT AS row_count, (count(event_id) - count(DISTINCT event_id))::BIGINT AS duplicates,
    max(CASE WHEN kind = 'run.failed' OR kind = 'run.cancelled' THEN 3 WHEN kind = 'run.completed' THEN 2 WHEN kind = 'session.ended' THEN 1 ELSE 0 END)::INT AS terminal_rank,
    max(CASE WHEN kind = 'session.ended' THEN payload_json END) AS ended_payload, count(*) FILTER (kind = 'llm.request')::BIGINT AS requests,
    count(*) FILTER (kind = 'llm.response' OR kind = 'llm.response.stream')::BIGINT AS responses FROM log GROUP BY ALL)"""
#: Only a whole number under payload.exit_code fails a run; without calls there is no status.
_STATUS = """CASE terminal_rank WHEN 3 THEN 'failed' WHEN 2 THEN 'completed'
    WHEN 1 THEN CASE WHEN json_type(ended_payload, '$.payload.exit_code') IN ('UBIGINT', 'BIGINT') AND (ended_payload ->> '$.payload.exit_code')::BIGINT <> 0 THEN 'failed' ELSE 'completed' END
    ELSE CASE WHEN requests = 0 AND responses = 0 THEN NULL WHEN responses >= requests THEN 'completed' ELSE 'active' END END"""


@query(_EVENT_STATS + " SELECT * FROM v")
def event_stats(spark, d):
    return analysis.event_stats(over_tables(spark, d).events)


@query(_EVENT_STATS + f" SELECT _file_, session_id, row_count, duplicates, {_STATUS} AS status FROM v")
def terminal_status(spark, d):
    return analysis.terminal_status(analysis.event_stats(over_tables(spark, d).events))


@query(_EVENT_STATS + f""", w AS (SELECT _file_, session_id, row_count, duplicates, coalesce({_STATUS}, 'active') AS status FROM v), n AS (SELECT _file_, document_id, count(*) AS steps FROM steps GROUP BY ALL)
    SELECT _file_ || '/' || document_id AS path, agent_id, coalesce(row_count, steps, 0)::BIGINT AS row_count, coalesce(duplicates, 0)::BIGINT AS duplicates, coalesce(status, 'active') AS status
    FROM runs LEFT JOIN n USING (_file_, document_id) LEFT JOIN w USING (_file_, session_id)""")
def run_summaries(spark, d):
    return analysis.run_summaries(over_tables(spark, d))


@query("SELECT _file_, count(*)::BIGINT AS n, 'runs' AS relation FROM runs GROUP BY 1 UNION ALL SELECT _file_, count(*), 'steps' FROM steps GROUP BY 1 UNION ALL SELECT _file_, count(*), 'tool_calls' FROM calls GROUP BY 1 UNION ALL SELECT _file_, count(*), 'events' FROM log GROUP BY 1")
def status_counts(spark, d):
    return analysis.status_counts(over_tables(spark, d))


@query("""WITH s AS (SELECT _file_, document_id, count(*)::BIGINT AS step_count, list(step_id ORDER BY step_id) AS step_ids, list(source ORDER BY step_id) AS step_sources, list(message_json ORDER BY step_id) AS messages_json
        FROM steps GROUP BY ALL),
    t AS (SELECT _file_, document_id, count(*)::BIGINT AS tool_call_count, list(function_name ORDER BY step_id, call_index) AS tool_names, list(arguments_json ORDER BY step_id, call_index) AS tool_arguments_json,
        list(results_json ORDER BY step_id, call_index) AS tool_results_json FROM calls GROUP BY ALL)
    SELECT r.*, coalesce(step_count, 0) AS step_count, step_ids, step_sources, messages_json, coalesce(tool_call_count, 0) AS tool_call_count, tool_names, tool_arguments_json, tool_results_json
    FROM runs r LEFT JOIN s USING (_file_, document_id) LEFT JOIN t USING (_file_, document_id)""")
def trajectories_view(spark, d):
    return analysis.trajectories(over_tables(spark, d))


@query("""SELECT source, count(*)::BIGINT AS total_count, count(latency_ms)::BIGINT AS sample_count, (list(latency_ms ORDER BY latency_ms) FILTER (latency_ms IS NOT NULL))[ceil((count(latency_ms) - 1) * 0.5)::INT + 1] AS p50,
    (list(latency_ms ORDER BY latency_ms) FILTER (latency_ms IS NOT NULL))[ceil((count(latency_ms) - 1) * 0.95)::INT + 1] AS p95, max(latency_ms) AS max_value FROM steps GROUP BY source""")
def percentile_stats(spark, d):
    return analysis.percentiles(over_tables(spark, d).steps, "source", "latency_ms")


@query("""WITH b AS (SELECT CASE WHEN latency_ms < 100 THEN 0 WHEN latency_ms < 500 THEN 1 WHEN latency_ms < 1000 THEN 2 WHEN latency_ms < 3000 THEN 3 WHEN latency_ms < 10000 THEN 4 ELSE 5 END AS bucket FROM steps WHERE latency_ms >= 0),
    n(bucket, name) AS (VALUES (0, '<100'), (1, '100-500'), (2, '500-1000'), (3, '1000-3000'), (4, '3000-10000'), (5, '>=10000'))
    SELECT n.bucket, name, count(b.bucket)::BIGINT AS n FROM n LEFT JOIN b USING (bucket) GROUP BY 1, 2""")
def latency_histogram(spark, d):
    return analysis.latency_histogram(over_tables(spark, d).steps)


@query("""WITH x AS (SELECT 'source' AS dimension, coalesce(source, 'unavailable') AS name, latency_ms FROM steps UNION ALL SELECT 'model_name', coalesce(model_name, 'unavailable'), latency_ms FROM steps)
    SELECT dimension, name, count(*)::BIGINT AS turns, count(latency_ms)::BIGINT AS latency_samples, round(avg(latency_ms), 4) AS mean_latency FROM x GROUP BY 1, 2""")
def dimension_breakdown(spark, d):
    return analysis.dimension_breakdown(over_tables(spark, d).steps)


@query("SELECT kind, count(*)::BIGINT AS n FROM log WHERE session_id = 's3' GROUP BY kind")
def kind_counts(spark, d):
    return over_tables(spark, d).events.where("session_id = 's3'").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT session_id FROM log WHERE _file_ = 'part-2'")
def distinct_sessions(spark, d):
    return over_tables(spark, d).events.where("_file_ = 'part-2'").select("session_id").distinct().orderBy("session_id")


@query("""SELECT user_id, sum(k)::BIGINT AS prompt_tokens, sum(greatest(k - 10, 0))::BIGINT AS completion_tokens, sum(k + greatest(k - 10, 0))::BIGINT AS total_tokens
    FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY user_id""", relations=False)
def token_rollup(spark, d):
    usage = F.concat(F.lit('{"prompt_tokens": '), F.get_json_object("props", "$.k"), F.lit(', "completion_tokens": '), (F.get_json_object("props", "$.k").cast("long") - 10).cast("string"), F.lit("}"))
    counts = scalars.token_counts(usage)
    return _t(spark, d, "events").select("user_id", counts.alias("t")).groupBy("user_id").agg(F.sum("t.prompt").alias("prompt_tokens"), F.sum("t.completion").alias("completion_tokens"), F.sum("t.total").alias("total_tokens"))


# -- set operations, sorting, windows -----------------------------------------------------------------


@query("SELECT 'run' AS what, document_id FROM runs UNION ALL SELECT 'step', document_id FROM steps")
def union_all(spark, d):
    r = over_tables(spark, d)
    return r.runs.select(F.lit("run").alias("what"), "document_id").unionAll(r.steps.select(F.lit("step"), "document_id"))


@query("SELECT agent_model_name AS model FROM runs UNION SELECT model_name FROM steps")
def union_distinct(spark, d):
    r = over_tables(spark, d)
    return r.runs.select(F.col("agent_model_name").alias("model")).union(r.steps.select("model_name")).distinct()


@query("SELECT document_id FROM runs INTERSECT SELECT document_id FROM calls")
def intersect(spark, d):
    r = over_tables(spark, d)
    return r.runs.select("document_id").intersect(r.tool_calls.select("document_id"))


@query("SELECT user_id, event_id % 20 AS k FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, event_id % 20 FROM events WHERE event_type = 'error'", relations=False)
def except_distinct(spark, d):
    rows = lambda t: _t(spark, d, "events").where(F.col("event_type") == t).select("user_id", (F.col("event_id") % 20).alias("k"))
    return rows("view").subtract(rows("error"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100", relations=False)
def topk_list(spark, d):
    return _t(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@query("SELECT document_id, avg(latency_ms) AS mean FROM steps GROUP BY document_id ORDER BY mean DESC NULLS LAST, document_id LIMIT 50")
def nulls_last_topk(spark, d):
    return over_tables(spark, d).steps.groupBy("document_id").agg(F.avg("latency_ms").alias("mean")).orderBy(F.desc_nulls_last("mean"), "document_id").limit(50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50", relations=False)
def pagination(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("SELECT append_pos, kind FROM log WHERE session_id = 's4' ORDER BY append_pos LIMIT 20 OFFSET 10")
def replay_page(spark, d):
    return projection.page(over_tables(spark, d).events.where("session_id = 's4'"), 10, 20).select("append_pos", "kind")


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", relations=False)
def rollup(spark, d):
    return _t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", relations=False)
def cube(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 10 AS g, count(*)::BIGINT AS n FROM events GROUP BY GROUPING SETS ((event_type), (g), ())", relations=False)
def grouping_sets(spark, d):
    _t(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("g")).createOrReplaceTempView("grouped_events")
    return spark.sql("SELECT event_type, g, count(*) AS n FROM grouped_events GROUP BY GROUPING SETS ((event_type), (g), ())")


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)", relations=False)
def window_rank(spark, d):
    w = Window.partitionBy("o_custkey")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w.orderBy("o_orderdate")).cast("long").alias("r"), F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("n"))


@query("SELECT user_id, event_id, count(*) OVER w AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", relations=False)
def window_frame(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select("user_id", "event_id", F.count("*").over(w.rowsBetween(-3, 0)).alias("n"), F.lag("event_type").over(w).alias("before"))


# -- projection, search, tables, queue -----------------------------------------------------------------


_ASKS = "kind IN ('llm.request', 'http.request')"
_ANSWERS = "kind IN ('llm.response', 'llm.response.stream', 'http.response', 'http.response.stream')"
_FOLD = f"""WITH p AS (SELECT session_id, call_id, min(append_pos) AS first_pos, min(append_pos) FILTER ({_ASKS}) AS request_pos, max(append_pos) FILTER ({_ANSWERS}) AS response_pos,
    arg_max(payload_json, append_pos) FILTER ({_ANSWERS}) AS answer, min(timestamp) FILTER ({_ASKS}) AS t0, max(timestamp) FILTER ({_ANSWERS}) AS t1 FROM log GROUP BY ALL)"""


@query(_FOLD + """ SELECT session_id, call_id, row_number() OVER (PARTITION BY session_id ORDER BY first_pos)::BIGINT AS turn, answer, date_diff('millisecond', t0, t1)::BIGINT AS latency_ms
    FROM p WHERE request_pos IS NOT NULL AND response_pos IS NOT NULL""")
def event_fold(spark, d):
    return projection.fold(over_tables(spark, d).events)


@query(_FOLD + """ SELECT session_id, call_id, row_number() OVER (PARTITION BY session_id ORDER BY first_pos)::BIGINT AS turn, answer, date_diff('millisecond', t0, t1)::BIGINT AS latency_ms
    FROM p WHERE request_pos IS NOT NULL AND response_pos IS NOT NULL""")
def incremental_projection(spark, d):
    events = over_tables(spark, d).events
    cut = events.agg(F.max("append_pos")).first()[0] // 2
    before = projection.fold(events.where(F.col("append_pos") < cut))
    return projection.sync(before, events, cut)


_PAIRS = """WITH k AS (SELECT *, coalesce(call_id, 'seq-' || seq) AS call, kind LIKE '%request%' AS asks, kind NOT LIKE '%request%' AND kind LIKE '%response%' AS answers,
        json_extract(payload_json, '$.payload')::VARCHAR AS payload FROM log),
    c AS (SELECT session_id, call, arg_max(timestamp, append_pos) FILTER (asks) AS started, arg_max(trace_id, append_pos) FILTER (asks) AS trace_id, arg_max(payload, append_pos) FILTER (asks) AS request,
        arg_max(payload, append_pos) FILTER (answers) AS response FROM k GROUP BY ALL HAVING count(*) FILTER (asks) > 0)"""


@query(_PAIRS + " SELECT session_id, call AS call_id, request, response FROM c")
def har_pairs(spark, d):
    return projection.call_pairs(over_tables(spark, d).events).select("session_id", "call_id", F.col("request.payload").alias("request"), F.col("response.payload").alias("response"))


@query(_PAIRS + """ SELECT session_id, call AS call_id, epoch_us(started) AS started_us, coalesce((response ->> '$.duration_ms')::DOUBLE, 0) AS time, request ->> '$.method' AS method, request ->> '$.path' AS url, '' AS version,
        'n=<redacted>,x-k=a' AS request_headers, json_extract(request, '$.body')::VARCHAR AS request_body, coalesce((response ->> '$.status')::BIGINT, 0) AS status,
        CASE WHEN response IS NULL THEN '' ELSE 'n=<redacted>,x-k=a' END AS response_headers, coalesce(json_extract(response, '$.body')::VARCHAR, '') AS response_body, trace_id, false AS degraded FROM c""")
def har_entries(spark, d):
    rows = exchange.har_entries(over_tables(spark, d).events)
    shown = lambda c: F.array_join(F.transform(c, lambda h: F.concat(h["name"], F.lit("="), h["value"])), ",").alias(c)
    return rows.select(
        "session_id", "call_id", F.unix_micros("started").alias("started_us"), "time", "method", "url", "version", shown("request_headers"), "request_body", "status", shown("response_headers"), "response_body", "trace_id", "degraded"
    )


#: Calls as the whole fold sees them: the last request, the last response's text, the first latency that is told.
_DOCUMENTS = f"""WITH e AS (SELECT *, payload_json -> '$.payload' AS p, {_ASKS} AS asks, {_ANSWERS} AS answers FROM log),
    c AS (SELECT _file_, session_id, call_id, min(append_pos) AS first_pos, count(*) FILTER (asks) AS n_asks, max(append_pos) FILTER (asks) AS asked_at, max(append_pos) FILTER (answers) AS answered_at,
        min(append_pos) FILTER (answers AND (p ->> '$.latency_ms') IS NOT NULL) AS told_at, max(append_pos) FILTER (answers AND (p -> '$.usage') IS NOT NULL) AS usage_at, arg_min(timestamp, append_pos) AS first_t,
        arg_min(seq, append_pos) FILTER (asks) AS q_seq, arg_min(seq, append_pos) FILTER (answers) AS a_seq FROM e WHERE call_id IS NOT NULL GROUP BY ALL),
    j AS (SELECT c.*, q.p ->> '$.user_content' AS said, q.p ->> '$.model' AS model, q.timestamp AS q_t, a.p ->> '$.content' AS answer, a.timestamp AS a_t, (l.p ->> '$.latency_ms')::BIGINT AS told, u.p -> '$.usage' AS usage,
            (u.p ->> '$.usage.ttft_ms')::BIGINT AS ttft
        FROM c LEFT JOIN e q ON q.append_pos = asked_at LEFT JOIN e a ON a.append_pos = answered_at LEFT JOIN e l ON l.append_pos = told_at LEFT JOIN e u ON u.append_pos = usage_at),
    t AS (SELECT _file_, session_id, call_id, false AS own, first_pos, 0 AS place, 'llm.request' AS kind, 'user' AS source, said AS message, coalesce(q_t, first_t) AS happened, q_seq AS seq, NULL AS model, NULL::BIGINT AS latency, NULL::BIGINT AS ttft
        FROM j WHERE said IS NOT NULL AND answer IS NOT NULL
        UNION ALL SELECT _file_, session_id, call_id, false, first_pos, 1, CASE WHEN answer IS NULL AND said IS NOT NULL THEN 'llm.request' ELSE 'llm.response' END, CASE WHEN answer IS NULL AND said IS NOT NULL THEN 'user' ELSE 'agent' END,
            coalesce(answer, said, ''), coalesce(a_t, q_t, first_t), CASE WHEN answer IS NOT NULL THEN a_seq WHEN said IS NOT NULL THEN q_seq ELSE coalesce(a_seq, q_seq) END, model,
            CASE WHEN answer IS NOT NULL OR said IS NULL THEN coalesce(told, epoch_us(a_t) // 1000 - epoch_us(q_t) // 1000) END, CASE WHEN answer IS NOT NULL OR said IS NULL THEN ttft END FROM j
        UNION ALL SELECT _file_, session_id, NULL, true, append_pos, 0, 'internal', 'system', '{{"kind":"' || kind || '","payload":' || p::VARCHAR || '}}', timestamp, seq, NULL, NULL, NULL FROM e
            WHERE call_id IS NULL AND (kind LIKE 'session.%' OR kind = 'note')),
    s AS (SELECT *, row_number() OVER (PARTITION BY _file_, session_id ORDER BY own, first_pos, place)::BIGINT AS step_id FROM t)"""


@query(_DOCUMENTS + " SELECT _file_, session_id, step_id, kind, source, CASE WHEN own THEN message ELSE to_json(message)::VARCHAR END AS message_json, epoch_us(happened) AS at_us, model AS model_name, latency AS latency_ms, ttft AS ttft_ms FROM s")
def document_steps(spark, d):
    steps = documents.fold_events(over_tables(spark, d).events).steps
    return steps.select("_file_", "session_id", "step_id", "kind", "source", "message_json", F.unix_micros("timestamp").alias("at_us"), "model_name", "latency_ms", "ttft_ms")


@query(_DOCUMENTS + """, r AS (SELECT session_id, p ->> '$.llm_request.request.messages[0].parts[0].call_id' AS id, arg_max(p -> '$.llm_request.request.messages[0].parts[0].content', append_pos) AS result FROM e
        WHERE (p -> '$.llm_request') IS NOT NULL GROUP BY ALL),
    f AS (SELECT session_id, call_id, p ->> '$.llm_response.response.candidates[0].message.parts[0].id' AS id, min(append_pos) AS first_pos, arg_max(p -> '$.llm_response.response.candidates[0].message.parts[0]', append_pos) AS part FROM e
        WHERE call_id IS NOT NULL AND (p -> '$.llm_response') IS NOT NULL GROUP BY ALL)
    SELECT f.session_id, s.step_id, row_number() OVER (PARTITION BY f.session_id, f.call_id ORDER BY f.first_pos)::BIGINT - 1 AS call_index, f.id AS tool_call_id, part ->> '$.name' AS function_name,
        (part -> '$.arguments')::VARCHAR AS arguments_json, r.result::VARCHAR AS result_json
    FROM f JOIN s ON s.session_id = f.session_id AND s.call_id = f.call_id AND s.place = 1 LEFT JOIN r ON r.session_id = f.session_id AND r.id = f.id""")
def document_calls(spark, d):
    calls = documents.fold_events(over_tables(spark, d).events).tool_calls
    return calls.select("session_id", "step_id", "call_index", "tool_call_id", "function_name", "arguments_json", "result_json")


@query(_DOCUMENTS + """, l AS (SELECT session_id, arg_max(model, step_id) FILTER (model IS NOT NULL) AS agent_model_name FROM s GROUP BY ALL)
    SELECT _file_, e.session_id AS document_id, arg_max(agent_id, append_pos) AS agent_id, any_value(agent_model_name) AS agent_model_name FROM e LEFT JOIN l USING (session_id) GROUP BY _file_, e.session_id""")
def document_runs(spark, d):
    return documents.fold_events(over_tables(spark, d).events).runs.select("_file_", "document_id", "agent_id", "agent_model_name")


@query(_DOCUMENTS + """ SELECT session_id, step_id, seq FROM s WHERE seq IS NOT NULL
    UNION ALL SELECT s.session_id, s.step_id, e.seq FROM s JOIN e ON s.session_id = e.session_id AND s.call_id = e.call_id WHERE s.seq IS NULL""")
def document_links(spark, d):
    events = over_tables(spark, d).events
    return documents.linked_events(documents.fold_events(events).steps, events).select("session_id", "step_id", "seq")


def _knn(metric: str, distance: str):
    def run(spark, d):
        vectors = _t(spark, d, "embeddings")
        first = vectors.where("vec_id = 0").select("embedding").first()[0]
        return search.knn(vectors, first, 10, metric).select("vec_id", F.round("_distance", 5).alias("d"))

    run.__name__ = f"vector_knn_{metric}"
    query(f"""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
        SELECT vec_id, round({distance}, 5) + 0.0 AS d FROM v, q ORDER BY {distance}, vec_id LIMIT 10""", relations=False)(run)


_knn("l2", "list_distance(e, q) ** 2")
_knn("cosine", "list_cosine_distance(e, q)")
_knn("dot", "1 - list_inner_product(e, q)")


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 1), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT vec_id, round(list_distance(e, q) ** 2, 5) + 0.0 AS d FROM v, q ORDER BY list_distance(e, q), vec_id LIMIT 10""", relations=False)
def ivf_search(spark, d):
    vectors = _t(spark, d, "embeddings")
    first = vectors.where("vec_id = 1").select("embedding").first()[0]
    index = ivf.Index.over(vectors, len(first))
    return index.search(first, 10, nprobes=len(index.centroids)).select("vec_id", F.round("_distance", 5).alias("d"))


@query()
def ivf_recall(spark, d):
    """Share of the ten nearest that a search finds, by the clusters it reads."""
    vectors = _t(spark, d, "embeddings")
    asked = [r[0] for r in vectors.where("vec_id < 5").select("embedding").collect()]  # five rows
    index = ivf.Index.over(vectors, len(asked[0]))
    rows = []
    for probes in (1, 4, 16, len(index.centroids)):
        found = [(index.search(q, 10, probes).select("vec_id"), search.knn(vectors, q, 10).select("vec_id")) for q in asked]
        rows.append((probes, sum(a.join(b, "vec_id").count() for a, b in found) / (10 * len(asked))))
    return spark.createDataFrame(rows, "nprobes int, recall double")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'que')) AS b FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
    SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
    FROM c, s WHERE a + b > 0""", relations=False)
def fts_bm25(spark, d):
    return search.bm25(_t(spark, d, "documents"), ["the", "que"]).select("doc_id", F.round("score", 6).alias("score"))


@query(r"""WITH h AS (SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['que', 'los'])),
    q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: x::DOUBLE), q) ** 2, 5) AS d FROM embeddings JOIN h ON doc_id = vec_id, q ORDER BY 2, 1 LIMIT 10""", relations=False)
def hybrid_search(spark, d):
    vectors = _t(spark, d, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()[0]
    return search.hybrid(_t(spark, d, "documents"), vectors, ["que", "los"], first, 10).select("vec_id", F.round("_distance", 5).alias("d"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')", relations=False)
def value_partition_filter(spark, d):
    orders = _t(spark, d, "orders")
    kept = tables.matching_partitions(orders.select("o_orderstatus").distinct(), "o_orderstatus", "o_orderstatus = 'F' OR o_orderstatus IN ('P')")
    return orders.join(kept, "o_orderstatus", "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey % 8 AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1", relations=False)
def hash_partition_count(spark, d):
    return _t(spark, d, "orders").groupBy(tables.stable_bucket("o_custkey", "bigint", 8).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice, o_orderkey LIMIT 200)", relations=False)
def partitioned_order_limit(spark, d):
    return tables.ordered_concat(_t(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus", "o_totalprice", 200)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 100000000, 'X' FROM orders WHERE o_orderkey % 300 = 0", relations=False)
def upsert(spark, d):
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    changed = rows.where("o_orderkey % 3 = 0").select("o_orderkey").unionAll(rows.where("o_orderkey % 300 = 0").select(F.col("o_orderkey") + 100000000)).withColumn("o_orderstatus", F.lit("X"))
    return tables.upsert(rows, changed, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders", relations=False)
def update(spark, d):
    return tables.update(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 300000, o_totalprice=F.lit(0.0))


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice < 100000, false)", relations=False)
def delete(spark, d):
    return tables.delete(_t(spark, d, "orders"), F.expr("o_orderstatus = 'F' AND o_totalprice < 100000")).select("o_orderkey")


@query("SELECT p_partkey, p_size * 2 AS twice, upper(p_brand) AS brand FROM part", relations=False)
def add_columns(spark, d):
    return tables.add_columns(_t(spark, d, "part").select("p_partkey", "p_size", "p_brand"), twice="p_size * 2", brand="upper(p_brand)").drop("p_size", "p_brand")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY o_orderkey LIMIT 100", relations=False)
def queue_ready(spark, d):
    orders = _t(spark, d, "orders")
    consumed = orders.where("o_orderstatus = 'F'").select(F.lit("train").alias("task"), F.col("o_orderkey").alias("idx"))
    return queueing.sequential(queueing.ready(orders.select(F.col("o_orderkey").alias("idx")), consumed, "train"), 100).select(F.col("idx").alias("o_orderkey"))


@query("""WITH r AS (SELECT DISTINCT event_id AS idx FROM events WHERE event_type <> 'error'), i AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS k FROM r),
    g AS (SELECT idx, min(idx) OVER (PARTITION BY k) AS island, count(*) OVER (PARTITION BY k) AS n FROM i)
    SELECT idx, ((idx - island) // 4)::BIGINT AS "group", island FROM g WHERE idx - island < n // 4 * 4""", relations=False)
def sampler_groups(spark, d):
    return queueing.runs_of(_t(spark, d, "events").where("event_type <> 'error'").select(F.col("event_id").alias("idx")).distinct(), 4)


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('view', 'error'))", relations=False)
def resume_antijoin(spark, d):
    e = _t(spark, d, "events").select("event_id", "event_type")
    return projection.remaining(e, e.where("event_type = 'view'"), e.where("event_type = 'error'"), "event_id").select("event_id")


# -- scalar functions ------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CASE WHEN length(t) > 180 THEN left(t, 179) || '…' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents)", relations=False)
def compact_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", scalars.compact(F.col("text"), 180).alias("short"))


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'que')) AS b FROM d),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
    r AS (SELECT doc_id, ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, s WHERE a + b > 0)
    SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 25""", relations=False)
def fts_topk(spark, d):
    return search.bm25(_t(spark, d, "documents"), ["the", "que"], k=25).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT event_id, 'v' || event_type AS found FROM events", relations=False)
def find_string(spark, d):
    text = F.concat(F.lit('[{"a":{"k":'), F.col("event_id").cast("string"), F.lit('}},{"b":[{"k":"v'), F.col("event_type"), F.lit('"}]}]'))
    return _t(spark, d, "events").select("event_id", scalars.find_string(text, F.lit("k")).alias("found"))


@query("SELECT event_id, event_id % 4 < 3 AS failed FROM events", relations=False)
def error_predicate(spark, d):
    shown = F.array(*(F.lit(x) for x in ('{"a":[{"status":"FAILED"}]}', '{"x":{"status_code":404}}', '{"error_type":"E"}', '{"status":"ok","status_code":200,"error_type":""}')))
    return _t(spark, d, "events").select("event_id", scalars.is_error(F.element_at(shown, (F.col("event_id") % 4 + 1).cast("int"))).alias("failed"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN 7.5 END AS latency FROM events", relations=False)
def latency_resolution(spark, d):
    at = F.col("event_id") % 4
    own = F.when(at == 0, F.col("value"))
    metrics = F.when(at == 1, F.concat(F.lit('{"llm_infer_ms":3,"total_latency_ms":'), F.col("event_id").cast("string"), F.lit("}"))).when(at == 2, '{"upstream_latency_ms":"7.5"}').otherwise('{"latency_ms":-1}')
    return _t(spark, d, "events").select("event_id", scalars.latency(own, metrics).alias("latency"))


@query("""WITH x AS (SELECT conv_id, turn, text FROM conversations WHERE text <> '') SELECT conv_id, turn, 2.0 * 3 / (3 + 3 + turn % 4)::DOUBLE AS ratio FROM x""", relations=False)
def partial_similarity(spark, d):
    more = F.substring(F.lit("xyz"), F.lit(1), (F.col("turn") % 4).cast("int"))
    return _t(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", scalars.similarity(F.lit(" a  b "), F.concat(F.lit("a b"), more)).alias("ratio"))


@query("WITH RECURSIVE n(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM n WHERE i < 9), k AS (SELECT o_custkey % 10 AS i, count(*) AS n FROM orders GROUP BY 1) SELECT n.i, k.n::BIGINT AS n FROM n JOIN k ON n.i = k.i", relations=False)
def with_query(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("with_query_orders")
    return spark.sql("WITH n AS (SELECT explode(sequence(0, 9)) AS i), k AS (SELECT o_custkey % 10 AS i, count(*) AS n FROM with_query_orders GROUP BY 1) SELECT n.i, k.n FROM n JOIN k ON n.i = k.i")


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS number FROM events", relations=False)
def find_number(spark, d):
    return _t(spark, d, "events").select("event_id", scalars.find_number(F.concat(F.lit('{"a": [{"b": '), F.col("props"), F.lit("}]}")), F.lit("k")).alias("number"))


@query()
def embed_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", scalars.embed_text(F.col("text"), 64).alias("embedding"))


@query()
def text_similarity(spark, d):
    return _t(spark, d, "benchmark").select("item_id", scalars.similarity(F.col("text"), F.concat(F.col("text"), F.lit(" more"))).alias("ratio"))


_MODELS = "['GPT-4o-x', 'gpt-4o-mini', 'claude-3-5-sonnet-1', 'deepseek-chat', 'gemini-2.0-flash', 'gpt-4', 'own']"
_PROVIDERS = "['openai', 'Anthropic', 'gemini', 'vertex', 'other']"


@query(f"""WITH u AS (SELECT event_id, {_MODELS}[event_id % 7 + 1] AS model, {_PROVIDERS}[event_id % 5 + 1] AS provider, value * 1000 AS p, value * 100 AS c FROM events),
    t AS (SELECT *, CASE WHEN model IN ('GPT-4o-x', 'gpt-4o-mini') THEN 2.5 WHEN model LIKE 'claude-3-5-sonnet%' THEN 3.0 WHEN model = 'deepseek-chat' THEN 0.27 WHEN model = 'gemini-2.0-flash' THEN 0.1
                             WHEN provider = 'Anthropic' THEN 3.0 WHEN provider IN ('gemini', 'vertex') THEN 0.15 ELSE 1.0 END::DOUBLE AS a,
                    CASE WHEN model IN ('GPT-4o-x', 'gpt-4o-mini') THEN 10.0 WHEN model LIKE 'claude-3-5-sonnet%' THEN 15.0 WHEN model = 'deepseek-chat' THEN 1.1 WHEN model = 'gemini-2.0-flash' THEN 0.4
                             WHEN provider = 'Anthropic' THEN 15.0 WHEN provider IN ('gemini', 'vertex') THEN 0.6 ELSE 2.0 END::DOUBLE AS b FROM u)
    SELECT event_id, model, provider, round(p / 1e6 * a + c / 1e6 * b, 9) AS cost FROM t""", relations=False)
def usage_cost(spark, d):
    pick = lambda names, n: F.element_at(F.expr(names.replace("[", "array(").replace("]", ")")), (F.col("event_id") % n + 1).cast("int"))
    e = _t(spark, d, "events").select("event_id", "value", pick(_MODELS, 7).alias("model"), pick(_PROVIDERS, 5).alias("provider"))
    return e.select("event_id", "model", "provider", F.round(scalars.cost(F.col("model"), F.col("value") * 1000, F.col("value") * 100, F.col("provider")), 9).alias("cost"))


_USAGE = (
    '{"usage":{"prompt_tokens":#,"completion_tokens":7,"total_tokens":99,"prompt_tokens_details":{"cached_tokens":3,"cache_write_tokens":4},"completion_tokens_details":{"reasoning_tokens":5}}}',
    '{"Usage":{"input_tokens":#,"output_tokens":8,"cache_creation_input_tokens":6,"cache_read_input_tokens":2}}',
    '{"usageMetadata":{"promptTokenCount":#,"candidatesTokenCount":1,"totalTokenCount":0,"cachedContentTokenCount":9,"thoughtsTokenCount":4}}',
    '{"usage":{"prompt_tokens":"#","output_tokens":-1},"message":{"usage":{"input_tokens":11}}}', "no json #",
)


@query("""SELECT event_id, CASE event_id % 5 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE event_id END::BIGINT AS input_tokens, [7, 8, 1, 0, 0][event_id % 5 + 1]::BIGINT AS output_tokens,
    CASE event_id % 5 WHEN 0 THEN 99 WHEN 1 THEN event_id + 8 WHEN 2 THEN event_id + 1 ELSE 0 END::BIGINT AS total_tokens, [3, 2, 9, 0, 0][event_id % 5 + 1]::BIGINT AS cache_read_tokens,
    [4, 6, 0, 0, 0][event_id % 5 + 1]::BIGINT AS cache_write_tokens, [5, 0, 4, 0, 0][event_id % 5 + 1]::BIGINT AS reasoning_tokens FROM events""", relations=False)
def usage_numbers(spark, d):
    e = _t(spark, d, "events")
    text = F.replace(F.element_at(F.array(*(F.lit(u) for u in _USAGE)), (F.col("event_id") % 5 + 1).cast("int")), F.lit("#"), F.col("event_id").cast("string"))
    return e.select("event_id", scalars.usage(text).alias("u")).select("event_id", "u.*")


@query("""SELECT user_id, sum(CASE event_id % 5 WHEN 3 THEN 11 WHEN 4 THEN 0 ELSE event_id END)::BIGINT AS input_tokens, sum([7, 8, 1, 0, 0][event_id % 5 + 1])::BIGINT AS output_tokens,
    sum([3, 2, 9, 0, 0][event_id % 5 + 1])::BIGINT AS cache_read_tokens FROM events GROUP BY user_id""", relations=False)
def usage_merged(spark, d):
    text = F.replace(F.element_at(F.array(*(F.lit(u) for u in _USAGE)), (F.col("event_id") % 5 + 1).cast("int")), F.lit("#"), F.col("event_id").cast("string"))
    return scalars.merged_usage(_t(spark, d, "events").select("user_id", text.alias("chunk")), "chunk", ["user_id"]).select("user_id", "input_tokens", "output_tokens", "cache_read_tokens")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN NULL ELSE NULL END AS ttft FROM events""", relations=False)
def ttft_resolution(spark, d):
    own = F.when(F.col("event_id") % 4 == 0, F.col("value")).when(F.col("event_id") % 4 == 2, F.lit(-1.0))
    metrics = F.when(F.col("event_id") % 4 < 3, F.concat(F.lit('{"ttft_ms":'), F.col("event_id").cast("string"), F.lit("}"))).otherwise('{"ttft_ms":"x"}')
    return _t(spark, d, "events").select("event_id", scalars.ttft(own, metrics).alias("ttft"))


# -- exchange -----------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_id % 40 AS revision_id, max(event_id) AS at FROM events WHERE event_id < 500 GROUP BY 1), c AS (SELECT event_id % 60 AS revision_id, max(event_id) AS at FROM events WHERE event_id >= 500 GROUP BY 1)
    SELECT * FROM c UNION ALL SELECT * FROM r WHERE revision_id NOT IN (SELECT revision_id FROM c)""", relations=False)
def revisions_upsert(spark, d):
    latest = lambda rows, n: rows.groupBy((F.col("event_id") % n).alias("revision_id")).agg(F.max("event_id").alias("at"))
    e = _t(spark, d, "events")
    return exchange.upsert_revisions(latest(e.where("event_id < 500"), 40), latest(e.where("event_id >= 500"), 60), order=["at", "revision_id"])


@query(_PAIRS + " SELECT session_id, count(*)::BIGINT AS entries, count(response)::BIGINT AS answered FROM c GROUP BY session_id")
def har_export(spark, d):
    parsed = F.from_json("har", "log struct<version string, creator struct<name string>, entries array<struct<request struct<method string, url string>, response struct<status long>>>>").log.entries
    texts = exchange.har_json(over_tables(spark, d).events)
    return texts.select("session_id", F.size(parsed).cast("long").alias("entries"), F.size(F.filter(parsed, lambda e: e.response.status > 0)).cast("long").alias("answered"))


@query("SELECT append_pos, kind AS name, epoch_us(timestamp) * 1000 AS start_ns, trace_id AS trace, call_id AS span, session_id AS owner, seq::VARCHAR AS number, json_extract(payload_json, '$.payload')::VARCHAR AS payload FROM log")
def otlp_spans(spark, d):
    at = lambda i, kind: F.col("attributes")[i]["value"][kind]
    return exchange.spans(over_tables(spark, d).events).select("append_pos", "name", "start_ns", "trace", "span", at(0, "stringValue").alias("owner"), at(2, "intValue").alias("number"), at(3, "stringValue").alias("payload"))


@query("""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY append_pos)::BIGINT - 1 AS seq, 'otel.span' AS kind, trace_id, call_id, kind AS name FROM log""")
def otlp_import(spark, d):
    rows = exchange.spans_from_json(exchange.spans_json(over_tables(spark, d).events), "otlp")
    return rows.select("session_id", "seq", "kind", "trace_id", "call_id", F.get_json_object("payload_json", "$.payload.otel.name").alias("name"))


@query("""WITH n AS (SELECT *, count(*) FILTER (kind IN ('llm.request', 'http.request')) OVER (PARTITION BY session_id ORDER BY append_pos) AS turn FROM log)
    SELECT session_id, turn::BIGINT AS turn, count(*)::BIGINT AS events, min(append_pos) AS opened, max(append_pos) AS last,
        count(*) FILTER (kind IN ('llm.response', 'llm.response.stream', 'http.response', 'http.response.stream'))::BIGINT AS responses FROM n GROUP BY session_id, turn""")
def turn_windows(spark, d):
    return exchange.turns(over_tables(spark, d).events)


@query("SELECT table_name, column_name FROM (VALUES ('schema_orders', 'o_orderkey'), ('schema_orders', 'o_totalprice'), ('schema_region', 'r_name')) t(table_name, column_name)", relations=False)
def information_schema(spark, d):
    return exchange.information_schema(spark, {"schema_orders": _t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "schema_region": _t(spark, d, "region").select("r_name")}).select("table_name", "column_name")


@query("SELECT doc_id, coalesce(text, '') AS text, substr(coalesce(text, ''), 1, 256) AS preview FROM documents", relations=False)
def content_hydration(spark, d):
    docs = _t(spark, d, "documents")
    rows, objects = exchange.offload(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")
    return exchange.hydrate(rows, objects, "text").select("doc_id", "text", exchange.preview(F.col("text")).alias("preview"))


# -- explorer -----------------------------------------------------------------------------------------


@query("""SELECT _file_, document_id, agent_id FROM runs WHERE lower(agent_id || ' ' || document_id) LIKE '%agent-1 c%' AND _file_ = 'part-2'""")
def explorer_runs(spark, d):
    runs = over_tables(spark, d).runs
    return runs.where(explorer.contains(" Agent-1 C", "agent_id", "document_id") & explorer.fits("_file_", "PART-2") & explorer.fits("agent_id", "all")).select("_file_", "document_id", "agent_id")


@query("SELECT source, step_id, document_id FROM steps WHERE source = 'agent' AND contains(lower(source || ' ' || coalesce(message, '')), 'que')")
def explorer_turns(spark, d):
    return explorer.search_turns(over_tables(spark, d).steps, "que", "agent").select("source", "step_id", "document_id")


@query("""SELECT agent_id, session_id, row_count FROM (SELECT agent_id, document_id AS session_id, (SELECT count(*) FROM steps s WHERE s.document_id = r.document_id)::BIGINT AS row_count FROM runs r)
    ORDER BY row_count DESC, session_id DESC LIMIT 20 OFFSET 5""")
def explorer_page(spark, d):
    r = over_tables(spark, d)
    counted = r.steps.groupBy(F.col("document_id").alias("session_id")).agg(F.count("*").alias("row_count"))
    runs = counted.join(r.runs.select("agent_id", F.col("document_id").alias("session_id")), "session_id")
    return explorer.paginate(explorer.sorted_runs(runs, "events", descending=True, order="session_id"), 5, 20).rows.select("agent_id", "session_id", "row_count")


@query("""WITH b AS (SELECT DISTINCT _file_, document_id, step_id FROM calls WHERE function_name = 'error')
    SELECT function_name AS name, count(*)::BIGINT AS count, count(duration_ms)::BIGINT AS duration_sample_count, sum(duration_ms)::BIGINT AS total_duration_ms, avg(duration_ms) AS average_duration_ms,
           max(duration_ms) AS max_duration_ms, count(b.step_id)::BIGINT AS error_associated_count FROM calls LEFT JOIN b USING (_file_, document_id, step_id) GROUP BY function_name""")
def tool_errors(spark, d):
    calls = over_tables(spark, d).tool_calls
    return explorer.tool_errors(calls, calls.where("function_name = 'error'"))


@query("SELECT kind AS format, '/steps/*/' || (append_pos % 3) || 'x' AS pointer, count(*)::BIGINT AS occurrences FROM log GROUP BY 1, 2")
def unknown_keys(spark, d):
    pointers = over_tables(spark, d).events.select(F.col("kind").alias("format"), F.concat(F.lit("/steps/"), F.col("append_pos").cast("string"), F.lit("/"), (F.col("append_pos") % 3).cast("string"), F.lit("x")).alias("pointer"))
    return explorer.unknown_keys(pointers)


@query("""WITH e AS (SELECT session_id, append_pos, kind, coalesce(call_id, 'unknown') AS call_id, kind = 'llm.request' AS asks, kind IN ('llm.response', 'llm.response.stream') AS answers, append_pos % 5 = 0 AS internal, append_pos % 3 = 0 AS spoken FROM log),
    o AS (SELECT *, count(*) FILTER (asks AND NOT internal) OVER s AS nth FROM e WINDOW s AS (PARTITION BY session_id ORDER BY append_pos)),
    t AS (SELECT *, nullif(count(*) FILTER (asks AND NOT internal AND (spoken OR nth = 1)) OVER s, 0) - 1 AS open FROM o WINDOW s AS (PARTITION BY session_id ORDER BY append_pos)),
    c AS (SELECT *, last_value(CASE WHEN asks THEN open END IGNORE NULLS) OVER w AS asked, first_value(CASE WHEN answers THEN open END IGNORE NULLS) OVER w AS answered FROM t
          WINDOW w AS (PARTITION BY session_id, call_id ORDER BY append_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT session_id, append_pos, kind, call_id, (CASE WHEN answers THEN coalesce(asked, answered) ELSE open END)::BIGINT AS turn_index FROM c""")
def turn_machine(spark, d):
    at = F.col("append_pos")
    return turns.assign(turns.prepared(over_tables(spark, d).events, at % 5 == 0, F.when(at % 3 == 0, F.lit("text"))))


@query("""WITH h AS (SELECT *, lag(source) OVER w AS before, lag(step_id) OVER w AS asked, row_number() OVER w - 1 AS seq FROM steps WINDOW w AS (PARTITION BY _file_, document_id ORDER BY step_id))
    SELECT _file_, document_id, seq::BIGINT AS seq, CASE source WHEN 'system' THEN 'note' WHEN 'user' THEN 'llm.request' ELSE 'llm.response' END AS kind,
           CASE WHEN source <> 'system' THEN 'turn-' || CASE WHEN source = 'agent' AND before = 'user' THEN asked ELSE step_id END END AS call_id, message AS payload FROM h""")
def document_events(spark, d):
    return eventlog.from_steps(over_tables(spark, d).steps, F.col("message"))


# -- routing, queue and messages ------------------------------------------------------------------------


@query("""SELECT 'runs.agent_id' AS "column", _file_, count(DISTINCT agent_id)::BIGINT AS n FROM runs GROUP BY _file_ UNION ALL
    SELECT 'runs.document_id', _file_, count(DISTINCT document_id)::BIGINT FROM runs GROUP BY _file_ UNION ALL SELECT 'steps.document_id', _file_, count(DISTINCT document_id)::BIGINT FROM steps GROUP BY _file_""")
def routing_index(spark, d):
    r = over_tables(spark, d)
    return routing.build_index({"runs": r.runs, "steps": r.steps}, ("agent_id", "document_id")).groupBy("column", "_file_").agg(F.count("*").alias("n"))


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS idx, event_type FROM events WHERE event_type <> 'error'", relations=False)
def queue_clear(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("idx"), "event_type")
    return queueing.clear(rows, rows.where("event_type = 'error'"))


@query("SELECT 'a' AS task, event_id AS idx FROM events WHERE event_id % 6 = 0 OR event_type = 'click' UNION ALL SELECT 'b', event_id FROM events WHERE event_id % 4 = 0", relations=False)
def queue_mark(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("idx"), "event_type")
    seen = lambda task, n: rows.where(F.col("idx") % n == 0).select(F.lit(task).alias("task"), "idx")
    return queueing.mark(seen("a", 6).unionAll(seen("b", 4)), rows.where("event_type = 'click'"), "a")


@query("""SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN coalesce(text, '') <> '' THEN 'text,' ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'image' ELSE 'audio' END AS modalities,
    length(coalesce(text, ''))::BIGINT AS char_count FROM conversations""", relations=False)
def message_extraction(spark, d):
    part = F.struct(F.lit("text").alias("type"), "text")
    shown = F.struct(F.when(F.col("turn") % 2 == 0, "image_url").otherwise("input_audio").alias("type"), F.lit(None).cast("string").alias("text"))
    said = _t(spark, d, "conversations").select("conv_id", "turn", scalars.extract_message(F.to_json(F.array(part, shown)), F.lit(False)).alias("m"))
    return said.select("conv_id", "turn", "m.text", F.concat_ws(",", "m.modalities").alias("modalities"), "m.char_count")


@query("SELECT event_id, 'call-' || event_id AS id, event_type AS name, '{\"u\":' || user_id || '}' AS arguments_json FROM events", relations=False)
def wire_tool_calls(spark, d):
    given = F.struct(F.concat(F.lit("call-"), F.col("event_id").cast("string")).alias("id"), F.struct(F.col("event_type").alias("name"), F.to_json(F.struct(F.col("user_id").alias("u"))).alias("arguments")).alias("function"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(given, given).alias("tool_calls")).alias("message"))).alias("choices")))
    return _t(spark, d, "events").select("event_id", F.explode(scalars.wire_tool_calls(body)).alias("c")).select("event_id", "c.*")


# -- results, comparison, projections and whole runs -----------------------------------------------------


@query("""SELECT r._file_, r.document_id, agent_id, coalesce(turn_count, 0)::BIGINT AS turn_count, coalesce(agent_turns, 0)::BIGINT AS agent_turns, coalesce(model_count, 0)::BIGINT AS model_count,
    coalesce(call_count, 0)::BIGINT AS call_count, coalesce(sample_count, 0)::BIGINT AS sample_count, p50, p95, max_value FROM runs r
    LEFT JOIN (SELECT _file_, document_id, count(*) AS turn_count, count(*) FILTER (source = 'agent') AS agent_turns, count(DISTINCT model_name) AS model_count, count(latency_ms) AS sample_count,
        (list(latency_ms ORDER BY latency_ms) FILTER (latency_ms IS NOT NULL))[ceil((count(latency_ms) - 1) * 0.5)::INT + 1] AS p50,
        (list(latency_ms ORDER BY latency_ms) FILTER (latency_ms IS NOT NULL))[ceil((count(latency_ms) - 1) * 0.95)::INT + 1] AS p95, max(latency_ms) AS max_value FROM steps GROUP BY 1, 2) s USING (_file_, document_id)
    LEFT JOIN (SELECT _file_, document_id, count(*) AS call_count FROM calls GROUP BY 1, 2) c USING (_file_, document_id)""")
def run_analysis(spark, d):
    return analysis.run_analysis(over_tables(spark, d))


def _results(spark, d):
    return _t(spark, d, "events").select((F.col("event_id") % 500).alias("task_id"), F.col("event_id").alias("finished_at"), F.when(F.col("event_type") == "error", "failed").otherwise("ready").alias("status"), F.when(F.col("user_id") % 2 == 0, "io").alias("error_kind"))


_SETTLED = """WITH r AS (SELECT event_id % 500 AS task_id, event_id AS finished_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS status, CASE WHEN user_id % 2 = 0 THEN 'io' END AS error_kind FROM events),
    f AS (SELECT * FROM r WHERE task_id % 7 <> 0 AND task_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY finished_at) = 1) """


def _settled(spark, d):
    found = _results(spark, d)
    known = lambda n: found.where(F.col("task_id") % n == 0).select("task_id").distinct()
    return results.settle(found, known(7), known(11))


@query(_SETTLED + "SELECT task_id, finished_at, status FROM f WHERE status = 'ready'", relations=False)
def results_ready(spark, d):
    return _settled(spark, d)[0]


@query(_SETTLED + "SELECT task_id, finished_at, status, coalesce(error_kind, 'execute') AS error_kind FROM f WHERE status = 'failed'", relations=False)
def results_failed(spark, d):
    return _settled(spark, d)[1]


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'replayed_empty' WHEN turn % 5 = 0 THEN 'original_empty' ELSE 'comparable' END AS status, turn % 3 > 0 AND turn % 5 > 0 AS exact,
    CASE WHEN turn % 3 > 0 AND turn % 5 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM conversations WHERE trim(text) <> '' AND turn % 15 <> 0""", relations=False)
def content_comparison(spark, d):
    talk = _t(spark, d, "conversations").where((F.btrim("text") != "") & (F.col("turn") % 15 != 0))
    left = F.when((F.col("turn") % 5 > 0) | (F.col("turn") % 3 == 0), F.col("text"))
    right = F.when(F.col("turn") % 3 > 0, F.col("text")).otherwise(" ")
    return talk.select("conv_id", "turn", results.content_comparison(left, right).alias("c")).select("conv_id", "turn", "c.status", "c.exact", "c.similarity")


@query("""WITH p AS (SELECT 'e' || o_custkey AS event_file, 'p' || o_orderkey AS projection_file, o_orderstatus = 'F' AS fresh, left(CAST(o_orderdate AS VARCHAR), 10) AS last_modified, o_orderpriority AS generation FROM orders),
    w AS (SELECT event_file AS _file_, count(*) AS n, max({'fresh': fresh, 'last_modified': last_modified, 'generation': generation, 'projection_file': projection_file}) AS best FROM p GROUP BY 1)
    SELECT 'e' || c_custkey AS _file_, CASE WHEN best IS NULL THEN 'missing' WHEN best.fresh THEN 'fresh' ELSE 'stale' END AS projection_status, best.generation AS projection_generation,
        coalesce(n, 0)::BIGINT AS projection_candidates, CASE WHEN best.fresh THEN best.projection_file END AS served_by FROM customer LEFT JOIN w ON w._file_ = 'e' || c_custkey""", relations=False)
def projection_binding(spark, d):
    orders, name = _t(spark, d, "orders"), lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    made = orders.select(name("e", "o_custkey").alias("event_file"), name("p", "o_orderkey").alias("projection_file"), (F.col("o_orderstatus") == "F").alias("fresh"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("last_modified"), F.col("o_orderpriority").alias("generation"))
    sources = _t(spark, d, "customer").select(name("e", "c_custkey").alias("_file_"), F.lit("events").alias("kind")).unionAll(made.select("projection_file", F.lit("storyline")))
    return results.bind_projections(sources, made).drop("kind")
