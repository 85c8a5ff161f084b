"""Built-in analyses over the relations: groupings by (file, document), never by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..relations import Relations

DOCUMENT = ["_file_", "document_id"]
#: Upper bounds of the latency buckets in milliseconds; the last one is open.
LATENCY_BOUNDS = (100, 500, 1000, 3000, 10000)
LATENCY_NAMES = ("<100", "100-500", "500-1000", "1000-3000", "3000-10000", ">=10000")


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def overview(r: Relations) -> DataFrame:
    """One row of totals; models are those declared by runs or observed in steps."""
    models = r.runs.select(F.col("agent_model_name").alias("model")).unionAll(r.steps.select("model_name")).where("model is not null")
    parts = (
        r.runs.agg(F.count("*").alias("trajectories"), F.countDistinct("agent_id").alias("agents")),
        r.steps.agg(F.count("*").alias("steps"), _count_if(F.col("source") == "user").alias("user_steps"), _count_if(F.col("source") == "agent").alias("agent_steps")),
        r.tool_calls.agg(F.count("*").alias("tool_calls")),
        models.agg(F.countDistinct("model").alias("models")),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part)  # one row each
    if r.sources is not None:
        out = r.sources.agg(F.count("*").alias("sources"), _count_if(F.col("status") == "ready").alias("ready_sources"), _count_if(F.col("status") == "error").alias("error_sources")).join(out)
    return out


def agents(r: Relations) -> DataFrame:
    """Totals per agent; steps and calls are summed per document before they meet the runs."""
    steps = r.steps.groupBy(DOCUMENT).agg(F.count("*").alias("s"), _count_if(F.col("source") == "user").alias("u"), _count_if(F.col("source") == "agent").alias("a"))
    calls = r.tool_calls.groupBy(DOCUMENT).agg(F.count("*").alias("t"))
    joined = r.runs.join(steps, DOCUMENT, "left").join(calls, DOCUMENT, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        joined.groupBy("agent_id", "agent_name", "agent_version")
        .agg(F.count("*").alias("trajectories"), F.countDistinct("_file_").alias("sources"), total("s").alias("steps"), total("u").alias("user_steps"), total("a").alias("agent_steps"), total("t").alias("tool_calls"))
        .withColumns({c: F.coalesce(c, F.lit("")) for c in ("agent_name", "agent_version")})
        .orderBy(F.desc("trajectories"), "agent_id", "agent_name", "agent_version")
    )


def models(r: Relations) -> DataFrame:
    """Declared by how many trajectories, observed in how many steps."""
    named = r.runs.select(F.col("agent_model_name").alias("model"), F.lit(1).alias("d"), F.lit(0).alias("o")).unionAll(r.steps.select("model_name", F.lit(0), F.lit(1)))
    return (
        named.where("model <> ''").groupBy("model").agg(F.sum("d").alias("declared_trajectories"), F.sum("o").alias("observed_steps"))
        .orderBy(F.desc("observed_steps"), F.desc("declared_trajectories"), "model")
    )


def tools(r: Relations) -> DataFrame:
    """Calls per function, first within documents; a missing duration counts as 0 but is no sample."""
    per = r.tool_calls.groupBy(*DOCUMENT, "function_name").agg(F.count("*").alias("n"), F.count("duration_ms").alias("k"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("ms"))
    return (
        per.groupBy("function_name")
        .agg(F.sum("n").alias("calls"), F.count("*").alias("trajectories"), F.countDistinct("_file_").alias("sources"), F.sum("k").alias("duration_samples"), F.sum("ms").alias("total_duration_ms"))
        .orderBy(F.desc("calls"), "function_name")
    )


def event_stats(events: DataFrame) -> DataFrame:
    """Per (file, session): rows, repeated event ids, terminal rank, last end record, requests and responses."""
    kind = F.col("kind")
    rank = F.when(kind.isin("run.failed", "run.cancelled"), 3).when(kind == "run.completed", 2).when(kind == "session.ended", 1).otherwise(0)
    return events.groupBy("_file_", "session_id").agg(
        F.count("*").alias("row_count"), (F.count("event_id") - F.countDistinct("event_id")).alias("duplicates"), F.max(rank).alias("terminal_rank"),
        F.max(F.when(kind == "session.ended", F.col("payload_json"))).alias("ended_payload"),
        _count_if(kind == "llm.request").alias("requests"), _count_if(kind.isin("llm.response", "llm.response.stream")).alias("responses"),
    )


def terminal_status(stats: DataFrame) -> DataFrame:
    """failed, completed, active or null, from the rank, else the end record's exit code, else the calls' balance.

    Only a whole number in the record's payload is an exit code; without calls there is no status.
    """
    code = F.try_variant_get(F.try_parse_json("ended_payload"), "$.payload.exit_code", "variant")
    code = F.when(F.schema_of_variant(code) == "BIGINT", F.try_variant_get(F.try_parse_json("ended_payload"), "$.payload.exit_code", "long"))
    balance = F.when((F.col("requests") == 0) & (F.col("responses") == 0), F.lit(None)).when(F.col("responses") >= F.col("requests"), "completed").otherwise("active")
    ended = F.when(code != 0, "failed").otherwise("completed")
    status = F.when(F.col("terminal_rank") >= 3, "failed").when(F.col("terminal_rank") == 2, "completed").when(F.col("terminal_rank") == 1, ended).otherwise(balance)
    return stats.select("_file_", "session_id", "row_count", "duplicates", status.alias("status"))


def run_summaries(r: Relations, metadata_status: Column | None = None) -> DataFrame:
    """Per run: its rows and status, from its session's events if it has any, else its steps and what its metadata say (active, if nothing)."""
    steps = r.steps.groupBy(DOCUMENT).agg(F.count("*").alias("steps"))
    found = terminal_status(event_stats(r.events)).withColumn("seen", F.lit(True))
    told = F.lit("active") if metadata_status is None else F.coalesce(metadata_status, F.lit("active"))
    status = F.when(F.col("seen"), F.coalesce("status", F.lit("active"))).otherwise(told)
    return (
        r.runs.join(steps, DOCUMENT, "left").join(found, ["_file_", "session_id"], "left")
        .select(F.concat_ws("/", "_file_", "document_id").alias("path"), "agent_id", F.coalesce("row_count", "steps", F.lit(0)).alias("row_count"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), status.alias("status"))
        .orderBy("path")
    )


def percentile(samples: Column, p: float) -> Column:
    """Sample number ceil((n - 1) p) of the sorted samples, counted from 0; null without samples."""
    ordered = F.array_sort(F.collect_list(samples))
    return F.when(F.count(samples) > 0, F.element_at(ordered, F.ceil((F.count(samples) - 1) * p).cast("int") + 1))


def percentiles(rows: DataFrame, by: str | list[str], value: str) -> DataFrame:
    """p50, p95 and maximum of one value, with how many rows have it.

    Exact and without a list per group: samples are numbered within partial counts of equal values,
    so a group of any size is a sorted run of (value, count) pairs.
    """
    by = [by] if isinstance(by, str) else by
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counted.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = lambda p: F.min(F.when(F.col("upto") > F.ceil((F.col("n") - 1) * F.lit(p)), F.col(value)))
    stats = upto.groupBy(*by).agg(F.max("n").alias("sample_count"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max_value"))
    return rows.groupBy(*by).agg(F.count("*").alias("total_count")).join(stats, by, "left").select(*by, "total_count", F.coalesce("sample_count", F.lit(0)).alias("sample_count"), "p50", "p95", "max_value")


def run_analysis(r: Relations) -> DataFrame:
    """Per document: turns and agent turns, calls, distinct models, and percentiles of latency with their coverage.

    Each side is aggregated by document before the join; no list of a document's samples is held.
    """
    key = ["_file_", "document_id"]
    steps = r.steps.groupBy(*key).agg(F.count("*").alias("turn_count"), _count_if(F.col("source") == "agent").alias("agent_turns"), F.count_distinct("model_name").alias("model_count"))
    calls = r.tool_calls.groupBy(*key).agg(F.count("*").alias("call_count"))
    latency = percentiles(r.steps, key, "latency_ms").drop("total_count")
    found = r.runs.select(*key, "agent_id").join(steps, key, "left").join(calls, key, "left").join(latency, key, "left")
    return found.select(*key, "agent_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("turn_count", "agent_turns", "model_count", "call_count", "sample_count")), "p50", "p95", "max_value")


def latency_histogram(rows: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Counts in half-open buckets, empty ones included."""
    spark = rows.sparkSession
    bucket = F.lit(len(LATENCY_BOUNDS))
    for k in reversed(range(len(LATENCY_BOUNDS))):
        bucket = F.when(F.col(value) < LATENCY_BOUNDS[k], k).otherwise(bucket)
    counts = rows.where(F.col(value) >= 0).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame(list(enumerate(LATENCY_NAMES)), "bucket int, name string")
    return names.join(counts, "bucket", "left").select("bucket", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy("bucket")


def dimension_breakdown(steps: DataFrame, dimensions: tuple[str, ...] = ("source", "model_name")) -> DataFrame:
    """Turns and latency per value of each dimension, in one pass by grouping sets."""
    spread = steps.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(d, F.lit("unavailable")).alias("name")) for d in dimensions))).alias("d"), "latency_ms")
    return (
        spread.groupBy("d.dimension", "d.name")
        .agg(F.count("*").alias("turns"), F.count("latency_ms").alias("latency_samples"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"))
        .orderBy("dimension", F.desc("turns"), "name")
    )


def trajectories(r: Relations) -> DataFrame:
    """Runs with their steps' and calls' values as six ordered arrays; one aggregation per side, null where a side is empty."""
    def ordered(keys: tuple[str, ...], value: str, name: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col(value).alias("v")))), lambda x: x.v).alias(name)

    step = lambda value, name: ordered(("step_id",), value, name)
    call = lambda value, name: ordered(("step_id", "call_index"), value, name)
    steps = r.steps.groupBy(DOCUMENT).agg(F.count("*").alias("step_count"), F.array_sort(F.collect_list("step_id")).alias("step_ids"), step("source", "step_sources"), step("message_json", "messages_json"))
    calls = r.tool_calls.groupBy(DOCUMENT).agg(
        F.count("*").alias("tool_call_count"), call("function_name", "tool_names"), call("arguments_json", "tool_arguments_json"), call("results_json", "tool_results_json")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return r.runs.join(steps, DOCUMENT, "left").join(calls, DOCUMENT, "left").select(
        *[F.col(c) for c in r.runs.columns], zero("step_count"), "step_ids", "step_sources", "messages_json", zero("tool_call_count"), "tool_names", "tool_arguments_json", "tool_results_json"
    )


def status_counts(r: Relations) -> DataFrame:
    """Rows of each relation per source file."""
    tagged = [d.groupBy("_file_").agg(F.count("*").alias("n")).withColumn("relation", F.lit(name)) for name, d in (("runs", r.runs), ("steps", r.steps), ("tool_calls", r.tool_calls), ("events", r.events))]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def find(rows: DataFrame, limit: int, **identity: str) -> tuple[DataFrame, Column]:
    """Rows of one identity in order, one more than ``limit`` so that the caller sees whether it was cut."""
    for column, value in identity.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy("_file_", "document_id", *([c] if (c := "step_id") in rows.columns else [])).limit(limit + 1)
