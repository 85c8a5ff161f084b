"""Steps of trajectory files in a few columns: the JSON is parsed against a narrow schema, so what is not asked for is skipped.

Only columns that stand in a step as they are can be read so; others, and files with embedded trajectories, need the whole
decoder. Predicates on session, source and step number are applied to the steps before they leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of steps and the types of a step's fields that hold them.
FIELDS = {
    "step_id": "bigint", "source": "string", "reasoning_content": "string", "model_name": "string", "llm_call_count": "bigint", "is_copied_context": "boolean", "kind": "string",
}
#: Numbers in a step's metrics, by the keys that may hold them, in order of precedence.
METRICS = {"latency_ms": ("latency_ms", "elapsed_ms", "duration_ms"), "ttft_ms": ("ttft_ms",)}
OWN = ("_file_", "document_id", "session_id")


def projectable(columns: Sequence[str]) -> bool:
    return bool(columns) and set(columns) <= {*OWN, *FIELDS, *METRICS}


def atif_steps(spark: SparkSession, files: dict[str, str], columns: Sequence[str], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``columns`` of the steps of files (name -> path), and the names of files that need the whole decoder.

    A file that is no readable JSON, has no trajectory of this dialect, or embeds others is among the latter and gives no steps here.
    """
    if not projectable(columns):
        raise ValueError(f"not read by projection: {sorted(set(columns) - {*OWN, *FIELDS, *METRICS})}")
    fields = [f"{c}: {FIELDS[c]}" for c in FIELDS if c in columns or c in ("step_id", "source")]
    keys = [k for c in columns if c in METRICS for k in METRICS[c]]
    if keys:
        fields.append(f"metrics: struct<{', '.join(f'{k}: double' for k in dict.fromkeys(keys))}>")
    schema = f"session_id string, trajectory_id string, agent struct<id: string>, subagent_trajectories array<string>, steps array<struct<{', '.join(fields)}>>, broken string"
    read = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "broken").json(list(files.values()))
    names = spark.createDataFrame(list(files.items()), "_file_ string, path string")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    read = read.withColumn("at", plain(F.col("_metadata.file_path"))).join(names.withColumn("at", plain(F.col("path"))), "at")
    whole = F.coalesce(F.size("subagent_trajectories"), F.lit(0)) > 0
    other = F.col("broken").isNotNull() | F.coalesce("session_id", "trajectory_id").isNull() | F.col("steps").isNull() | F.col("agent").isNull() | whole
    odd = read.where(other).select("_file_").distinct()
    session = F.coalesce("session_id", "trajectory_id")
    each = read.where(~other).select("_file_", F.coalesce("trajectory_id", session).alias("document_id"), session.alias("session_id"), F.explode("steps").alias("s"))
    number = lambda c: F.floor(F.coalesce(*(F.col(f"s.metrics.{k}") for k in METRICS[c]))).cast("long").alias(c)
    rows = each.select(*OWN, *(F.col(f"s.{c}").alias(c) for c in FIELDS if c in columns or c in ("step_id", "source")), *(number(c) for c in METRICS if c in columns))
    rows = rows.join(F.broadcast(odd) if len(files) <= 100_000 else odd, "_file_", "left_anti")  # a file may hold several trajectories
    return (rows if where is None else rows.where(where)).select(*columns), odd
