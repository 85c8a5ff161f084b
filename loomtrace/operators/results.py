"""Results of batch tasks settled once each, comparison of replayed content, and projections bound to their event sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import similarity


def settle(results: DataFrame, ready: DataFrame, failed: DataFrame, key: str = "task_id", order: str = "finished_at", kind: str = "error_kind") -> tuple[DataFrame, DataFrame]:
    """(fresh ready rows, fresh failures): each task once, its first result; a settled task's later results are dropped.

    A failure without a kind is one of executing.
    """
    value = F.struct(order, *[c for c in results.columns if c not in (key, order)])
    first = results.groupBy(key).agg(F.min(value).alias("__first")).select(key, "__first.*").select(*results.columns)
    settled = ready.select(key).unionAll(failed.select(key))
    fresh = first.join(settled, key, "left_anti")
    good = F.col("status") == "ready"
    return fresh.where(good).drop(kind), fresh.where(~F.coalesce(good, F.lit(False))).withColumn(kind, F.coalesce(kind, F.lit("execute")))


def _squeezed(text: Column) -> Column:
    return F.coalesce(F.btrim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def content_comparison(original: Column, replayed: Column) -> Column:
    """Presence of both texts, one of four statuses, equality of the raw texts, and similarity.

    Blank counts as absent; without both there is no equality, and Python runs for pairs that can be compared only.
    """
    here, there = _squeezed(original) != "", _squeezed(replayed) != ""
    both = here & there
    status = F.when(both, "comparable").when(here, "replayed_empty").when(there, "original_empty").otherwise("not_applicable_both_empty")
    null = F.lit(None).cast("string")
    ratio = similarity(F.when(both, original).otherwise(null), F.when(both, replayed).otherwise(null))
    return F.struct(
        here.alias("original_present"), there.alias("replayed_present"), status.alias("status"),
        F.when(both, original == replayed).when(here | there, False).alias("exact"), F.when(both, ratio).when(here | there, 0.0).alias("similarity"),
    )


def bind_projections(sources: DataFrame, projections: DataFrame) -> DataFrame:
    """Sources with the projection that serves each event source; every bound projection disappears as a source.

    ``projections`` has the file of each projection, that of the event source it was made from, fresh, last_modified and
    generation. The winner is fresh before stale, then the latest, the highest generation, the greatest file; only a fresh one serves.
    """
    known = projections.join(sources.where("kind = 'events'").select(F.col("_file_").alias("event_file")), "event_file", "left_semi")
    best = F.max(F.struct("fresh", "last_modified", "generation", "projection_file")).alias("best")
    winners = known.groupBy(F.col("event_file").alias("_file_")).agg(best, F.count("*").alias("projection_candidates"))
    left = sources.join(known.select(F.col("projection_file").alias("_file_")), "_file_", "left_anti")
    return left.drop("projection_status", "projection_generation", "projection_candidates").join(winners, "_file_", "left").select(
        *[c for c in left.columns if c not in ("projection_status", "projection_generation", "projection_candidates")],
        F.when(F.col("best").isNotNull(), F.when(F.col("best.fresh"), "fresh").otherwise("stale")).otherwise(F.when(F.col("kind") == "events", "missing")).alias("projection_status"),
        F.col("best.generation").alias("projection_generation"), F.coalesce("projection_candidates", F.lit(0)).alias("projection_candidates"),
        F.when(F.col("best.fresh"), F.col("best.projection_file")).alias("served_by"),
    )
