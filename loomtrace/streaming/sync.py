"""Event log kept folded by Structured Streaming: each micro-batch re-folds the sessions it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import projection
from ..operators.tables import Table


def follow(spark: SparkSession, log_path: str, schema, target: Table, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep ``target`` the fold of the Parquet log at ``log_path``.

    A batch reads its sessions' full history from the log, so replaying a batch gives the same table.
    """
    def apply(batch: DataFrame, _: int) -> None:
        touched = batch.select("session_id").distinct()
        history = spark.read.schema(schema).parquet(log_path).join(touched, "session_id", "left_semi")
        fresh = projection.fold(history)
        target.replace(target.read().join(touched, "session_id", "left_anti").unionByName(fresh) if target.current() else fresh)

    stream = spark.readStream.schema(schema).parquet(log_path).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 second")).start()
