"""Event log on files: manifests published under a writer's fence, bounded compaction, vacuum, and events from documents.

The log is Parquet segments and numbered manifests that list them. A manifest is published by creating the next
number's file by a rename that does not replace (so on file systems with such renames only one writer can do it); a
writer whose epoch is older than the last manifest's is refused.
The fact version grows with rows only, so compaction never makes what was derived from the log stale.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Segments of one level that are rewritten into one of the next.
FAN_OUT = 8
VACUUM_SECONDS = 7 * 24 * 3600


class Conflict(RuntimeError):
    """Another writer published first, or this one's epoch is over."""


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    epoch: int = 0
    fact_version: int = 0
    rows: int = 0
    #: Of each segment: path below the log, level, first position, rows.
    segments: list[dict] = field(default_factory=list)


class EventLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.epoch = spark, path.rstrip("/"), 0

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest_name(self, number: int) -> str:
        return f"manifests/{number:012d}.json"

    def manifest(self) -> Manifest:
        """The last one published; an empty one for a new log."""
        folder, fs = self._at("manifests")
        if not fs.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        last = max((n for n in names if n.endswith(".json") and n[0].isdigit()), default=None)
        if last is None:
            return Manifest()
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/{last}", wholetext=True).first()[0]))

    def _publish(self, before: Manifest, **changes) -> Manifest:
        now = self.manifest()
        if now.epoch > self.epoch:
            raise Conflict(f"epoch {self.epoch} is over, {now.epoch} writes")
        if now.number != before.number:
            raise Conflict("another manifest was published")
        new = Manifest(**(asdict(before) | changes | {"number": before.number + 1, "epoch": self.epoch}))
        text = bytearray(json.dumps(asdict(new)).encode())
        draft, fs = self._at(f"manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(text)
        out.close()
        target, _ = self._at(self._manifest_name(new.number))
        if fs.exists(target) or not fs.rename(draft, target):  # a rename does not replace what another writer made
            fs.delete(draft, False)
            raise Conflict(f"manifest {new.number} exists")
        return new

    def acquire(self) -> int:
        """Become the writer; earlier ones are fenced off from now on."""
        before = self.manifest()
        self.epoch = before.epoch + 1
        self._publish(before)
        return self.epoch

    def append(self, events: DataFrame, order: list[str]) -> Manifest:
        """Add events in the given order and publish them at once; positions go on from the last one.

        Positions come from per-partition counts after a range partitioning, so no sort is brought to one task.
        """
        before = self.manifest()
        name = f"segments/{uuid.uuid4().hex}"
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        ranged = events.drop("append_pos").repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        counts = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # one row per partition
        local = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)  # the number within the partition
        placed = rows.join(F.broadcast(counts), "__part").withColumn("append_pos", local + F.col("__base") + F.lit(before.rows))
        placed.drop("__part", "__at", "__base").write.parquet(f"{self.path}/{name}")
        n = self.spark.read.parquet(f"{self.path}/{name}").count()
        where, fs = self._at(staged[len(self.path) + 1 :])
        fs.delete(where, True)
        if not n:
            return before
        segment = {"path": name, "level": 0, "first": before.rows, "rows": n}
        return self._publish(before, segments=[*before.segments, segment], rows=before.rows + n, fact_version=before.fact_version + 1)

    def read(self, start: int | None = None, end: int | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Published events (unordered), as of a manifest (the last one); of a half-open range of positions only the segments that hold it are read."""
        found = manifest or self.manifest()
        chosen = [s for s in found.segments if (start is None or s["first"] + s["rows"] > start) and (end is None or s["first"] < end)]
        if not found.segments:
            raise FileNotFoundError(self.path)
        rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{s['path']}" for s in chosen or found.segments[:1]))
        low, high = F.lit(0 if start is None else start), F.lit(found.rows if end is None else end)
        return rows.where((F.col("append_pos") >= low) & (F.col("append_pos") < high)) if chosen else rows.limit(0)

    def compact(self) -> int:
        """Rewrite each run of FAN_OUT neighbouring segments of a level as one of the next; returns how many were rewritten."""
        done = 0
        while True:
            before = self.manifest()
            levels = [s["level"] for s in before.segments]
            at = next((i for i in range(len(levels) - FAN_OUT + 1) if len(set(levels[i : i + FAN_OUT])) == 1), None)
            if at is None:
                return done
            old = before.segments[at : at + FAN_OUT]
            name = f"segments/{uuid.uuid4().hex}"
            rows = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{s['path']}" for s in old))
            rows.repartitionByRange("append_pos").sortWithinPartitions("append_pos").write.parquet(f"{self.path}/{name}")
            new = {"path": name, "level": old[0]["level"] + 1, "first": old[0]["first"], "rows": sum(s["rows"] for s in old)}
            self._publish(before, segments=[*before.segments[:at], new, *before.segments[at + FAN_OUT :]])
            done += FAN_OUT

    def vacuum(self, older: float = VACUUM_SECONDS) -> int:
        """Delete segments that the last manifest does not name and that are older than so many seconds."""
        kept = {s["path"].split("/")[-1] for s in self.manifest().segments}
        folder, fs = self._at("segments")
        if not fs.exists(folder):
            return 0
        stale = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in kept and s.getModificationTime() / 1000 <= time.time() - older]
        for p in stale:
            fs.delete(p, True)
        return len(stale)

    def stats(self) -> dict:
        found = self.manifest()
        return {"rows": found.rows, "segments": len(found.segments), "fact_version": found.fact_version, "levels": sorted({s["level"] for s in found.segments})}


def from_steps(steps: DataFrame, text: Column, key: tuple[str, ...] = ("_file_", "document_id")) -> DataFrame:
    """Events of documents: key, seq, kind, call_id, payload. A user's step is a request, an agent's a response, the others notes.

    An agent's step right after a user's answers it under one call id, ``turn-`` and the first one's step id.
    """
    order = Window.partitionBy(*key).orderBy("step_id")
    internal = F.col("source") == "system"
    held = steps.select(*key, "step_id", "source", text.alias("payload"), F.lag("source").over(order).alias("before"), F.lag("step_id").over(order).alias("asked"))
    answers = (F.col("source") == "agent") & (F.col("before") == "user")
    call = F.when(~internal, F.concat(F.lit("turn-"), F.when(answers, F.col("asked")).otherwise(F.col("step_id")).cast("string")))
    kind = F.when(internal, "note").when(F.col("source") == "user", "llm.request").otherwise("llm.response")
    return held.select(*key, (F.row_number().over(order) - 1).cast("long").alias("seq"), kind.alias("kind"), call.alias("call_id"), "payload")
