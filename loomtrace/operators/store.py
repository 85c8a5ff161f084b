"""Documents in three tables (runs, steps, tool calls) that change as one, with ordinals and the lineage of a projection."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..relations import EVENTS, RUNS, STEPS, TOOL_CALLS, Relations
from .documents import fold_events
from .manifests import Conflict, Manifests

TABLES = {"runs": RUNS, "steps": STEPS, "tool_calls": TOOL_CALLS}
#: Version of the rules by which events are folded; documents of other rules are folded anew.
RULES = 1
#: Folders of documents from which automatic maintenance writes one.
MANY_PARTS = 16


@dataclass(frozen=True)
class Lineage:
    """Of what log, up to which fact version and position, and by which rules documents were folded."""

    source: str
    fact_version: int
    position: int
    rules: int = RULES


class DocumentStore:
    """Relations without events; each change publishes one manifest for all three tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._log = Manifests(spark, path)

    def _schema(self, name: str) -> T.StructType:
        return T.StructType([T.StructField("_file_", T.StringType()), *TABLES[name].fields])

    def _table(self, body: dict | None, name: str) -> DataFrame:
        parts = (body or {}).get("parts", [])
        if not parts:
            return self.spark.createDataFrame([], self._schema(name))
        return self.spark.read.schema(self._schema(name)).parquet(*(f"{self.path}/parts/{p}/{name}" for p in parts))

    def _relations(self, body: dict | None) -> Relations:
        return Relations(*(self._table(body, n) for n in TABLES), self.spark.createDataFrame([], T.StructType([T.StructField("_file_", T.StringType()), *EVENTS.fields])))

    def read(self) -> Relations:
        return self._relations(self._log.last()[1])

    def lineage(self) -> Lineage | None:
        body = self._log.last()[1]
        return Lineage(**body["lineage"]) if body and body.get("lineage") else None

    def _write(self, r: Relations) -> str:
        part = uuid.uuid4().hex
        for name in TABLES:
            getattr(r, name).select(*self._schema(name).names).write.parquet(f"{self.path}/parts/{part}/{name}")
        return part

    def _publish(self, number: int, parts: list[str], lineage: Lineage | None) -> int:
        return self._log.publish(number, {"parts": parts, "lineage": asdict(lineage) if lineage else None})

    def _numbered(self, new: Relations, old: Relations) -> Relations:
        """New runs with their places in the store: that of the document they replace, or the next ones in order of file and id."""
        held = old.runs.select("_file_", "document_id", F.col("storage_ordinal").alias("held"))
        most = old.runs.agg(F.max("storage_ordinal")).first()[0]
        runs = new.runs.join(held, ["_file_", "document_id"], "left")
        fresh = runs.where("held is null").select("_file_", "document_id").withColumn("added", F.row_number().over(Window.orderBy("_file_", "document_id")) - 1 + F.lit(0 if most is None else most + 1))
        runs = runs.join(fresh, ["_file_", "document_id"], "left").withColumn("storage_ordinal", F.coalesce("held", "added").cast("long"))
        return Relations(runs.select(*self._schema("runs").names), new.steps, new.tool_calls, new.events)

    def replace(self, r: Relations, lineage: Lineage | None = None, after: int | None = None) -> int:
        """Make the documents of ``r`` the store's."""
        number, body = self._log.last()
        numbered = self._numbered(r, self._relations(body))
        return self._publish(number if after is None else after, [self._write(numbered)], lineage)

    def upsert(self, r: Relations, lineage: Lineage | None = None, after: int | None = None) -> int:
        """Replace whole documents by those of ``r`` that have their file and id, and add the others.

        What a replaced document had and the new one has not is gone from all three tables.
        """
        number, body = self._log.last()
        old, keys = self._relations(body), r.runs.select("_file_", "document_id").distinct()
        new = self._numbered(r, old)
        kept = [getattr(old, n).join(keys, ["_file_", "document_id"], "left_anti") for n in TABLES]
        merged = Relations(*(a.unionByName(getattr(new, n).select(*a.columns)) for a, n in zip(kept, TABLES, strict=True)), new.events)
        return self._publish(number if after is None else after, [self._write(merged)], lineage or self.lineage())

    def insert(self, r: Relations, squash: bool = False) -> int:
        """Import documents, adding a folder only. An id that is there already is an error or, with ``squash``, gets ``#1``, ``#2`` ...

        The number follows the order of file; the documents keep their session ids.
        """
        number, body = self._log.last()
        old = self._relations(body)
        taken = old.runs.groupBy("document_id").agg(F.count("*").alias("taken"))
        place = F.row_number().over(Window.partitionBy("document_id").orderBy("_file_")) - 1 + F.coalesce("taken", F.lit(0))
        named = r.runs.select("_file_", "document_id").join(taken, "document_id", "left").withColumn("place", place)
        if not squash and (bad := named.where("place > 0").first()):
            raise Conflict(f"document {bad['document_id']!r} of {bad['_file_']!r} is there already")
        name = F.when(F.col("place") > 0, F.concat("document_id", F.lit("#"), F.col("place").cast("string"))).otherwise(F.col("document_id"))
        names = named.select("_file_", "document_id", name.alias("name"))
        renamed = [getattr(r, n).join(names, ["_file_", "document_id"]).withColumn("document_id", F.col("name")).select(*getattr(r, n).columns) for n in TABLES]
        new = self._numbered(Relations(*renamed, r.events), old)
        return self._publish(number, [*(body or {}).get("parts", []), self._write(new)], self.lineage())

    def point(self, file: str, document_id: str, session_id: str | None = None) -> Relations:
        """One document: its run, its steps in order and its calls in order; anything but exactly one run is an error."""
        r = self.read()
        own = lambda df: df.where((F.col("_file_") == file) & (F.col("document_id") == document_id))
        runs = own(r.runs) if session_id is None else own(r.runs).where(F.col("session_id") == session_id)
        if (n := runs.limit(2).count()) != 1:
            raise LookupError(f"{'no' if not n else 'more than one'} document {document_id!r} in {file!r}")
        return Relations(runs, own(r.steps).orderBy("step_id"), own(r.tool_calls).orderBy("step_id", "call_index"), r.events)

    def sync(self, source: str, events: DataFrame, fact_version: int, rows: int) -> str:
        """Bring the documents up to an event log of ``rows`` positions: ``noop``, ``incremental`` or ``rebuild``.

        Nothing is done if the lineage says that they are up to date. They are folded anew if the lineage is missing, of another log or of other
        rules, or goes beyond the log; else the sessions of new events are folded from their full history and replaced.
        """
        number, _ = self._log.last()
        had, now = self.lineage(), Lineage(source, fact_version, rows)
        if had == now:
            return "noop"
        if had is None or had.source != source or had.rules != RULES or had.fact_version > fact_version or had.position > rows:
            self.replace(fold_events(events), now, number)
            return "rebuild"
        touched = events.where(F.col("append_pos") >= had.position).select("_file_", "session_id").distinct()
        self.upsert(fold_events(events.join(touched, ["_file_", "session_id"], "left_semi")), now, number)
        return "incremental"

    def fresh(self, source: str, fact_version: int, rows: int) -> bool:
        """Whether the documents are those of the log's present state."""
        return self.lineage() == Lineage(source, fact_version, rows)

    def maintain(self, many: int = MANY_PARTS) -> bool:
        """Write the folders as one, if they are many, and delete what no manifest names; not to be run beside writers."""
        number, body = self._log.last()
        if body is None or len(body["parts"]) < many:
            return False
        self._publish(number, [self._write(self._relations(body))], Lineage(**body["lineage"]) if body["lineage"] else None)
        for name in self._log.unnamed("parts", set(self._log.last()[1]["parts"])):
            self._log.delete(name)
        return True


def describe(lineage: Lineage | None) -> str:
    return "none" if lineage is None else json.dumps(asdict(lineage), sort_keys=True)
