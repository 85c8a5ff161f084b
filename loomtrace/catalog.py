"""Catalog of a Dataset: discovers files and event logs, decodes them in parallel and offers the relations.

An event log is one source: its events are the relation ``events``, and its sessions are folded into runs, steps and
tool calls. ``trajectories`` has each run with its steps and calls as arrays.

A snapshot pins the files' sizes and times; a file that changed since is an error. A file
that cannot be decoded becomes a source with status ``error``, and the others stay queryable.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import analysis, exchange
from .operators.documents import fold_events
from .operators.eventlog import EventLog, Manifest
from .plans import gate, routing
from .relations import EVENTS, RUNS, SOURCES, STEPS, TOOL_CALLS, Relations
from .sources import decode

MAX_FILES = 1_000_000
MAX_PAGE = 10_000
VIEWS = ("runs", "steps", "tool_calls")
#: Events of one log that are folded into documents for a statement; longer logs are to be projected into a store first.
MAX_FOLD_ROWS = 100_000
ALL_VIEWS = ("runs", "steps", "tool_calls", "events", "sources", "trajectories")
#: Files up to which their names are broadcast.
BROADCAST_FILES = 100_000
#: Columns that the routing index covers.
ROUTED = ("document_id", "session_id", "run_id", "agent_id", "function_name")


@dataclass(frozen=True)
class File:
    name: str
    path: str
    size: int
    modified: int


_MANIFEST = re.compile(r"(?:(.*)/)?manifests/\d{12}\.json")


def listed(spark: SparkSession, root: str, max_files: int = MAX_FILES) -> tuple[list[File], list[str]]:
    """JSON and Markdown files and event logs under a folder of any file system that Spark reads, by relative path."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.getFileStatus(top).getPath().toString().rstrip("/")
    found, logs, listing = [], set(), fs.listFiles(top, True)
    while listing.hasNext():
        status = listing.next()
        path = status.getPath().toString()
        name = path[len(base) + 1 :] or "."
        if any(p.startswith((".", "_")) for p in name.split("/")):
            continue
        if m := _MANIFEST.fullmatch(name):
            logs.add(m[1] or "")
        elif fnmatch.fnmatch(path, "*.json*") or path.endswith(".md"):
            found.append(File(name, path, status.getLen(), status.getModificationTime()))
            if len(found) > max_files:
                raise gate.Exhausted(f"more than {max_files} files")
    inside = lambda name: any(not log or name.startswith(f"{log}/") for log in logs)
    return sorted((f for f in found if not inside(f.name)), key=lambda f: f.name), sorted(logs)


def discover(spark: SparkSession, root: str, max_files: int = MAX_FILES) -> list[File]:
    """The files of ``listed``."""
    return listed(spark, root, max_files)[0]


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for name, content in zip(rows["_file_"], rows["value"], strict=True):
            try:
                form, found = decode.decode(content, markdown=name.endswith(".md"))
                out.append((name, "source", json.dumps({"format": form, "status": "ready"})))
                out += [(name, kind, json.dumps(row, default=lambda d: d.isoformat())) for kind, row in found]
            except Exception as e:  # the policy: a bad file is reported as a source
                out.append((name, "source", json.dumps({"status": "error", "error": str(e)[:500]})))
        yield pd.DataFrame(out, columns=["_file_", "kind", "row"])


def _as(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` in ``_file_`` and a declared schema; columns that they do not have are null."""
    return rows.select("_file_", *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


class Catalog:
    def __init__(self, spark: SparkSession, root: str, report_errors: bool = True, max_fold_rows: int | None = MAX_FOLD_ROWS):
        self.spark, self.root, self.report, self.max_fold_rows = spark, root.rstrip("/"), report_errors, max_fold_rows
        self.files, self.logs = self._now()

    def _now(self) -> tuple[list[File], dict[str, Manifest]]:
        files, logs = listed(self.spark, self.root)
        return files, {name: self._log(name).manifest() for name in logs}

    def _log(self, name: str) -> EventLog:
        return EventLog(self.spark, f"{self.root}/{name}" if name else self.root)

    def validate_unchanged(self) -> None:
        """Files must be as they were; a log may have grown or been compacted, as its pinned rows are still there."""
        files, logs = self._now()
        if files != self.files or any(n not in logs or logs[n].rows < m.rows for n, m in self.logs.items()):
            raise RuntimeError("files changed since the snapshot")

    def events(self, names: Collection[str] | None = None) -> DataFrame:
        """Events of the logs (those named), up to the rows that the snapshot pinned."""
        held = None
        for name, pinned in self.logs.items():
            if pinned.segments and (names is None or name in names):
                rows = _as(self._log(name).read(end=pinned.rows).withColumn("_file_", F.lit(name)), EVENTS)
                held = rows if held is None else held.unionAll(rows)
        return held if held is not None else _as(self.spark.createDataFrame([], "_file_ string"), EVENTS)

    def relations(self, pattern: str | None = None, names: Collection[str] | None = None, folded: bool = True) -> Relations:
        """The relations over all sources, those whose name fits a LIKE pattern, or those named; others are not read.

        Without ``folded`` the logs' documents are left out of runs, steps and tool calls.
        """
        self.validate_unchanged()
        fits = routing.like(pattern, None) if pattern is not None else lambda name: names is None or name in names
        files = [f for f in self.files if fits(f.name)]
        logs = [n for n in self.logs if fits(n)]
        events = self.events(logs)
        r = self._decoded(files)
        about = [(n, "canonical_event", "event_log", str(self.logs[n].fact_version), self.logs[n].rows, "ready") for n in logs]
        about = self.spark.createDataFrame(about, "_file_ string, format string, kind string, snapshot_ref string, size_bytes long, status string")
        sources = r.sources.unionByName(about, allowMissingColumns=True)
        if not folded or not logs:
            return Relations(r.runs, r.steps, r.tool_calls, events, sources)
        if self.max_fold_rows is not None and (long := [n for n in logs if self.logs[n].rows > self.max_fold_rows]):
            raise gate.Exhausted(f"{long[0]!r} has more than {self.max_fold_rows} events; project it into a store")
        d = fold_events(events)
        return Relations(r.runs.unionByName(d.runs), r.steps.unionByName(d.steps), r.tool_calls.unionByName(d.tool_calls), events, sources)

    def _decoded(self, files: list[File]) -> Relations:
        """The relations over files."""
        if not files:
            empty = lambda s: self.spark.createDataFrame([], s).select(F.lit("").alias("_file_"), "*")
            return Relations(empty(RUNS), empty(STEPS), empty(TOOL_CALLS), empty(EVENTS), self.spark.createDataFrame([], SOURCES))
        names = self.spark.createDataFrame([(f.path, f.name, f.size, str(f.modified)) for f in files], "path string, _file_ string, size_bytes long, last_modified string")
        read = self.spark.read.text([f.path for f in files], wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
        named = F.broadcast(names) if len(files) <= BROADCAST_FILES else names
        rows = read.join(named, F.regexp_replace(read["path"], "^file:/*", "/") == F.regexp_replace(names["path"], "^file:/*", "/"))
        decoded = rows.select("_file_", "value").mapInPandas(_decoded, "_file_ string, kind string, row string")

        def relation(kind: str, schema) -> DataFrame:
            return decoded.where(F.col("kind") == kind).select("_file_", F.from_json("row", schema).alias("r")).select("_file_", "r.*")

        state = decoded.where("kind = 'source'").select("_file_", F.from_json("row", "format string, status string, error string").alias("r")).select("_file_", "r.*")
        if not self.report and (bad := state.where("status = 'error'").first()):
            raise ValueError(f"{bad['_file_']}: {bad['error']}")
        sources = state.join(names.drop("path"), "_file_").withColumn("kind", F.lit("file"))
        sources = sources.select(*(F.col(f.name) if f.name in sources.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SOURCES.fields))
        return Relations(relation("run", RUNS), relation("step", STEPS), relation("call", TOOL_CALLS), _as(decoded.limit(0), EVENTS), sources)

    def build_index(self, path: str) -> None:
        """Write the routing index: which files hold which identities."""
        r = self.relations()
        routing.write_index(routing.build_index({n: getattr(r, n) for n in VIEWS}, ROUTED), path)

    def _views(self, names: Collection[str] | None = None, prefix: str = "", folded: bool = True) -> Relations:
        r = self.relations(names=names, folded=folded)
        for name in (*VIEWS, "events", "sources"):
            getattr(r, name).createOrReplaceTempView(prefix + name)
        analysis.trajectories(r).createOrReplaceTempView(f"{prefix}trajectories")
        columns = {n: self.spark.table(prefix + n) for n in ALL_VIEWS}
        exchange.information_schema(self.spark, columns).createOrReplaceTempView(f"{prefix}information_schema_columns")
        return r

    def needed(self, text: str, index: str | None = None) -> list[str]:
        """Names of the sources that a statement can need; all, unless it reads one relation and nothing else."""
        return self._needed(text, index)[0]

    def _needed(self, text: str, index: str | None = None) -> tuple[list[str], set[str]]:
        """Names of the sources, and of the relations that the statement reads."""
        stubs = {"runs": RUNS, "steps": STEPS, "tool_calls": TOOL_CALLS, "events": EVENTS, "sources": None}
        everything = [f.name for f in self.files] + list(self.logs)
        frames = {}
        for name, schema in stubs.items():
            fields = SOURCES if schema is None else T.StructType([T.StructField("_file_", T.StringType()), *schema.fields])
            frames[name] = self.spark.createDataFrame([], fields)
            frames[name].createOrReplaceTempView(name)
        analysis.trajectories(Relations(*(frames[n] for n in stubs))).createOrReplaceTempView("trajectories")
        exchange.information_schema(self.spark, {n: self.spark.table(n) for n in ALL_VIEWS}).createOrReplaceTempView("information_schema_columns")
        df = self.spark.sql(text)
        plan = df._jdf.queryExecution().analyzed().toString()
        read = {n for n in (*ALL_VIEWS, "information_schema_columns") if re.search(rf"SubqueryAlias {n}\b", plan)}
        one = read & set(VIEWS)
        if len(one) != 1 or read != one:
            return everything, read
        return routing.candidates(df, one.pop(), everything, self.spark.read.parquet(index) if index else None, ROUTED), read

    def dataframe(self, text: str, index: str | None = None) -> DataFrame:
        """A read-only statement over the relations as a DataFrame, to go on with; sources it cannot need are not read."""
        text = information(text)
        gate.read_only(self.spark, text, (*ALL_VIEWS, "information_schema_columns", *external_names(self.spark)))
        names, read = self._needed(text, index)
        self._views(names, folded=bool(read & {*VIEWS, "trajectories"}))
        df = self.spark.sql(text)
        if len(self.files) + len(self.logs) > 1:
            gate.join_safe(df, {self.root: {*VIEWS, "events", "trajectories"}})
        return df

    def sql(self, text: str, max_rows: int = 100_000, index: str | None = None) -> list[dict]:
        """Rows of a read-only statement over runs, steps, tool_calls, events, trajectories and sources."""
        return gate.rows_within(self.dataframe(text, index), max_rows)

    def status(self) -> dict:
        """ready, degraded or error with counts; a file in error leaves the counts incomplete, not absent."""
        r = self.relations()
        by = {row["status"]: row["count"] for row in r.sources.groupBy("status").count().collect()}
        ready, bad = by.get("ready", 0), by.get("error", 0)
        return {"status": "ready" if not bad else "degraded" if ready else "error", "ready_sources": ready, "error_sources": bad, "counts_complete": not bad} | {n: getattr(r, n).count() for n in (*VIEWS, "events")}

    def page(self, token: str | None = None, size: int = 100) -> tuple[list[File], str | None]:
        """Files by name, at most 10,000, and the token of the next page, which holds for this snapshot only."""
        if not 1 <= size <= MAX_PAGE:
            raise ValueError(f"a page has 1 to {MAX_PAGE} files")
        mark = hashlib.sha256(repr(self.files).encode()).hexdigest()[:16]
        snapshot, _, start = (token or f"{mark}:0").partition(":")
        if snapshot != mark or not start.isdigit():
            raise ValueError("the token is of another snapshot")
        at = int(start)
        return self.files[at : at + size], f"{mark}:{at + size}" if at + size < len(self.files) else None

    def describe(self, name: str) -> File:
        """One file of the snapshot; an unknown name is an error."""
        for f in self.files:
            if f.name == name:
                return f
        raise LookupError(name)


def external(spark: SparkSession, name: str, path: str, form: str) -> DataFrame:
    """A CSV, JSON-array or JSON-lines file as a view; a name that is no identifier or is taken is an error."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no table name")
    if spark.catalog.tableExists(name):
        raise ValueError(f"{name!r} is taken")
    read = {
        "csv": lambda: spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"'),
        "json": lambda: spark.read.json(path, multiLine=True),
        "jsonl": lambda: spark.read.json(path),
    }
    df = read[form]()
    df.createTempView(name)
    _EXTERNAL.setdefault(id(spark), set()).add(name)
    return df


_EXTERNAL: dict[int, set[str]] = {}


def external_names(spark: SparkSession) -> set[str]:
    """Names of the external tables registered in a session."""
    return {n for n in _EXTERNAL.get(id(spark), set()) if spark.catalog.tableExists(n)}


def information(text: str) -> str:
    """``information_schema.columns`` by the name of its view; texts in quotes stay."""
    parts = re.split(r"('(?:[^']|'')*'|`[^`]*`)", text)
    return "".join(p if i % 2 else re.sub(r"(?i)\binformation_schema\s*\.\s*columns\b", "information_schema_columns", p) for i, p in enumerate(parts))


class Datasets:
    """Several Datasets in one engine: the relations of each are read as ``name.relation``."""

    def __init__(self, spark: SparkSession, roots: dict[str, str], **how):
        if bad := [n for n in roots if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", n)]:
            raise ValueError(f"{bad[0]!r} is no name of a Dataset")
        self.spark, self.catalogs = spark, {n: Catalog(spark, root, **how) for n, root in roots.items()}

    def _named(self, text: str) -> str:
        """``text`` with each ``name.relation`` after FROM, JOIN or a comma as its view, under the relation's name unless it has an alias."""
        names = "|".join(map(re.escape, self.catalogs))
        after = r"(?!\s+(?:AS\b|(?!(?:WHERE|JOIN|LEFT|RIGHT|INNER|FULL|CROSS|ON|GROUP|ORDER|LIMIT|OFFSET|HAVING|UNION|EXCEPT|INTERSECT|WINDOW|NATURAL|ANTI|SEMI|USING)\b)[A-Za-z_]))"
        form = re.compile(rf"(?i)(\b(?:FROM|JOIN)\s+|,\s*)({names})\s*\.\s*({'|'.join(ALL_VIEWS)})\b({after})?")
        place = lambda m: f"{m[1]}{m[2].lower()}__{m[3].lower()}" + (f" AS {m[3]}" if m[4] is not None else "")
        parts = re.split(r"('(?:[^']|'')*'|`[^`]*`)", text)
        return "".join(p if i % 2 else form.sub(place, p) for i, p in enumerate(parts))

    def dataframe(self, text: str) -> DataFrame:
        """A read-only statement over the Datasets' relations; joins within one must equate ``_file_``."""
        named = self._named(text)
        views = {n: {f"{n.lower()}__{v}" for v in ALL_VIEWS} for n in self.catalogs}
        gate.read_only(self.spark, named, set().union(*views.values()))
        used = {n for n, found in views.items() if any(re.search(rf"(?i)\b{v}\b", named) for v in found)}
        for n in used:
            self.catalogs[n]._views(prefix=f"{n.lower()}__")
        df = self.spark.sql(named)
        gate.join_safe(df, {n: views[n] - {f"{n.lower()}__sources"} for n in used if len(self.catalogs[n].files) + len(self.catalogs[n].logs) > 1})
        return df

    def sql(self, text: str, max_rows: int = 100_000) -> list[dict]:
        return gate.rows_within(self.dataframe(text), max_rows)
