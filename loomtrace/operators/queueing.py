"""Queue consumption and samplers."""

from __future__ import annotations

import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

#: Requested rows up to which a request is broadcast.
BROADCAST_ROWS = 100_000

def ready(rows: DataFrame, consumed: DataFrame, task: str, index: str = "idx") -> DataFrame:
    """Rows that the task has not consumed; other tasks' marks do not count."""
    return rows.join(consumed.where(F.col("task") == task).select(index), index, "left_anti")


def sequential(rows: DataFrame, n: int, index: str = "idx") -> DataFrame:
    return rows.orderBy(index).limit(n)


def runs_of(rows: DataFrame, n: int, index: str = "idx", batch: int | None = None) -> DataFrame:
    """Groups of n consecutive indexes: whole groups from the start of every island of consecutive ones.

    The island's number is index minus rank; ranks are taken within ranges of the index, so that no task sorts all rows.
    """
    span = 1 << 16
    ranges = rows.select(index, F.floor(F.col(index) / span).alias("range"))
    before = Window.partitionBy("range").orderBy(index)
    local = ranges.withColumn("prior", F.lag(index).over(before))
    opens = local.where(F.col("prior").isNull() | (F.col("prior") != F.col(index) - 1)).select(F.col(index).alias("start"), "range")
    tails = ranges.groupBy("range").agg(F.max(index).alias("last")).select((F.col("range") + 1).alias("range"), "last")
    opens = opens.join(tails, "range", "left").where(F.col("last").isNull() | (F.col("start") != F.col("last") + 1)).select("start")
    # starts of islands, each carried on to the ranges behind it
    filled = F.max("start").over(Window.partitionBy("range").orderBy(index))
    marks = local.join(opens.withColumnRenamed("start", index).withColumn("start", F.col(index)), index, "left").withColumn("start", filled)
    firsts = marks.groupBy("range").agg(F.max("start").alias("carry"))
    carry = firsts.select((F.col("range") + 1).alias("range"), F.max("carry").over(Window.orderBy("range")).alias("carry"))  # one row per range of 65,536
    placed = marks.join(carry, "range", "left").select(index, F.coalesce("start", "carry").alias("island"))
    sizes = placed.groupBy("island").agg(F.count("*").alias("size"))
    kept = placed.join(sizes, "island").where(F.col(index) - F.col("island") < F.floor(F.col("size") / n) * n).select(index, ((F.col(index) - F.col("island")) / n).cast("long").alias("group"), "island")
    return kept if batch is None else kept.orderBy(index).limit(batch - batch % n)


class Sampler:
    """Interface of samplers on the driver: (ready, n) -> (sampled, consumed)."""

    def sample(self, ready: list[int], n: int) -> tuple[list[int], list[int]]:
        raise NotImplementedError


class SequentialSampler(Sampler):
    def sample(self, ready: list[int], n: int) -> tuple[list[int], list[int]]:
        return list(ready[:n]), list(ready[:n])


class RankAwareSampler(Sampler):
    """The first n, remembered per (partition, task, rank, batch); too few give none."""

    def __init__(self) -> None:
        self.seen: dict[tuple, list[int]] = {}

    def sample(self, ready: list[int], n: int, partition: str = "", task: str = "", rank: int = 0, batch: int = 0) -> tuple[list[int], list[int]]:
        key = (partition, task, rank, batch)
        if key not in self.seen:
            if len(ready) < n:
                return [], []
            self.seen[key] = list(ready[:n])
        return self.seen[key], self.seen[key]


class GroupSampler(Sampler):
    """Whole runs of n consecutive indexes, as many as make up the batch, or none."""

    def __init__(self, group: int) -> None:
        self.group = group

    def sample(self, ready: list[int], n: int) -> tuple[list[int], list[int]]:
        if n % self.group:
            raise ValueError("the batch must be a multiple of the group")
        out, at = [], 0
        while at + self.group <= len(ready) and len(out) < n:
            part = list(ready[at : at + self.group])
            if part[-1] - part[0] == self.group - 1 and part == sorted(set(part)):
                out += part
                at += self.group
            else:
                at += 1
        return (out, out) if len(out) == n else ([], [])


def get(rows: DataFrame, limit: int, offset: int = 0, index: str = "idx") -> DataFrame:
    return rows.orderBy(index).offset(offset).limit(limit)


def by_indices(rows: DataFrame, wanted: list[int], index: str = "idx") -> DataFrame:
    """Rows in the order of the request; a repeated index gives its row again, an absent one none."""
    places = rows.sparkSession.createDataFrame(list(enumerate(wanted)), f"__place long, {index} long")
    return rows.join(F.broadcast(places) if len(wanted) <= BROADCAST_ROWS else places, index).orderBy("__place").drop("__place").select(*rows.columns)  # as long as the request


def mark(consumed: DataFrame, rows: DataFrame, task: str, index: str = "idx") -> DataFrame:
    """The ledger with the rows marked for the task, each once."""
    fresh = rows.select(F.lit(task).alias("task"), index).distinct()
    return consumed.select("task", index).unionAll(fresh.join(consumed, ["task", index], "left_anti"))


def reset(consumed: DataFrame, task: str) -> DataFrame:
    return consumed.where(F.col("task") != task)


def clear(rows: DataFrame, gone: DataFrame, index: str = "idx") -> DataFrame:
    """Rows without those of ``gone``, numbered densely from 0 in order.

    Ranks are taken within ranges of 65,536 indexes and shifted by the sizes of the ranges before, so that no task sorts all rows.
    """
    kept = rows.join(gone.select(index), index, "left_anti").withColumn("__range", F.floor(F.col(index) / (1 << 16)))
    sizes = kept.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__start"))  # one row per range of 65,536
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(index)) - 1
    placed = kept.withColumn("__rank", rank).join(starts, "__range")
    return placed.select(*((F.col("__start") + F.col("__rank")).alias(c) if c == index else F.col(f"`{c}`") for c in rows.columns))


class KeyValue:
    """Values with tags under unique keys, kept in a table that hashes its keys."""

    SCHEMA = "key string, value string, tags map<string,string>"

    def __init__(self, table: tables.Table):
        self.table = table

    def put(self, items: DataFrame) -> None:
        """Insert or replace; a key that stands twice in the batch is an error."""
        if items.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("a key stands twice in the batch")
        if self.table.current() is None:
            self.table.add(items)
        else:
            self.table.upsert(items, ["key"])

    def get(self, keys: list[str]) -> DataFrame:
        """One row per requested key, in the order of the request; an absent key has null for value."""
        spark = self.table.spark
        wanted = spark.createDataFrame(list(enumerate(keys)), "__place long, key string")
        stored = spark.createDataFrame([], self.SCHEMA) if self.table.current() is None else self.table.read().join(wanted.select("key").distinct(), "key", "left_semi")
        return wanted.join(stored, "key", "left").orderBy("__place").select("key", "value", "tags")

    def list(self, **tags: str) -> DataFrame:
        """Keys and tags of the rows that carry all the given tags."""
        found = self.table.read()
        for name, value in tags.items():
            found = found.where(F.col("tags").getItem(name) == value)
        return found.select("key", "tags")

    def clear(self, keys: list[str] | None = None) -> None:
        rows = self.table.read()
        if keys is not None:
            rows = rows.join(self.table.spark.createDataFrame([(k,) for k in keys], "key string").distinct(), "key", "left_anti")
        self.table.replace(rows if keys is not None else rows.limit(0))


class Queue:
    """Records under dense indexes from 0, kept in a table; what is put waits on the driver until a batch is full or flushed.

    The buffer holds ``batch`` records at most; an append adds a folder to the table and rewrites nothing.
    """

    def __init__(self, table: tables.Table, schema: str, batch: int = 1000):
        self.table, self.batch = table, batch
        self._given = T.StructType.fromDDL(schema)
        self._schema = T.StructType([T.StructField("idx", T.LongType()), *self._given.fields])
        self._buffer: list[dict] = []
        self._changed = threading.Condition(threading.RLock())
        self._kept = table.count_rows() if table.exists() else 0

    def total_count(self) -> int:
        with self._changed:
            return self._kept + len(self._buffer)

    def put(self, record: dict) -> None:
        self.put_batch([record])

    def put_batch(self, records: list[dict]) -> None:
        with self._changed:
            for record in records:
                self._buffer.append(record)
                if len(self._buffer) >= self.batch:
                    self.flush()
            self._changed.notify_all()

    def flush(self) -> None:
        """Write what waits; if that fails, it waits on."""
        with self._changed:
            if self._buffer:
                rows = [(self._kept + i, *(r.get(f.name) for f in self._given.fields)) for i, r in enumerate(self._buffer)]
                self.table.add(self.table.spark.createDataFrame(rows, self._schema))
                self._kept, self._buffer = self._kept + len(rows), []

    def get(self, limit: int, offset: int = 0) -> list[dict]:
        """Records from an index on, in order; at most ``limit``, which the caller bounds."""
        with self._changed:
            stored = []
            if offset < self._kept:
                rows = self.table.read().where((F.col("idx") >= offset) & (F.col("idx") < offset + limit)).orderBy("idx")
                stored = [{f.name: r[f.name] for f in self._given.fields} for r in rows.collect()]
            start = max(0, offset - self._kept)
            return stored + self._buffer[start : start + max(0, limit - len(stored))]

    def get_by_indices(self, wanted: list[int]) -> list[dict]:
        """Records in the order of the request; an absent index gives none."""
        self.flush()
        if not self.table.exists():
            return []
        return [{f.name: r[f.name] for f in self._given.fields} for r in by_indices(self.table.read(), wanted).collect()]

    def get_stream(self, limit: int, offset: int = 0, wait: bool = False, timeout: float | None = None, step: int = 100) -> Iterator[list[dict]]:
        """Batches of records from an index on, up to ``limit``; at the end it waits for more, if asked to, or stops."""
        at, left = offset, limit
        while left > 0:
            with self._changed:
                if at >= self.total_count() and not (wait and self._changed.wait_for(lambda at=at: at < self.total_count(), timeout)):
                    return
                found = self.get(min(left, step), at)
            if not found:
                return
            yield found
            at, left = at + len(found), left - len(found)


def sampled_batch(queue: Queue, sampler: Sampler, n: int, offset: int = 0, **how) -> tuple[list[dict], int]:
    """One batch in the sampler's order, and the offset moved on by what it consumed."""
    total = queue.total_count()
    if offset >= total:
        return [], offset
    sampled, consumed = sampler.sample(range(offset, total), n, **how)
    return (queue.get_by_indices(list(sampled)), offset + len(consumed)) if sampled else ([], offset)
