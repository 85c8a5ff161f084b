"""Partitioned tables: value and hash partitions, upsert, update, delete, new columns.

A table is Parquet in folders that the last of its numbered manifests lists, so a reader sees either all of a change or
none of it, an append adds a folder, and of two writers one is told to start anew.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifests import Conflict, Manifests


@F.pandas_udf(T.LongType())
def _text_hash(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8).digest(), "big", signed=True))


def stable_bucket(column: str, kind: str, buckets: int) -> Column:
    """Integers stand for themselves, strings are BLAKE2b of 8 bytes; the remainder is not negative."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.pmod(F.col(column).cast("long"), F.lit(buckets))
    high = F.pmod(_text_hash(column), F.lit(buckets))
    # the digest is unsigned: a negative long stands for itself plus 2**64
    return F.when(_text_hash(column) < 0, F.pmod(high + (2**64 % buckets), F.lit(buckets))).otherwise(high)


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those of equal keys; others are added."""
    return rows.join(changes, keys, "left_anti").unionByName(changes)


def update(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return rows.select(*(F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns))


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition does not hold, those where it is null included."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def add_columns(rows: DataFrame, **expressions: str) -> DataFrame:
    return rows.withColumns({name: F.expr(text) for name, text in expressions.items()})


_TOKEN = re.compile(r"\s*(?:(?P<op><=|>=|<>|!=|=|<|>)|(?P<text>'(?:[^']|'')*')|(?P<word>[A-Za-z_0-9.]+)|(?P<mark>[(),]))")


def partition_matches(condition: str, column: str, value: str) -> bool:
    """Whether a partition's value fits a condition of AND, OR, IN and comparisons, as strings; anything else does not."""
    tokens, at = [], 0
    while at < len(condition.rstrip()):
        if not (m := _TOKEN.match(condition, at)):
            return False
        tokens.append((m.lastgroup, m[m.lastgroup])), (at := m.end())
    compare = {"=": str.__eq__, "<>": str.__ne__, "!=": str.__ne__, "<": str.__lt__, "<=": str.__le__, ">": str.__gt__, ">=": str.__ge__}

    def take(kind: str | None = None, text: str | None = None) -> str | None:
        if tokens and (kind is None or tokens[0][0] == kind) and (text is None or tokens[0][1].upper() == text):
            return tokens.pop(0)[1]
        return None

    def operand() -> str:
        if (t := take("text")) is not None:
            return t[1:-1].replace("''", "'")
        if (w := take("word")) is None:
            raise ValueError
        return value if w == column else w

    def factor() -> bool:
        if take("mark", "("):
            inner = either()
            if not take("mark", ")"):
                raise ValueError
            return inner
        left = operand()
        if take("word", "IN"):
            if not take("mark", "("):
                raise ValueError
            items = [operand()]
            while take("mark", ","):
                items.append(operand())
            if not take("mark", ")"):
                raise ValueError
            return left in items
        op = take("op")
        if op is None:
            raise ValueError
        return compare[op](left, operand())

    def both() -> bool:
        out = factor()
        while take("word", "AND"):
            out = factor() and out
        return out

    def either() -> bool:
        out = both()
        while take("word", "OR"):
            out = both() or out
        return out

    try:
        found = either()
        return found and not tokens
    except ValueError:
        return False


def matching_partitions(values: DataFrame, column: str, condition: str) -> DataFrame:
    """The partition values (one row each) that fit a condition; nothing is brought to the driver."""
    fits = F.pandas_udf(lambda v: v.map(lambda x: x is not None and partition_matches(condition, column, str(x))), T.BooleanType())
    return values.where(fits(F.col(column)))


def ordered_concat(rows: DataFrame, partition: str, order: str, limit: int, ascending: bool = True) -> DataFrame:
    """Partitions one after the other, each sorted by ``order``; the limit runs across them."""
    key = F.asc(order) if ascending else F.desc(order)
    return rows.orderBy(partition, key, *[c for c in rows.columns if c not in (partition, order)]).limit(limit)


#: How often an append starts anew when other writers were first.
ATTEMPTS = 20


class Table:
    """A table in a folder; ``partition`` is None, ("value", column) or ("hash", column, buckets)."""

    def __init__(self, spark: SparkSession, path: str, partition: tuple | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self._log = Manifests(spark, path)

    def current(self) -> str | None:
        """A name of the table's present state; None before the first write."""
        number, body = self._log.last()
        return None if body is None else str(number)

    def exists(self) -> bool:
        return self.current() is not None

    def _last(self) -> tuple[int, dict]:
        number, body = self._log.last()
        if body is None:
            raise FileNotFoundError(self.path)
        return number, body

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._last()[1]["schema"]))

    def _rows(self, body: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(body["schema"]))
        if not body["parts"]:
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.schema(schema).option("basePath", f"{self.path}/parts")
        return held.parquet(*(f"{self.path}/parts/{p}" for p in body["parts"])).select(*(F.col(f"`{c}`") for c in schema.names))

    def read(self) -> DataFrame:
        """The current rows, in the columns and types they were given in, even when there are none."""
        return self._rows(self._last()[1])

    def partitions(self) -> list[str]:
        """Values of the partition column, as text, from the folders' names alone."""
        if not self.partition or self.partition[0] != "value":
            raise ValueError("not partitioned by value")
        found, (_, body) = set(), self._last()
        for part in body["parts"]:
            where, fs = self._log.at(f"parts/{part}")
            found |= {n.split("=", 1)[1] for s in fs.listStatus(where) if (n := s.getPath().getName()).startswith(f"{self.partition[1]}=")}
        return sorted(unquote(v) for v in found)

    def _write(self, rows: DataFrame) -> str:
        """Write a folder that no manifest names yet."""
        part = f"__part={uuid.uuid4().hex}"  # read as one table, whatever the partition
        writer = rows.write
        if self.partition and self.partition[0] == "hash":
            _, column, buckets = self.partition
            tagged = rows.withColumn("__bucket", stable_bucket(column, dict(rows.dtypes)[column], buckets))
            writer = tagged.hint("rebalance", "__bucket").write.partitionBy("__bucket")  # adaptive execution cuts a large bucket into several files
        elif self.partition:
            writer = rows.hint("rebalance", self.partition[1]).write.partitionBy(self.partition[1])
        writer.parquet(f"{self.path}/parts/{part}")
        return part

    def create(self, rows: DataFrame, mode: str = "create") -> None:
        """Make the table; ``create`` fails if there is one, ``overwrite`` replaces it, ``exist_ok`` leaves it as it is."""
        if mode not in ("create", "overwrite", "exist_ok"):
            raise ValueError(f"unknown mode {mode!r}")
        if self.exists() and mode != "overwrite":
            if mode == "create":
                raise FileExistsError(self.path)
            return
        self.replace(rows)

    def replace(self, rows: DataFrame, after: int | None = None) -> None:
        """Make ``rows`` the table; a Conflict if another writer was first since ``after`` (the present state, if not given)."""
        after = self._log.last()[0] if after is None else after
        self._log.publish(after, {"parts": [self._write(rows)], "schema": rows.schema.json()})

    def add(self, rows: DataFrame) -> None:
        """Append rows in a folder of their own; nothing that is there is written again."""
        number, body = self._log.last()
        if body is None:
            return self.replace(rows, 0)
        schema = T.StructType.fromJson(json.loads(body["schema"]))
        part = self._write(rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields)))
        for _ in range(ATTEMPTS):
            try:
                self._log.publish(number, {"parts": [*body["parts"], part], "schema": body["schema"]})
                return None
            except Conflict:
                number, body = self._last()
                if T.StructType.fromJson(json.loads(body["schema"])) != schema:
                    raise
        raise Conflict(f"{ATTEMPTS} attempts")

    def _change(self, make) -> None:
        """Replace the rows by a function of them, started anew if another writer was first."""
        for _ in range(ATTEMPTS):
            number, body = self._last()
            try:
                return self.replace(make(self._rows(body)), number)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} attempts")

    def upsert(self, changes: DataFrame, keys: list[str]) -> None:
        self._change(lambda rows: upsert(rows, changes, keys))

    def update(self, condition: Column, **values: Column) -> None:
        self._change(lambda rows: update(rows, condition, **values))

    def delete(self, condition: Column) -> None:
        self._change(lambda rows: delete(rows, condition))

    def add_columns(self, **expressions: str) -> None:
        self._change(lambda rows: add_columns(rows, **expressions))

    def optimize(self) -> int:
        """Write many folders as one; returns how many there were. Rows and their types stay."""
        number, body = self._last()
        if len(body["parts"]) > 1:
            self.replace(self._rows(body), number)
        return len(body["parts"])

    def vacuum(self) -> int:
        """Delete folders that the last manifest does not name; not to be run beside writers."""
        gone = self._log.unnamed("parts", set(self._last()[1]["parts"]))
        for name in gone:
            self._log.delete(name)
        return len(gone)

    def drop(self) -> None:
        self._log.delete()

    def count_rows(self, condition: str | None = None) -> int:
        rows = self.read()
        return (rows.where(condition) if condition else rows).count()

    def filter(self, condition: str | None = None, columns: list[str] | None = None, order: str | None = None, limit: int | None = None, offset: int = 0, ascending: bool = True) -> DataFrame:
        """Rows that fit, in the columns asked for; conditions on a value partition prune its folders at the scan."""
        rows = self.read()
        rows = rows.where(condition) if condition else rows
        if order:
            rows = rows.orderBy(F.asc(order) if ascending else F.desc(order))
        rows = rows.offset(offset) if offset else rows
        rows = rows if limit is None else rows.limit(limit)
        return rows.select(*columns) if columns else rows

    def to_pandas(self, max_rows: int = 100_000) -> pd.DataFrame:
        """All rows; more than ``max_rows`` are an error, not a cut."""
        found = self.read().limit(max_rows + 1).toPandas()
        if len(found) > max_rows:
            raise ValueError(f"more than {max_rows} rows")
        return found


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables in a folder."""
    log = Manifests(spark, root)
    where, fs = log.at("x")
    where = where.getParent()
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory() and Manifests(spark, s.getPath().toString()).last()[1] is not None)
