"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: A key is hot if it holds at least this share of all rows, so at most 1000 keys are.
HOT_SHARE = 1000
#: Bits of a sieve: at most SIEVE_BITS / 32768 bitmaps of 4 KB, 8 MB in all, are broadcast.
SIEVE_BITS = 1 << 26
#: Rows, and bytes, of texts that go to a Python worker at a time; a batch of the default 10,000 rows of long texts needs hundreds of MB there.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, a local one if all runs in one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomtrace-"))
    return spark.sparkContext.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Bound the batches in which the session sends rows to Python, unless it has smaller ones."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)([KMGT]?)I?B?", spark.conf.get(name).upper()).groups()
        if not 0 < int(number) * 1024 ** " KMGT".index(unit or " ") <= most:
            spark.conf.set(name, str(most))


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs a reread."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named c0, c1, ... and the new name of each old one, so that no name of an input clashes with one made here.

    A name is found as it is written, or else whatever its case.
    """
    places = {c: f"c{k}" for k, c in reversed(list(enumerate(df.columns)))}
    lower = {c.lower(): p for c, p in reversed(list(places.items()))}

    class Places(dict):
        def __missing__(self, name: str) -> str:
            return lower[name.lower()]

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), Places(places)


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted and has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sieved(rows: DataFrame, key: Column, keys: DataFrame, among: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have their ``key`` (a long) among those of ``keys``, and the rows that surely have not.

    The keys become a bitmap of SIEVE_BITS bits, so what is broadcast has a fixed bound; the first part still needs
    its exact join, and the second need not be shuffled for it. ``rows`` is read once for each part.
    """
    place = lambda c: F.pmod(c, F.lit(SIEVE_BITS)) + 1
    maps = materialise(
        keys.select(place(among).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("sieve_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("sieve_map"))
    )
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substr("sieve_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1, F.lit(False))
    marked = rows.withColumn("sieve_bucket", F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), "sieve_bucket", "left").withColumn("sieve_met", met)
    return tuple(marked.where(at).drop("sieve_bucket", "sieve_map", "sieve_met") for at in (F.col("sieve_met"), ~F.col("sieve_met")))


def join_keyed(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of ``keys`` and, in ``count``, how many of ``total`` rows have it.

    Hot keys, those of at least 1/HOT_SHARE of all rows, are at most HOT_SHARE rows of the table and are broadcast, so the rows
    of a hot key stay where they are; the others are joined by shuffle. ``rows`` should be materialised, as both joins read it.
    """
    hot = F.broadcast(table.where(F.col(count) * HOT_SHARE >= total))
    cold = table.where(F.col(count) * HOT_SHARE < total)
    names = list(keys)
    return rows.join(hot, names).unionByName(rows.join(hot.select(*names), names, "left_anti").join(cold, names))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v) by alternating large-star and small-star rounds.

    Returns (u, root) for every node but the roots, which are the smallest node of each component.
    Every round is two aggregations and two joins on node keys; hubs are pre-aggregated, and their edges are not brought to one task.
    """
    e = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            return e.select("u", F.col("v").alias("root"))
        mark = seen
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = join_keyed(both.where("v > u"), low, ["u"], "k", 2 * seen[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = materialise(
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
