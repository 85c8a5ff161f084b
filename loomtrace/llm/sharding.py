"""Sharding (operator 1): extendible hashing into shards under a byte limit.

A document's key is hashed to bits; shards are nodes of the binary trie over these bits, and the
directory maps hash prefixes to them. A bucket above the limit splits on its next bit, others stay as they are.
Since bytes can only fall with depth, a document's shard is the first prefix of its hash that fits;
prefixes of ``STEP`` depths are summed at a time, and only documents in buckets that are still
too large go on to the next depths. Bits come from the key, then, for rows of one key, from the
row's content. A bucket that no bit can split holds equal rows only; it is dealt into parts that
fit, so equal rows may part. One document above the limit is a shard of its own, marked oversized.

Edge cases: null text has no bytes; a null key hashes like an empty one; an empty table gives no
rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, numbered

LIMIT_BYTES = 1 << 20
STEP = 16
#: Hash bits from the key, then as many from the content.
KEY_BITS = CONTENT_BITS = 48


def _bits(value, n: int):
    return F.lpad(F.bin(F.conv(F.substring(F.md5(value), 1, n // 4), 16, 10).cast("long")), n, "0")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (its hash prefix), depth, shard_bytes, oversized for every row."""
    held, name = numbered(docs)
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    content = F.concat_ws("|", F.octet_length(text), F.xxhash64(text))
    at = held.select(
        F.col(name[id_col]).alias("id"), F.octet_length(text).cast("long").alias("n"),
        F.concat(_bits(F.coalesce(F.col(name[id_col]).cast("string"), F.lit("")), KEY_BITS), _bits(content, CONTENT_BITS)).alias("bits"),
    )
    done, low, left = None, 0, materialise(at)
    while True:
        high = min(low + STEP, KEY_BITS + CONTENT_BITS)
        cells = left.groupBy(F.substring("bits", 1, high).alias("cell")).agg(F.sum("n").alias("n"))
        spread = cells.select("n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"), "cell").select("n", F.substring(F.col("cell"), F.lit(1), F.col("d")).alias("prefix"))
        sums = spread.groupBy("prefix").agg(F.sum("n").alias("bytes"))
        # the directory: for each cell the first of its prefixes that fits
        fits = (
            cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d")).withColumn("prefix", F.substring(F.col("cell"), F.lit(1), F.col("d")))
            .join(sums.where(F.col("bytes") <= limit), "prefix")
            .groupBy("cell").agg(F.min(F.struct("d", "prefix", "bytes")).alias("leaf"))
        )
        found = left.withColumn("cell", F.substring("bits", 1, high)).join(fits, "cell", "left")
        placed = found.where("leaf is not null").select("id", "n", F.col("leaf.prefix").alias("shard"), F.col("leaf.d").alias("depth"), F.col("leaf.bytes").alias("shard_bytes"))
        done = placed if done is None else done.unionAll(placed)
        rest = found.where("leaf is null").select("id", "n", "bits")
        if rest.isEmpty():
            break
        left, low = materialise(rest), high
        if high == KEY_BITS + CONTENT_BITS:
            done = done.unionAll(_equal_rows(left, limit))
            break
    return done.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized")
    )


def _equal_rows(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal bits, dealt into numbered parts of as many as fit (one, if one is too large).

    Numbers come from per-partition counts and offsets, so that no bucket is brought to one task.
    """
    numbered = materialise(rows.select("id", "n", "bits", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
    counts = numbered.groupBy("bits", "p").agg(F.count("*").alias("k"))
    before = Window.partitionBy("bits").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bits", "p", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("bits", "p").orderBy("i")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n"), F.lit(1)))).cast("long")
    parts = numbered.withColumn("at", place).join(counts, ["bits", "p"]).select("id", "n", F.concat_ws(".", "bits", ((F.col("base") + F.col("at")) / each).cast("long")).alias("shard"))
    sums = parts.groupBy("shard").agg(F.sum("n").alias("shard_bytes"))
    return parts.join(sums, "shard").select("id", "n", "shard", F.lit(KEY_BITS + CONTENT_BITS).alias("depth"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write ``docs`` with a ``shard`` column as one folder per shard; equal ids must not stand in two shards."""
    where = shard(docs, id_col, text_col, limit).select(F.col(id_col).alias("shard_id"), F.col("shard").alias("shard_name")).distinct()
    joined = docs.join(where, docs[id_col].eqNullSafe(where["shard_id"])).drop("shard_id")
    joined.repartition("shard_name").write.partitionBy("shard_name").parquet(path)
