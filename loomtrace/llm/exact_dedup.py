"""Exact dedup (operator 5): deterministic block naming, in DataFrame operations only.

A text is normalised by deleting ``[\\x20\\x09-\\x0D]`` and cut into blocks of a fixed number of
code points. The distinct blocks are sorted, and a block's place in that order is its integer name;
then adjacent pairs of names are sorted and named in the same way, until one name is left. Two texts
of equal length have the same last name if and only if they are equal: names are dense places, the same in each run, and
two different blocks never share one. Blocks are ordered by their first characters and a hash before their whole
text, so that what is sampled to cut the order into ranges is short; the hash only orders.
Texts whose (length, first characters) nobody shares are their own group and are named no further. The first pass keeps
a small row per text; only texts that share these are read again.

Edge cases: null counts as empty; all empty texts are one group; a null doc_id comes last among
equally long originals; of rows that tie in all of this any one stays; repeated rows are rows of their own, of which one stays;
a very long text has many blocks, in rows of their own; an empty table gives no rows; other columns and clashing names in the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_keyed, materialise, numbered, sieved

#: What normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"
BLOCK_CHARS = 2048
HEAD_CHARS = 64
#: Characters of a block by which the order is cut into ranges.
START_CHARS = 12


def _named(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows`` with ``name``: the place of their keys among the sorted distinct keys."""
    text = dict(rows.dtypes)[keys[0]] == "string"
    order = [F.substring(keys[0], 1, START_CHARS), F.xxhash64(keys[0])] if text else [F.col(k) for k in keys]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("held"))
    sorted_ = counted.repartitionByRange(*order).sortWithinPartitions(*order, *keys)
    placed = materialise(sorted_.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # one row per partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    names = placed.withColumn("part", part).join(F.broadcast(before), "part")
    names = names.select(*keys, "held", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("name"))
    return join_keyed(rows, names, keys, "held", total).drop("held")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    held, name = numbered(docs)
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    base = held.select(F.col(name[id_col]).alias("id"), text.alias("text")).select("id", F.char_length("text").alias("n_orig"), F.translate("text", BLANKS, "").alias("norm"))
    base = base.select("*", F.char_length("norm").alias("n"), F.substring("norm", 1, HEAD_CHARS).alias("head"))
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    known = materialise(base.select("id", "n", "head", sha))  # no texts
    total = known.count()
    heads = materialise(known.groupBy("n", "head").agg(F.count("*").alias("held")).withColumn("key", F.xxhash64("n", "head")))
    shared = heads.where("held > 1").drop("key")
    hot = F.broadcast(shared.where(F.col("held") * HOT_SHARE >= total))  # at most HOT_SHARE rows
    alone = known.join(hot, ["n", "head"], "left_anti").join(shared, ["n", "head"], "left_anti").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    maybe, _ = sieved(base.withColumn("key", F.xxhash64("n", "head")), F.col("key"), heads.where("held > 1"), F.col("key"))
    rest = materialise(join_keyed(materialise(maybe.select("id", "n_orig", "n", "head", "norm")), shared, ["n", "head"], "held", total).select("id", "n_orig", "n", sha, "norm").withColumn("row", F.monotonically_increasing_id()))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_chars)).cast("int")
    cut = rest.select("row", "n", blocks.alias("left"), F.posexplode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.substring(F.col("norm"), i * block_chars + 1, F.lit(block_chars)))).alias("at", "block"))
    count, most = rest.agg(F.sum(blocks), F.max(blocks)).first()
    most = most or 1
    level = materialise(_named(cut, count or 0, "block").select("row", "n", "left", "at", "name"))
    done = level.where("left = 1").select("row", "n", "name")
    while most > 1:
        pairs = (
            level.where("left > 1").groupBy("row", "n", "left", F.shiftright("at", 1).alias("pair"))
            .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = materialise(pairs)
        level = materialise(_named(pairs, pairs.count(), "a", "b").select("row", "n", F.shiftright(F.col("left") + 1, 1).alias("left"), F.col("pair").alias("at"), "name"))
        done = done.unionAll(level.where("left = 1").select("row", "n", "name"))
        most = (most + 1) // 2
    who = materialise(rest.select("row", "id", "n_orig", "sha").join(done, "row"))
    stays = materialise(who.groupBy("n", "name").agg(F.count("*").alias("group_size"), F.min(F.struct(-F.col("n_orig"), F.col("id").isNull(), F.col("id"), F.col("row"))).alias("best")))
    grouped = join_keyed(who, stays, ["n", "name"], "group_size", total).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(grouped)
