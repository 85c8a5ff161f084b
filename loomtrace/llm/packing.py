"""Best-fit packing (operator 4): conflict-constrained best fit.

Documents are cut into pieces of at most the capacity in words and packed in blocks of pieces, the larger
pieces first. Open bins stand in order of what they have left; a bin carries a bitmap of the
sources and one of the duplicate clusters in it. For a piece, the successor search starts at the least
residual that holds it and goes on to larger ones until a bin has neither its source nor its cluster:
the tightest compatible bin. Bins of one residual and equal bitmaps stand together, so a run of
bins that all conflict costs one look. If none fits, a bin is opened.

Blocks are dealt by hash and bounded, and no text is shipped: only sizes and keys. A duplicate cluster is, unless ``cluster``
says otherwise, a group of texts equal but for blanks (near copies are another operator's: pass its class).

Edge cases: null or empty text is a piece of 0 words; a null source is a source of its own; pieces of one
document conflict with each other as its cluster does; repeated rows are duplicates of each other, and many of them are dealt over
many blocks; of equally large pieces the one of lesser hash is packed first; a very long text is many pieces; an
empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, small, words

CAPACITY = 2048
BLOCK_PIECES = 4096
#: What does not count when two texts are compared.
BLANKS = " \t\n\x0b\x0c\r"


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[int]:
    """Bin of each piece, taken in the given order; two pieces whose masks share a bit never meet in one bin."""
    shelves: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> bitmap of conflicts -> bins
    filled = 0  # bit r: some bin has residual r
    out, bins = [], 0
    for size, mask in zip(sizes, masks, strict=True):
        at, rest, found = size, filled >> size, None
        while rest and found is None:
            step = (rest & -rest).bit_length() - 1
            residual = at + step
            found = min(((heap[0], key) for key, heap in shelves[residual].items() if not key & mask), default=None)
            at, rest = residual + 1, rest >> (step + 1)
        if found is None:
            number, key, residual = bins, 0, capacity
            bins += 1
        else:
            number, key = found
            heap = shelves[residual][key]
            heapq.heappop(heap)
            if not heap:
                del shelves[residual][key]
                if not shelves[residual]:
                    filled &= ~(1 << residual)
        residual -= size
        heapq.heappush(shelves[residual].setdefault(key | mask, []), number)
        filled |= 1 << residual
        out.append(number)
    return out


def _pack(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sources, _ = pd.factorize(rows["source"], use_na_sentinel=False)
        clusters, _ = pd.factorize(rows["cluster"])
        often = np.bincount(clusters) > 1  # a cluster with one piece here cannot conflict
        names = {c: i for i, c in enumerate(np.nonzero(often)[0])}
        width = int(sources.max(initial=-1)) + 1
        masks = [(1 << int(s)) | (1 << (width + names[c]) if often[c] else 0) for s, c in zip(sources, clusters, strict=True)]
        number = np.array(best_fit(rows["size"].tolist(), masks, capacity), np.int64)
        offset = rows.groupby(number)["size"].cumsum() - rows["size"]
        return pd.DataFrame({"id": rows["id"], "piece": rows["piece"], "size": rows["size"], "block": rows["block"], "bin": number, "at": offset})

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, cluster: Column | None = None, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """doc_id, piece, first_word, size, bin_id, bin_at for every piece of every row."""
    held, name = numbered(docs if cluster is None else docs.select("*", cluster.alias("cluster")))
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    same = F.xxhash64(F.translate(text, BLANKS, "")) if cluster is None else F.col(held.columns[-1])
    base = held.select(F.col(name[id_col]).alias("id"), F.col(name[source_col]).alias("source"), same.alias("cluster"), words(F.col(name[text_col])).alias("n"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    cut = base.withColumn("row", F.monotonically_increasing_id())
    cut = cut.select("id", "source", "cluster", "n", "row", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    cut = cut.withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long")).withColumn("order", F.xxhash64("id", "n", "cluster"))
    cut = materialise(cut)
    blocks = max(1, -(-cut.count() // block_pieces))
    # rows that are equal in all that counts would meet in one block: where they are many, they are dealt by their rows
    often = materialise(cut.groupBy("order", "piece").agg(F.count("*").alias("k")).where(F.col("k") > max(1, block_pieces // 16)))
    marked = cut.join(small(often.drop("k").withColumn("often", F.lit(True))), ["order", "piece"], "left")
    dealt = marked.withColumn("block", F.pmod(F.xxhash64("order", "piece", F.when(F.col("often"), F.col("row"))), F.lit(blocks)))
    dealt = dealt.select("id", "source", "cluster", "piece", "size", "order", "block")
    packed = dealt.groupBy("block").applyInPandas(_pack(capacity), "id long, piece int, size long, block long, bin long, at long")
    return packed.select(
        F.col("id").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), "size",
        F.concat_ws("-", "block", "bin").alias("bin_id"), F.col("at").alias("bin_at"),
    )
