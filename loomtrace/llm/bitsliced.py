"""Exact top-k search (operator 3): a bit-sliced index.

Every component is quantised to an integer; over a block of vectors, slice b of attribute d is the
bitmap of bit b of that component (less the block's least value, so that all are non-negative).
A query's score is a sum of slices shifted by the query's own bits: the bitmaps of equal
significance are added by carry-save adders, bitmap-wise for 64 vectors at a time, which gives the
slices of the score. The top k are then selected from the most significant score slice downward: a
slice that leaves at least k candidates keeps those that have its bit, else these are taken and
the rest goes on. Vectors that tie at the boundary are resolved exactly, by the smaller id.

Vectors are dealt by hash into blocks, queries into groups; every group meets every block once, and a block's slices
are built once for a group of up to QUERY_ROWS queries. Each answers with at most k rows per query, which are merged per query.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors of different lengths do not meet; a query's own rows (equal id) are
no candidates, and a null id is neither a query nor a candidate; repeated rows are candidates each; repeated query rows (equal id and vector)
ask once, and different vectors of one id each ask, at every size of input, and have ranks from 1 of their own; fewer candidates than k give
fewer rows, and an empty table none. Scores are exact, also where sums go beyond 64 bits while they are added; quantised components and scores
beyond 64 bits are the least or largest long. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered

K = 5
SCALE = 256
BLOCK_ROWS = 16_384
QUERY_ROWS = 16_384
LEAST, MOST = -(2**63), 2**63 - 1


def _whole(x: Column) -> Column:
    """floor(x) as long, or the least or largest long."""
    return F.when(x >= float(2**63), F.lit(MOST)).when(x <= float(LEAST), F.lit(LEAST)).otherwise(F.floor(F.when(F.abs(x) < float(2**63), x)))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null unless all are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when((F.size(vector) > 0) & finite, F.transform(vector, lambda x: _whole(x.cast("double") * scale)))


class BitSlices:
    """Bit-sliced index over a block of integer vectors."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order].astype(np.int64)
        n, self.width = self.values.shape
        self.low = self.values.min(axis=0) if n else np.zeros(self.width, np.int64)
        raised = self.values.view(np.uint64) - self.low.view(np.uint64)  # wraps to the right difference
        self.bits = max(1, int(raised.max()).bit_length()) if n else 1
        self.words = -(-n // 64)
        self.full = np.zeros(self.words, np.uint64)
        self.full.view(np.uint8)[:] = self._pack(np.ones((1, n), np.uint8))[0].view(np.uint8)
        self.slices = np.stack([self._pack(((raised >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T) for b in range(self.bits)], axis=1)

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        packed = np.packbits(rows, axis=1, bitorder="little")
        out = np.zeros((rows.shape[0], self.words * 8), np.uint8)
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the bits of sum |q_d| * (v_d - low_d), or of its complement part where q_d < 0, least significant first."""
        levels: list[list[np.ndarray]] = [[] for _ in range(160)]
        size = np.where(query < 0, ~query.view(np.uint64) + np.uint64(1), query.view(np.uint64))
        for sign in (1, -1):
            for j in range(int(size.max()).bit_length() if len(size) else 0):
                at = np.nonzero((np.sign(query) == sign) & ((size >> np.uint64(j)) & np.uint64(1) == 1))[0]
                if len(at):
                    for b in range(self.bits):
                        picked = self.slices[at, b]
                        levels[b + j].append(picked if sign > 0 else self.full & ~picked)
        out, w = [], 0
        while w < len(levels) and any(levels[k] for k in range(w, len(levels))):
            if levels[w]:
                stack = np.concatenate(levels[w]) if len(levels[w]) > 1 else levels[w][0]
                while len(stack) > 1:
                    third = len(stack) // 3
                    if third:
                        a, b, c, rest = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third], stack[3 * third :]
                        half = a ^ b
                        carry = (a & b) | (half & c)
                        half ^= c
                        stack = np.concatenate([half, rest]) if len(rest) else half
                    else:
                        carry = (stack[0] & stack[1])[None]
                        stack = (stack[0] ^ stack[1])[None]
                    levels[w + 1].append(carry)
                out.append(stack[0])
            else:
                out.append(np.zeros(self.words, np.uint64))
            w += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best vectors but those of the query's id."""
        alive = self.full.copy()
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        for i in range(own.start, own.stop):
            alive[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sure, need = np.zeros(self.words, np.uint64), k
        for bitmap in reversed(self.score_slices(query)):
            with_bit = alive & bitmap
            count = int(np.bitwise_count(with_bit).sum())
            if count >= need:
                alive = with_bit
            else:
                sure |= with_bit
                need -= count
                alive &= ~bitmap
        rows = self._rows(sure)
        if need:
            rows = np.concatenate([rows, self._rows(alive)[:need]])  # ties, in the order of their ids
        most = float(np.abs(query.astype(np.float64)).sum()) * float(np.abs(self.values[rows].astype(np.float64)).max(initial=0))
        if most < 2.0**62:
            return self.ids[rows], self.values[rows] @ query
        exact = self.values[rows].astype(object) @ query.astype(object)
        return self.ids[rows], np.array([min(max(x, LEAST), MOST) for x in exact], np.int64)

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        some = np.nonzero(bitmap)[0]
        if not len(some):
            return some
        bits = np.unpackbits(bitmap[some].view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return some[word] * 64 + bit


def _matrix(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """(ids, values, rows) for each length of vector."""
    lengths = rows["v"].map(len)
    for _, part in rows.groupby(lengths, sort=True):
        yield part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.int64), part


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``queries`` holds, the k best by integer inner product."""
    held, name = numbered(vectors.select("*", queries.alias("asks")))
    base = held.select(F.col(name[id_col]).cast("long").alias("id"), F.col(held.columns[-1]).alias("asks"), quantised(F.col(name[vector_col]), scale).alias("v"))
    base = base.where("v is not null and id is not null")
    n, asking = base.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-asking // QUERY_ROWS))
    spread = F.xxhash64("id", "v")
    # equal candidates are dealt apart by their partition and place, so that no block holds all copies of one
    dealt = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(blocks)).cast("long").alias("b")
    index = base.select("id", "v", dealt, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    asked = base.where("asks").select("id", "v").distinct().withColumn("q", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).cast("string"))
    asked = asked.select("id", "v", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(spread, F.lit(groups)).cast("int").alias("g"))

    def answer(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        indexes = {values.shape[1]: BitSlices(ids, values) for ids, values, _ in _matrix(block)} if len(block) and len(asked) else {}
        for ids, values, rows in _matrix(asked) if indexes else ():
            if index := indexes.get(values.shape[1]):
                for i, q, vector in zip(ids, rows["q"], values, strict=True):
                    found, scores = index.top(int(i), vector, k)
                    out.append(pd.DataFrame({"query_id": i, "q": q, "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "q": "str", "vec_id": "int64", "score": "int64"})

    found = index.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInPandas(answer, "query_id long, q string, vec_id long, score long")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
