"""Approximate nearest vectors: an inverted file of clusters, searched in the clusters nearest to the query.

Centroids are fitted on a bounded sample chosen by hash; every row is then assigned to its nearest one and rows are
written in order of cluster, so that a search reads only the row groups of the clusters it probes. Distances within
these are exact. A search of all clusters equals the exact one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import search

#: Bounds of the fit: rows sampled in all and for each centroid, centroids, and rounds.
SAMPLE_ROWS, ROWS_PER_CENTROID, MAX_CENTROIDS, ROUNDS = 100_000, 64, 4096, 12
BLOCK = 4096


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of each point's nearest centroid, in blocks that bound the distance matrix."""
    squares = (centroids**2).sum(1)
    return np.concatenate([np.argmin(squares - 2 * points[i : i + BLOCK] @ centroids.T, axis=1) for i in range(0, len(points), BLOCK)] or [np.empty(0, dtype=np.int64)])


def _unit(points: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(points, axis=-1, keepdims=True)
    return points / np.where(length > 0, length, 1.0)


def usable(vector: Column, dim: int) -> Column:
    """Vectors of the index's dimension without null or non-finite components; others have no place in it."""
    return (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def fit(rows: DataFrame, dim: int, partitions: int | None = None, metric: str = "l2", vector_col: str = "embedding", id_col: str = "vec_id") -> np.ndarray:
    """Centroids: ceil(sqrt(rows)) of them unless given, never more than the sample can carry."""
    good = rows.where(usable(F.col(vector_col), dim))
    total = good.count()
    k = max(1, min(partitions or math.ceil(math.sqrt(total)), MAX_CENTROIDS))
    wanted = min(SAMPLE_ROWS, k * ROWS_PER_CENTROID)
    sample = good.select(F.xxhash64(id_col).alias("h"), F.col(vector_col).alias("v")).orderBy("h", F.col("v")).limit(wanted).toPandas()  # at most SAMPLE_ROWS rows
    points = np.array(sample["v"].tolist(), dtype=np.float64).reshape(len(sample), dim)
    if metric != "l2":
        points = _unit(points)
    k = min(k, max(1, len(points)))
    if not len(points):
        return np.zeros((1, dim))
    centroids = points[:k].copy()
    for _ in range(ROUNDS):
        cluster = _nearest(points, centroids)
        sizes = np.bincount(cluster, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cluster, points)
        moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray, metric: str = "l2", vector_col: str = "embedding") -> DataFrame:
    """All usable rows with their ``cluster``; the centroids, at most MAX_CENTROIDS, go to each task."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def cluster(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            points = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), shared.value.shape[1])
            yield pd.Series(_nearest(points if metric == "l2" else _unit(points), shared.value), dtype="int32")

    good = rows.where(usable(F.col(vector_col), centroids.shape[1]))
    return good.withColumn("cluster", F.pandas_udf(cluster, T.IntegerType())(vector_col))


class Index:
    """Rows with their cluster, and the centroids; saved, the rows are in order of cluster under ``path``/rows."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, metric: str = "l2", vector_col: str = "embedding", id_col: str = "vec_id"):
        self.rows, self.centroids, self.metric, self.vector_col, self.id_col = rows, centroids, metric, vector_col, id_col

    @classmethod
    def over(cls, rows: DataFrame, dim: int, partitions: int | None = None, metric: str = "l2", vector_col: str = "embedding", id_col: str = "vec_id") -> Index:
        """An index that is not written."""
        centroids = fit(rows, dim, partitions, metric, vector_col, id_col)
        return cls(assign(rows, centroids, metric, vector_col), centroids, metric, vector_col, id_col)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        saved = spark.read.parquet(f"{path}/centroids").orderBy("cluster").collect()  # at most MAX_CENTROIDS
        return cls(spark.read.parquet(f"{path}/rows"), np.array([json.loads(r["centroid"]) for r in saved]), saved[0]["metric"], saved[0]["vector_col"], saved[0]["id_col"])

    def save(self, path: str) -> Index:
        """Write rows and centroids and return the index over the written rows."""
        spark = self.rows.sparkSession
        # ranged by cluster and id: a cluster with most rows is cut by id
        self.rows.repartitionByRange("cluster", self.id_col).sortWithinPartitions("cluster", self.id_col).write.mode("overwrite").parquet(f"{path}/rows")
        saved = [(k, json.dumps(c.tolist()), self.metric, self.vector_col, self.id_col) for k, c in enumerate(self.centroids)]
        spark.createDataFrame(saved, "cluster int, centroid string, metric string, vector_col string, id_col string").write.mode("overwrite").parquet(f"{path}/centroids")
        return Index.open(spark, path)

    def probes(self, query: Sequence[float], nprobes: int) -> list[int]:
        point = np.asarray(query, dtype=np.float64)
        if len(point) != self.centroids.shape[1]:
            raise ValueError(f"the index holds vectors of {self.centroids.shape[1]} components")
        point = point if self.metric == "l2" else _unit(point)
        return np.argsort(((self.centroids - point) ** 2).sum(1), kind="stable")[:nprobes].tolist()

    def search(self, query: Sequence[float], k: int, nprobes: int = 20, where: Column | None = None) -> DataFrame:
        near = F.col("cluster").isin(self.probes(query, nprobes))
        return search.knn(self.rows.where(near), query, k, self.metric, self.vector_col, self.id_col, where)
