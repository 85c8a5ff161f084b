"""Search: exact nearest vectors, BM25 over text, and vectors within text matches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import Manifests

K1, B = 1.2, 0.75
TOKEN = r"[^\p{L}\p{N}]+"


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: Sequence[float], metric: str) -> Column:
    """Smaller is nearer: squared l2, one minus cosine, or one minus the dot product."""
    q = F.array(*(F.lit(float(x)) for x in query))
    if metric == "l2":
        return F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "dot":
        return 1.0 - _product(vector, q)
    if metric == "cosine":
        return 1.0 - _product(vector, q) / (F.sqrt(_product(vector, vector)) * F.sqrt(F.lit(sum(float(x) ** 2 for x in query))))
    raise ValueError(f"unknown metric {metric!r}")


def knn(rows: DataFrame, query: Sequence[float], k: int, metric: str = "l2", vector_col: str = "embedding", id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest rows; a filter is applied first, ties go to the smaller id."""
    rows = rows.where(F.size(vector_col) == len(query))
    if where is not None:
        rows = rows.where(where)
    return rows.select("*", distance(F.col(vector_col), query, metric).alias("_distance")).orderBy("_distance", id_col).limit(k)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN), lambda t: t != "")


def _times(text: Column, term: str) -> Column:
    """How often a term (letters and digits) is a token of a lower-case text; texts without it are not searched by pattern."""
    whole = rf"(?<![\p{{L}}\p{{N}}]){term}(?![\p{{L}}\p{{N}}])"
    return F.when(F.contains(text, F.lit(term)), F.regexp_count(text, F.lit(whole))).otherwise(0)


def _score(tf: Column, df: Column, n: Column, docs: Column, mean: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def bm25(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """id and score of documents with any of the terms, or of the k best ones (ties to the smaller id), without an index.

    Terms and tokens are counted in the text where it stands; no token is shuffled. A term that is no token finds nothing.
    """
    terms = [t for t in dict.fromkeys(terms) if t.isalnum()]
    if not terms:
        return docs.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    lower = docs.select(F.col(id_col), F.lower(text_col).alias("t"))
    counted = lower.select(id_col, F.coalesce(F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")), F.lit(-1)).alias("n"), *(_times(F.col("t"), x).alias(f"tf{i}") for i, x in enumerate(terms)))
    total = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    score = sum((_score(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("docs"), F.col("mean")) for i in range(len(terms))), F.lit(0.0))
    hit = sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    found = counted.where(hit).join(F.broadcast(total)).select(id_col, score.alias("score"))  # totals are one row
    return found if k is None else found.orderBy(F.desc("score"), id_col).limit(k)


class TextIndex:
    """An inverted index: (term, id, tf, n) in order of term, so that a search reads the row groups of its terms only.

    Documents are added as segments of their own; ``rebuild`` writes them as one. A segment also keeps its number of documents and of tokens,
    and documents can be deleted by id: their rows are left out of every search and of the counts.
    """

    SEGMENT = "term string, id long, tf long, n long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._log, self.path = spark, Manifests(spark, path), path.rstrip("/")

    def _body(self) -> dict:
        return self._log.last()[1] or {"segments": [], "deletes": []}

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Index documents; an id that is there already is replaced (what was deleted or replaced before stays so in its own segment)."""
        number, body = self._log.last()
        body = body or {"segments": [], "deletes": []}
        name = uuid.uuid4().hex
        held = docs.select(F.col(id_col).cast("long").alias("id"), tokens(F.col(text_col)).alias("w"))
        rows = held.select("id", F.size("w").cast("long").alias("n"), F.explode_outer("w").alias("term")).groupBy("term", "id").agg(F.count("term").alias("tf"), F.first("n").alias("n"))
        rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").select("term", "id", "tf", "n").write.parquet(f"{self.path}/{name}")
        docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.size(tokens(F.col(text_col))), F.lit(0)).cast("long").alias("n")).write.parquet(f"{self.path}/{name}-ids")
        self._log.publish(number, {"segments": [*body["segments"], name], "deletes": body["deletes"]})

    def delete(self, ids: DataFrame) -> None:
        """Leave out documents (``id``) of all segments that are there now."""
        number, body = self._log.last()
        name = uuid.uuid4().hex
        ids.select(F.col("id").cast("long").alias("id")).distinct().write.parquet(f"{self.path}/{name}")
        self._log.publish(number, {"segments": body["segments"], "deletes": [*body["deletes"], [name, len(body["segments"])]]})

    def _live(self, kind: str) -> DataFrame:
        """Rows (``kind`` is "" or "-ids") of the segments without those that a later segment or a deletion has put out."""
        body, out = self._body(), None
        ids = [self.spark.read.schema("id long, n long").parquet(f"{self.path}/{s}-ids") for s in body["segments"]]
        for i, s in enumerate(body["segments"]):
            rows = self.spark.read.schema("id long, n long" if kind else self.SEGMENT).parquet(f"{self.path}/{s}{kind}")
            later = [x.select("id") for x in ids[i + 1 :]] + [self.spark.read.schema("id long").parquet(f"{self.path}/{d}") for d, before in body["deletes"] if i < before]
            for gone in later:
                rows = rows.join(gone, "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "id long, n long" if kind else self.SEGMENT)

    def search(self, terms: Sequence[str], k: int = 10) -> DataFrame:
        """id and score of the k best documents with any of the terms."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        hits = self._live("").where(F.col("term").isin(terms))
        frequency = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
        total = self._live("-ids").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
        scored = hits.join(F.broadcast(frequency), "term").join(F.broadcast(total)).groupBy("id").agg(F.sum(_score(F.col("tf"), F.col("df"), F.col("n"), F.col("docs"), F.col("mean"))).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)

    def list(self) -> list[str]:
        return list(self._body()["segments"])

    def rebuild(self) -> None:
        """Write all segments as one, without what was deleted or replaced."""
        number, _ = self._log.last()
        name = uuid.uuid4().hex
        self._live("").repartitionByRange("term", "id").sortWithinPartitions("term", "id").select("term", "id", "tf", "n").write.parquet(f"{self.path}/{name}")
        self._live("-ids").write.parquet(f"{self.path}/{name}-ids")
        self._log.publish(number, {"segments": [name], "deletes": []})

    def drop(self) -> None:
        self._log.delete()


def hybrid(docs: DataFrame, vectors: DataFrame, terms: Sequence[str], query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
    """Nearest vectors among rows whose text holds any of the terms; scores are not fused."""
    words = tokens(F.col("text"))
    hits = docs.where(F.exists(words, lambda t: t.isin(*terms))).select(F.col("doc_id").alias("vec_id"))
    return knn(vectors.join(hits, "vec_id", "left_semi"), query, k, metric)
