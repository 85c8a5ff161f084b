"""From raw documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of their input, whatever other columns it has. Nulls, empty and very long
texts, ties and repeated rows mean what the stage's operator says; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import cotraining, jaccard_join, line_dedup, mixing, packing
from loomtrace.llm.common import shared_dir


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with every column that is not one of DOCUMENT under a name that nothing else has."""
    return docs.toDF(*[c if c in DOCUMENT and c not in docs.columns[:k] else f"extra_{k}" for k, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-training accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain = _plain(docs)
    return cotraining.classify(plain, labels).where("accepted").select(*plain.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that stand in earlier ones; those of which nothing is left go.

    n_chars is counted anew where lines went; a document that was empty before stays.
    """
    plain = _plain(docs)
    cleaned = line_dedup.drop_repeats(plain)
    had = F.col("line_report.n_removed") > 0
    left = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) != ""
    count = F.when(had, F.char_length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in plain.columns else None
    return cleaned.where(~had | left).select(*[count if c == "n_chars" else F.col(c) for c in plain.columns]).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id; documents without words all stay."""
    return jaccard_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words as often as their source's whole passes."""
    return mixing.repeat(docs, F.array("source"))


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the bins they are packed in; columns of ``docs`` other than the id are not returned."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("mixing", mixture), ("best-fit packing", bins)]

#: Co-training cannot be expressed in SQL. Tests hold stages 2 to 5 against plain Python versions and the first against held-out labels.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the session's file systems keep it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``.

    What stands between stages goes to the shared folder and is deleted once the next stage is written; the input of the
    last stage stays, as the returned rows are computed from it.
    """
    where = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
            if k:
                _delete(spark, f"{where}/{k - 1}")
    return docs
