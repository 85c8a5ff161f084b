"""The mixing stage repeats every row as often as the mix takes it."""

from collections import Counter

from pyspark.sql import functions as F

from loomtrace.llm import mixing


def test_rows_of_equal_id_at_the_boundary(spark):
    rows = [(None, f"t{i} " + "w " * 99, "a") for i in range(1000)] + [(i, f"u{i} " + "w " * 99, "b") for i in range(500)] + [(7, f"v{i} " + "w " * 99, "b") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for weights in ((45, 155), (145, 55), (125, 75)):
        mixed = mixing.mix(docs, F.array("source"), weights=weights)
        want = Counter({(r["doc_id"], r["pattern"][0]): r["n"] for r in mixed.groupBy("doc_id", "pattern").agg((F.sum("taken") / 100).cast("long").alias("n")).collect() if r["n"]})
        copies = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.repeat(docs, F.array("source"), weights=weights).collect())
        got = Counter()
        for (i, _, source), n in copies.items():
            got[i, source] += n
        assert got == want and sum(got.values()) == 2000
        assert got[None, "a"] == weights[0] * 10
        spread = Counter(copies.get(r, 0) for r in rows if r[2] == "a")
        assert max(spread) - min(spread) <= 1
