"""The near-duplicate join where groups are larger than a cell: long chains, and groups of mutual copies."""

import random

import pytest

from loomtrace.llm import jaccard_join
from tests.llm.test_operators import _classes


@pytest.mark.parametrize("share", [0, 1])
def test_chains_and_large_groups(spark, monkeypatch, share):
    rng = random.Random(11 + share)
    words = [f"w{i}" for i in range(1400)]
    texts = {i: " ".join(words[6 * i : 6 * i + 100]) for i in range(200)}  # each is like its neighbours only
    base = [f"m{i}" for i in range(120)]
    for i in range(200, 200 + 120 * share):
        k = rng.randrange(120)
        texts[i] = " ".join([*base[:k], f"n{i}", *base[k + 1 :]])
    texts |= {400: texts[0], 401: texts[199], 402: None, 403: ""}
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 16)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    compared = []
    real = jaccard_join._meetings
    monkeypatch.setattr(jaccard_join, "_meetings", lambda *a: compared.append(real(*a)) or compared[-1])
    assert {r["id"]: (r["class_id"], r["links"]) for r in jaccard_join.near_duplicates(df).collect()} == _classes(texts)
    bands = {r["band"] for r in compared[0].selectExpr("explode(meets.band) as band").distinct().collect()}
    assert max(bands) > 0 and (-1 in bands) == bool(share)  # the chain went by buckets, the mutual group by blocks
