"""Each stage of the pipeline after the first against a plain Python version, on its own input; the first against held-out labels."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrace.llm import cotraining, mixing, packing
from tests.llm.test_line_runs import _cleaned
from tests.llm.test_operators import _classes

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def _skewed():
    """A third of the rows are copies; near copies, shared passages, empty and null texts."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts = [base[0]] * 30 + ["\n".join(rng.sample(base, 3)) for _ in range(20)] + [f"{b} x{i} y" for i, b in enumerate(base) for _ in range(2)] + ["", None, " \n "]
    return [(i, t, "en", "ab"[i % 3 == 0], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module", params=["sf0.001", "skewed"])
def docs(request, spark):
    if request.param == "skewed":
        return spark.createDataFrame(_skewed(), "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_lines(spark, docs):
    rows = {r["doc_id"]: r for r in docs.collect()}
    cleaned = _cleaned({i: r["text"] or "" for i, r in rows.items()})
    want = {i: (r["text"], r["n_chars"]) if cleaned[i] == (r["text"] or "") else (cleaned[i], len(cleaned[i])) for i, r in rows.items()}
    want = {i: w for i, w in want.items() if cleaned[i] == (rows[i]["text"] or "") or cleaned[i].strip(" \t\n\x0b\x0c\r")}
    got = STAGES["line dedup"](spark, docs, SF).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got} == want and len(got) == len(want)


def test_near_duplicates(spark, docs):
    classes = _classes({r["doc_id"]: r["text"] for r in docs.collect()})
    got = [r["doc_id"] for r in STAGES["n-gram jaccard join"](spark, docs, SF).collect()]
    assert sorted(got) == sorted({c for c, _ in classes.values()})


def test_mixture(spark, docs):
    taken = {r["doc_id"]: r["epochs"] for r in mixing.mix(docs, F.array("source")).collect()}
    got = Counter(r["doc_id"] for r in STAGES["mixing"](spark, docs, SF).collect())
    assert got == Counter({i: n for i, n in taken.items() if n})


def test_bins(spark, docs):
    rows = docs.collect()
    assert len(rows) < packing.BLOCK_PIECES  # one block, so the plain version sees the same pieces
    packed = STAGES["best-fit packing"](spark, docs, SF).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in rows}
    assert Counter({i: n for i, n in ((r["doc_id"], sum(p["size"] for p in packed if p["doc_id"] == r["doc_id"])) for r in rows)}) == Counter(size)
    bins, place = {}, {r["doc_id"]: r for r in rows}
    for p in sorted(packed, key=lambda p: (p["bin_id"], p["bin_at"])):
        at = bins.setdefault(p["bin_id"], [0, set(), set()])
        row = place[p["doc_id"]]
        cluster = "".join(c for c in row["text"] or "" if c not in packing.BLANKS)
        assert p["bin_at"] == at[0] and row["source"] not in at[1] and cluster not in at[2]
        at[0] += p["size"]
        at[1].add(row["source"])
        at[2].add(cluster)
    assert all(n <= packing.CAPACITY for n, _, _ in bins.values())


def _auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = good.sum()
    return (rank[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(F.pmod(F.xxhash64(F.lit("t"), "doc_id"), F.lit(4)) == 0)
    rows = docs.join(held, "doc_id").toPandas()
    good = ((rows["quality"] == 1) & (rows["toxic"] == 0)).to_numpy()
    content = [cotraining.content_features(t) for t in rows["text"]]
    meta = [cotraining.meta_features(*m) for m in zip(rows["source"], rows["lang"], rows["n_chars"], strict=True)]
    for rounds in (0, cotraining.ROUNDS):
        model = cotraining.train(docs, labels.join(held.select("doc_id"), "doc_id", "left_anti"), rounds=rounds)
        views = _auc(model.content.odds(content), good), _auc(model.meta.odds(meta), good), _auc(model.score(content, meta), good)
        assert views[0] > 0.7 and views[1] > 0.5 and views[2] > 0.7, views


def test_rounds_teach(spark):
    """Labelled documents show one marker only; the metadata view passes the other marker on."""
    rng = random.Random(4)
    word = lambda: rng.choice("good fine nice text word page".split())
    rows = []
    for i in range(900):
        bad = i % 2 == 0
        marker = ["awful" if i < 300 else "dreadful"] * 3 if bad else []
        rows.append((i, " ".join([word() for _ in range(40)] + marker), "en", "junk" if bad else "site"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 2 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    odds = lambda m, t: m.content.odds([cotraining.content_features(t)])[0]
    before, after = (cotraining.train(docs, labels, rounds=n) for n in (0, 2))
    text = "good fine dreadful dreadful"
    assert odds(after, text) - odds(after, "good fine page text") < odds(before, text) - odds(before, "good fine page text") - 0.5
