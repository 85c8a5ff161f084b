"""Corpus operators against DuckDB or brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrace.llm import bitsliced, cotraining, exact_dedup, jaccard_join, line_dedup, mixing, packing, registry, repeat_index, sharding, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, pattern string, bin_id string, shard string"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal ids, clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    near = [f"t{i}" for i in range(60)]
    texts = [None, "", " \t\n", "one", long, long + " end", " ".join(near), " ".join(near), " ".join([*near[:-1], "other"]), "a\nb\nc\nd", "x\na\nb\nc\ny", "😀 é\x00z"]
    rows = [(i, t, "en", f"s{i % 2}", None, "p", "b", "s") for i, t in enumerate(texts)]
    rows += [rows[6], (6, "equal id, other text", None, None, 3, None, None, None), (None, " ".join(near), "en", None, 1, "p", "b", "s"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    cursor = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    places = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(repr([r[i] for i in places]) for r in cursor.fetchall())


def _removed(texts: dict, length: int = 50):
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][k : k + length], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(spark, duck):
    texts = {i: (t or "").encode() for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in registry.op6_repeats(spark, SF).collect()}
    assert got == _removed(texts)


def test_repeats_in_many_small_batches(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("ab ") for _ in range(3000))
    texts = {i: base[(a := rng.randrange(2500)) : a + rng.randrange(40, 400)].replace("aab", "c" if i % 3 else "aab") for i in range(80)}
    for name in ("BATCH_BYTES", "SHARD_BYTES", "RANGE_ANCHORS"):
        monkeypatch.setattr(repeat_index, name, 1500)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]) // 2, hashlib.sha256(r["kept"]).hexdigest()) for r in repeat_index.remove_repeats(df).collect()}
    assert got == _removed({i: t.encode() for i, t in texts.items()})


def _classes(texts: dict):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent, links = {i: i for i in sets}, defaultdict(int)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (root(i), links[i]) for i in ids}


def test_near_duplicates_equal_brute_force(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in registry.op8_near_duplicates(spark, SF).collect()}
    assert got == _classes(texts)


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(base[:k] + [f"n{i}"] + base[k + 1 :]) for i, k in ((i, rng.randrange(120)) for i in range(150))}
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 40)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: (r["class_id"], r["links"]) for r in jaccard_join.near_duplicates(df).collect()} == _classes(texts)
    assert jaccard_join.keep_one(df).count() == len({c for c, _ in _classes(texts).values()})


def test_pruning_rule():
    n = 25
    cut = jaccard_join.cuts([n])[0]
    x = np.random.RandomState(1).beta(cut - 1 + 1, n - cut + 1 + 1, 2_000_000)
    assert (x >= 0.8).mean() < 1e-5 and jaccard_join.cuts([n], Fraction(4, 5), 0.5)[0] > cut


def test_best_fit_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randrange(0, 40) for _ in range(60)), reverse=True)
        masks = [1 << rng.randrange(5) | 1 << (5 + rng.randrange(8)) for _ in sizes]
        left, inside, want = [], [], []
        for s, m in zip(sizes, masks, strict=True):
            fit = min(((r, i) for i, r in enumerate(left) if r >= s and not inside[i] & m), default=None)
            if fit is None:
                left.append(40), inside.append(0)
            i = len(left) - 1 if fit is None else fit[1]
            left[i] -= s
            inside[i] |= m
            want.append(i)
        assert packing.best_fit(sizes, masks, 40) == want


def test_packing_keeps_limits(spark):
    rows = registry.op4_packing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id")
    bins = rows.groupBy("bin_id").agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.countDistinct("source").alias("s"))
    assert bins.where(f"n > {packing.CAPACITY} OR k <> s").isEmpty()
    whole = rows.groupBy("doc_id").agg(F.sum("size").alias("n"))
    docs = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), F.array("source"))
    assert whole.join(docs, "doc_id").where("n <> size").isEmpty() and whole.count() == docs.count()


def test_flow_takes_first_passes_first():
    arcs = [(0, 1, 10, 0), (0, 1, 10, 1), (0, 2, 30, 0), (1, 3, 20, 0), (1, 4, 20, 0), (2, 4, 90, 0), (3, 5, 15, 0), (4, 5, 25, 0)]
    flow = mixing.min_cost_flow(6, arcs, 0, 5)
    assert sum(flow[6:]) == 40 and flow[0] == 10 and flow[1] == 5
    assert mixing.quotas([10, 1000], [1, 1], 3, 1010) == [30.0, 980.0]


def test_mix_comes_near_its_targets(spark):
    rows = registry.op7_mixing(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    sums = rows.join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.max("size").alias("m"))
    assert sums.where("abs(n - t) > m / 2 + 1").isEmpty() and rows.where("taken > 3 * size").isEmpty()


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * (i + 1), ["a", "b"] if i % 2 else ["a"]) for i in range(50)], "doc_id long, text string, tags array<string>")
    rows = mixing.mix(df, F.col("tags"))
    assert rows.count() == 50 and rows.where("taken > 3 * size").isEmpty()


def test_classifier_finds_what_is_bad(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("good fine nice text word page".split() + (["awful"] if i % 3 == 0 else [])) for _ in range(80)), "en", "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = cotraining.classify(docs, labels).where("doc_id >= 300").groupBy((F.col("doc_id") % 3 > 0).alias("good")).agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()
    assert {r["good"]: r["a"] for r in got} == {True: 1.0, False: 0.0}


def test_odd_rows(spark, odd):
    n = odd.count()
    shards = sharding.shard(odd, limit=2000)
    assert shards.count() == n and shards.where("shard_bytes > 2000 AND NOT oversized").isEmpty()
    exact = exact_dedup.exact_groups(odd)
    assert exact.count() == n and exact.where("kept").count() == exact.select("text_sha256").distinct().count()
    assert packing.pack(odd).groupBy("bin_id").agg(F.sum("size").alias("n")).where(f"n > {packing.CAPACITY}").isEmpty()
    assert repeat_index.remove_repeats(odd).count() == n
    assert mixing.mix(odd, F.array("source")).count() == n
    near = jaccard_join.near_duplicates(odd)
    assert near.count() == n and {r["links"] for r in near.where("id = 6 and class_id = 6").collect()} >= {4}
    assert jaccard_join.keep_one(odd).where("text like 't0 t1%'").count() == 1
    cleaned = line_dedup.drop_repeats(odd)
    assert cleaned.count() == n and cleaned.where("doc_id = 10").first()["text"] == "x\ny"
    labels = spark.createDataFrame([(1, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.classify(odd, labels).count() == n


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [
        f(none).count()
        for f in (sharding.shard, exact_dedup.exact_groups, packing.pack, repeat_index.remove_repeats, lambda d: mixing.mix(d, F.array("source")), jaccard_join.near_duplicates, line_dedup.drop_repeats, lambda d: cotraining.classify(d, labels))
    ] == [0] * 8


def test_equal_rows_above_the_limit_are_dealt(spark):
    rows = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string").repartition(4)
    got = sharding.shard(rows, limit=1000)
    assert got.count() == 50 and got.where("shard_bytes > 1000").isEmpty()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [-1.0, 0.25]), (7, [-1.0, 0.25]), (None, [1.0, 1.0])]
    got = bitsliced.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert [tuple(r) for r in got.where("query_id = 0").orderBy("rank").collect()] == [(0, 1, 50, 81920), (0, 2, 7, -57344), (0, 3, 7, -57344)]


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://A.NET", "http://a.net/x", "x://EXAMPLE.net/en/?q", "http://example.net#/en/", "https://b.example.com/de/1", "http://Ünet.org/fr/a?b/c", "http://badnet/x", "http://a.net:80/"]
    rows = spark.createDataFrame([(i % 9, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows, url_filter.rules_frame(spark, registry.URL_RULES)).collect()}
    assert got["http://A.NET"] == ("a.net", "", None, "allow") and got["http://a.net/x"] == ("a.net", "/x", "net/", "block")
    assert got["x://EXAMPLE.net/en/?q"][2:] == ("example.net/en/", "allow") and got["https://b.example.com/de/1"][2:] == ("example.com/de/", "block")
    assert got["http://Ünet.org/fr/a?b/c"] == ("Ünet.org", "/fr/a", "org/fr/", "allow") and got["http://badnet/x"][2] is None and got[None] == ("", "", None, "allow")
    assert len(got) == len(urls)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() > 0
    assert docs.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id"), "doc_id", "left_anti").isEmpty()
    assert corpus_pipeline.run(spark, SF).count() > 0
