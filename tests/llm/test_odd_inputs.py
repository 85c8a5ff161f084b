"""Clashing names, repeated rows, nulls and empty tables, for every operator and every stage of the pipeline."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtrace.llm import bitsliced, cotraining, exact_dedup, jaccard_join, line_dedup, mixing, packing, registry, repeat_index, sharding, url_filter

NAMES = ["__id", "__key", "__th", "__gone", "__row", "id", "th", "key", "row", "Host", "Quality_Score", "LINE_REPORT", "Text_SHA256", "c0", "sieve_map", "pattern", "tags.x", "a`b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
LINES = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n ", LINES, LINES, LINES + "\nend of it", "one"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), *NAMES) for i, t in enumerate(texts)]
    rows += [rows[3]] * 3 + [(None,) * (5 + len(NAMES))] * 2 + [(3, "other text of one id", None, None, None, *[None] * len(NAMES))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _labels(spark):
    return spark.createDataFrame([(3, 1, 0), (99, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "sharding": lambda s, d: sharding.shard(d), "quality": lambda s, d: cotraining.classify(d, _labels(s)), "packing": lambda s, d: packing.pack(d),
    "exact": lambda s, d: exact_dedup.exact_groups(d), "repeats": lambda s, d: repeat_index.remove_repeats(d), "mix": lambda s, d: mixing.mix(d, F.array("source")),
    "near": lambda s, d: jaccard_join.near_duplicates(d), "lines": lambda s, d: line_dedup.drop_repeats(d),
}
KEEPING = {
    "quality": lambda s, d: cotraining.classify(d, _labels(s)), "lines": lambda s, d: line_dedup.drop_repeats(d), "keep_one": lambda s, d: jaccard_join.keep_one(d),
    "repeat": lambda s, d: mixing.repeat(d, F.array("source")), "urls": lambda s, d: url_filter.filter_urls(d.withColumn("url", F.lit("http://a.net/x")), url_filter.rules_frame(s, registry.URL_RULES)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, odd, name):
    assert OPERATORS[name](spark, odd).count() == odd.count()
    assert OPERATORS[name](spark, odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_columns_are_kept(spark, odd, name):
    out = KEEPING[name](spark, odd)
    replaced = {"quality": {"Quality_Score"}, "lines": {"LINE_REPORT"}, "urls": {"Host"}}.get(name, set())
    kept = [c for c in odd.columns if c not in replaced]
    assert out.columns[: len(kept)] == kept
    rows = out.toDF(*[f"x{i}" for i in range(len(out.columns))]).collect()
    assert {r[5 + kept[5:].index("key")] for r in rows} <= {"key", None} and rows
    assert KEEPING[name](spark, odd.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "b"), (0, [0.0, 1.0], "c"), (7, [0.5, 0.25], "d"), (8, [1e30, 1.0], "e"), (9, [-1e30, 2.0], "f")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, asks string")
    for groups in (1, 3):
        got = bitsliced.top_k(df.repartition(groups), F.col("vec_id") == 0, k=4).collect()
        top = 2**63 - 1
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(
            [(0, 1, 8, top), (0, 2, 7, 128 * 256), (0, 3, 9, -(2**63))] + [(0, 1, 9, 512 * 256), (0, 2, 8, 256 * 256), (0, 3, 7, 64 * 256)]
        )
    assert bitsliced.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_many_equal_rows_over_blocks(spark):
    rows = spark.createDataFrame([(1, "a b c", "s")] * 900, "doc_id long, text string, source string").repartition(5)
    packed = packing.pack(rows, block_pieces=300)
    assert packed.count() == 900 and packed.select("bin_id").distinct().count() == 900
    assert packed.select(F.split("bin_id", "-")[0]).distinct().count() == 3


def test_hosts_of_many_labels(spark):
    host = ".".join("a" for _ in range(4000)) + ".example.com"
    df = spark.createDataFrame([(1, f"http://{host}/de/x"), (2, "http://.net/"), (3, "http://net/")], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(df, url_filter.rules_frame(spark, registry.URL_RULES)).collect()}
    assert got == {1: "example.com/de/", 2: "net/", 3: "net/"}
    assert url_filter.filter_urls(df, url_filter.rules_frame(spark, [])).where("verdict = 'allow' and rule is null").count() == 3


def _cheapest(sums, quotas, epochs=3):
    """Least cost of the largest amount, by trying every way to send whole words."""
    choices = []
    for p, size in sums:
        ways = [w for w in itertools.product(range(epochs * size + 1), repeat=len(p)) if sum(w) <= epochs * size]
        choices.append(ways)
    best = None
    for way in itertools.product(*choices):
        into = {}
        for (p, _), w in zip(sums, way, strict=True):
            for s, n in zip(p, w, strict=True):
                into[s] = into.get(s, 0) + n
        if all(n <= quotas[s] for s, n in into.items()):
            cost = sum(sum(max(0, min(size, sum(w) - e * size)) * (e * (e + 1) // 2) for e in range(epochs)) for (_, size), w in zip(sums, way, strict=True))
            key = (-sum(into.values()), cost)
            best = min(best, key) if best else key
    return best


def test_overlapping_flow_is_cheapest():
    rng = random.Random(6)
    for _ in range(25):
        names = ["a", "b", "c"]
        patterns = rng.sample([["a"], ["b"], ["c"], ["a", "b"], ["b", "c"]], 3)
        sums = [(p, rng.randrange(1, 4)) for p in patterns]
        quotas = {s: rng.randrange(0, 8) for s in names}
        routed = mixing.route(sums, {s: i for i, s in enumerate(names)}, [quotas[s] for s in names])
        cost = sum(sum(max(0, min(size, n - e * size)) * (e * (e + 1) // 2) for e in range(3)) for (_, size), n in zip(sums, routed, strict=True))
        assert (-sum(routed), cost) == _cheapest(sums, quotas)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, k, tmp_path):
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, odd, str(tmp_path))
    assert k == 4 or out.columns == odd.columns
    assert out.toDF(*[f"x{i}" for i in range(len(out.columns))]).count() > 0
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), str(tmp_path)).count() == 0
