"""Queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, cotraining, exact_dedup, jaccard_join, line_dedup, mixing, packing, repeat_index, sharding, url_filter

#: Rules of the URL query: (verdict, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
QUERY_EVERY = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "quality_score", "accepted")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeat_index.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"), F.array("source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "links")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "line_report.n_lines", "line_report.n_removed", "line_report.n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_frame(spark, URL_RULES)).drop("url")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_quality, op3_topk, op4_packing, op5_exact_dedup, op6_repeats, op7_mixing, op8_near_duplicates, op9_line_dedup, op10_url_filter, pipeline)}

_BITS = "lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT), 48, '0')"

ORACLE_SQL = {
    "op1_sharding": f"""
        WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, {_BITS} AS bits FROM documents),
        p AS (SELECT doc_id, n, i AS depth, substr(bits, 1, i) AS shard FROM d, range(0, 49) t(i)),
        s AS (SELECT shard, sum(n)::BIGINT AS bytes FROM p GROUP BY shard)
        SELECT doc_id, n AS n_bytes, shard, depth::INT AS depth, bytes AS shard_bytes, false AS oversized
        FROM p JOIN s USING (shard) WHERE bytes <= {sharding.LIMIT_BYTES}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""",
    "op3_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)""",
    "op7_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS place,
                     sum(source_size) OVER () AS total FROM s),
        o AS (SELECT *, row_number() OVER r AS k, 3 * source_size / weight AS ratio,
                     coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                     sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
              FROM w WINDOW r AS (ORDER BY 3 * source_size / weight, place)),
        f AS (SELECT min(k) AS k FROM o WHERE (total - capped)::DOUBLE / heavy * weight <= 3 * source_size),
        l AS (SELECT o.k, (total - capped)::DOUBLE / heavy AS level FROM o JOIN f USING (k)),
        t AS (SELECT o.source, o.source_size, CASE WHEN o.k >= l.k THEN l.level * o.weight ELSE 3.0 * o.source_size END::DOUBLE AS target FROM o, l),
        q AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, round_even(t.target, 0)::BIGINT AS quota,
                     md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || d.size::VARCHAR) AS key
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, quota // greatest(source_size, 1) AS passes, quota % greatest(source_size, 1) AS rest,
                     coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
        SELECT doc_id, size, source_size, target,
               (size * (passes + CASE WHEN rest > 0 AND size > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c""",
    "op9_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        e AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
        n AS (SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM e),
        t AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2,
                     lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2 FROM n WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        g AS (SELECT doc_id, [i, i1, i2] AS spot, x || chr(10) || x1 || chr(10) || x2 AS gram FROM t
              UNION ALL SELECT doc_id, [i], x FROM t WHERE n > 50
              UNION ALL SELECT doc_id, [i, i1], x || chr(10) || x1 FROM t WHERE n + len(regexp_extract_all(x1, '[^\x20\x09-\x0D]+')) > 50),
        r AS (SELECT doc_id, spot, row_number() OVER (PARTITION BY gram ORDER BY doc_id, spot[1]) AS k FROM g WHERE gram IS NOT NULL),
        x AS (SELECT DISTINCT doc_id, unnest(spot) AS i FROM r WHERE k > 1),
        m AS (SELECT e.doc_id, e.i, e.line, x.i IS NOT NULL AS gone FROM e LEFT JOIN x USING (doc_id, i)),
        p AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed, count(*) FILTER (opens)::BIGINT AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM p GROUP BY doc_id""",
    "op10_url_filter": r"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (SELECT h.*, r.rule_host || r.rule_path AS rule, r.verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
              FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
}
