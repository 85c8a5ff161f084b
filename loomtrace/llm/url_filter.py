"""URL filter (operator 10): host-suffix and path-prefix expressions against hashed rules.

Every distinct (host, path) is expanded into its host suffixes of the numbers of labels that rules have times its path
prefixes of the lengths that rules have, so a host of very many labels costs no more; the SHA-256 of each expression meets the rules on its first four bytes, and
the full digest confirms. The longest rule that fits wins; of equally long ones that with the longer
host, and of equal rules with opposed verdicts the block.

Edge cases: a null url or one without ``://`` has host and path ``""`` and no rule; an empty path
fits no rule, as rules' paths begin with ``/``; repeated rows and null ids are judged like others; without rules all get the default;
an empty table gives no rows; other columns are kept, whatever their names, and those named like the results, in any case of letters, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end; only A-Z is lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules as (verdict, host, path): the digest of host and path, and what is reported for a fit."""
    rows = [(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules]
    if any(not p.startswith("/") or v not in ("allow", "block") or not h for v, h, p in rows):
        raise ValueError("a rule is ('allow' or 'block', host, path starting with '/')")
    return spark.createDataFrame(rows, "verdict string, r_host string, r_path string")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names are replaced."""
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in made]
    held, name = numbered(pages)
    address = F.col(name[url])
    rules = small(
        rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))  # 'block' > 'allow'
        .select("r_host", "r_path", "r_verdict", F.sha2(F.concat("r_host", "r_path"), 256).alias("r_digest"))
        .withColumn("short", F.substring("r_digest", 1, PREFIX_HEX))
    )
    shapes = rules.agg(F.collect_set(F.char_length("r_path")), F.collect_set(F.size(F.split("r_host", r"\.")))).first()
    lengths, counts = (sorted(x) for x in shapes)  # each at most as many as a url has characters
    parted = held.select(*[name[c] for c in kept], host_of(address).alias("host"), path_of(address).alias("path"))
    labels = F.size(F.split("host", r"\.")).alias("labels")
    suffixes = F.array_compact(F.array(*(F.when(F.col("labels") >= n, F.substring_index("host", ".", -n)) for n in counts)).cast("array<string>"))
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    each = (
        parted.select("host", "path").distinct().select("*", labels)
        .select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    named = F.concat("r_host", F.substring(F.col("r_path"), F.lit(1), F.char_length("r_path")))
    best = (
        each.join(rules, "short").where("digest = r_digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.char_length(named), F.char_length("r_host"), named.alias("rule"), F.col("r_verdict"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict"))
    )
    judged = parted.join(best, ["host", "path"], "left")
    return judged.select(*[name[c] for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default))).toDF(*kept, *made)
