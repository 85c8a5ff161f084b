"""N-gram Jaccard join (operator 8): MinHash with Bayesian candidate pruning.

A text's words are its ``[^\\x20\\x09-\\x0D]+``; its shingles are the sets of five words in a row (all
its words, if fewer). Texts with one shingle set are one node. Nodes that agree on a whole band of MinHash
values meet; what is connected in that way is compared, in cells of bounded size: the MinHash values
are compared a few at a time, and a pair is dropped once the posterior probability that its similarity
reaches the threshold (uniform prior) is below the tolerance; the others are verified exactly on
their shingles. Only sums of links and spanning edges leave a cell, never pairs.

With 25 bands of 5, a pair at exactly 0.8 is not met with probability 5e-5, at 0.85 with 4e-7; a prune at
tolerance 1e-6 adds about as much at each of its five looks. Nothing is capped: a component too large for a cell is
dealt into blocks, and every two blocks meet.

Edge cases: null, empty or blank texts have no shingles and no links, each its own class; a null
doc_id is the last of its class; repeated rows are copies of each other; equal sets count as links
of similarity 1; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, join_keyed, materialise, numbered, sieved, small, small_batches

WORDS = 5
THRESHOLD = Fraction(4, 5)
BANDS, BAND_ROWS = 25, 5
TOLERANCE = 1e-6
#: Nodes and shingles of a block.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000
#: Nodes whose pairs are pruned at a time; shingles, and columns of marks, that are intersected at a time.
STRIPE, SLICE_SHINGLES, COLUMNS = 64, 1 << 17, 1024
#: Hashes of words that are kept.
KEPT_WORDS = 1 << 16

_SEEDS = np.random.RandomState(8)
_FACTORS = (_SEEDS.randint(0, 2**31, BANDS * BAND_ROWS).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_OFFSETS = _SEEDS.randint(0, 2**31, BANDS * BAND_ROWS).astype(np.uint32) * np.uint32(2654435761)


class _Hashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, hashes: dict[bytes, int], n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``text``."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(each))
    out = np.zeros(len(each) - width + 1, np.uint64)
    for k in range(width):
        out = _mixed(out + each[k : len(out) + k] + np.uint64(k + 1))
    return np.unique(out)


def minhash(sh: np.ndarray) -> np.ndarray:
    """One least value per hash function, over 32-bit folds of the shingles."""
    folded = (sh >> np.uint64(32)).astype(np.uint32) ^ sh.astype(np.uint32)
    out = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 2048):
        part = folded[None, at : at + 2048] * _FACTORS[:, None] + _OFFSETS[:, None]
        np.minimum(out, (part ^ (part >> np.uint32(15))).min(axis=1), out=out)
    return out


def cuts(steps: list[int], threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, the least number of equal ones with which a pair goes on.

    With a uniform prior the posterior after m of n is Beta(m+1, n-m+1), whose upper tail at t is
    the probability of at most m successes in n+1 trials.
    """
    t, out = float(threshold), []
    for n in steps:
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


_STEPS = list(range(25, BANDS * BAND_ROWS + 1, 25))
_CUTS = cuts(_STEPS)


def linked(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of the candidates of left x right that reach the threshold; with ``same``, a < b of left.

    Candidates share a band; with ``band``, it is the first one they share.
    """
    first = np.zeros((len(left), len(right)), np.uint8)
    for c in range(_STEPS[0]):
        first += sig[left, c][:, None] == sig[right, c][None, :]
    live = first >= _CUTS[0]
    live = np.triu(live, 1) if same else live
    found = []
    for low in range(0, len(left), STRIPE):
        a, b = np.nonzero(live[low : low + STRIPE])
        a += low
        m = first[a, b].astype(np.int16)
        for begin, end, cut in zip(_STEPS, _STEPS[1:], _CUTS[1:], strict=False):
            m += (sig[left[a], begin:end] == sig[right[b], begin:end]).sum(axis=1, dtype=np.int16)
            stay = m >= cut
            a, b, m = a[stay], b[stay], m[stay]
        shared = (sig[left[a]] == sig[right[b]]).reshape(len(a), BANDS, BAND_ROWS).all(axis=2)
        stay = shared.any(axis=1) & ((band < 0) | (shared.argmax(axis=1) == band))
        a, b = a[stay], b[stay]
        found.append((a.astype(np.int32), b.astype(np.int32)))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32))
    one, other = [sets[x] for x in left], [sets[x] for x in right]
    sums = np.array([len(s) for s in one], np.int64)[a] + np.array([len(s) for s in other], np.int64)[b]
    stay = _overlaps(one, other, a, b) * (THRESHOLD.denominator + THRESHOLD.numerator) >= THRESHOLD.numerator * sums
    return left[a[stay]], right[b[stay]]


def _overlaps(one: list[np.ndarray], other: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of one[a] and other[b]."""
    rows, columns = np.unique(a), np.unique(b)
    if len(a) <= 8 * (len(rows) + len(columns)):
        return np.fromiter((len(np.intersect1d(one[x], other[y], assume_unique=True)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    one, other = [one[x] for x in rows], [other[y] for y in columns]
    total = np.zeros((len(one), len(other)), np.float32)  # counts below 2**24 are exact
    slices = -(-sum(map(len, one + other)) // SLICE_SHINGLES)
    edges = np.array([k * 2**64 // slices for k in range(1, slices)], np.uint64)
    ends = [[np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in side] for side in (one, other)]
    for k in range(slices):  # one range of shingles at a time, to bound what is held
        sides = []
        for side, at in zip((one, other), ends, strict=True):
            parts = [s[e[k] : e[k + 1]] for s, e in zip(side, at, strict=True)]
            sides.append((np.repeat(np.arange(len(side), dtype=np.int32), [len(x) for x in parts]), np.concatenate(parts)))
        common = np.intersect1d(np.unique(sides[0][1]), np.unique(sides[1][1]), assume_unique=True)
        if not len(common):
            continue
        placed = []
        for owner, values in sides:
            column = np.searchsorted(common, values).astype(np.int32)
            met = common[np.minimum(column, len(common) - 1)] == values
            placed.append((owner[met], column[met]))
        for low in range(0, len(common), COLUMNS):
            dense = []
            for (owner, column), side in zip(placed, (one, other), strict=True):
                inside = (column >= low) & (column < low + COLUMNS)
                marks = np.zeros((len(side), min(COLUMNS, len(common) - low)), np.float32)
                marks[owner[inside], column[inside] - low] = 1
                dense.append(marks)
            total += dense[0] @ dense[1].T
    return total[np.searchsorted(rows, a), np.searchsorted(columns, b)].astype(np.int64)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n points the least point it is connected to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label.copy())
        label = label[label]
        if (label == before).all():
            break
    return label


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _Hashes()
    for rows in batches:
        out = []
        for text in rows["text"]:
            sh = shingles(text, hashes)
            out.append((xxhash.xxh3_128_digest(sh.tobytes()), len(sh), minhash(sh).tobytes()) if len(sh) else (None, 0, None))
        node, n, sig = zip(*out, strict=True) if out else ((), (), ())
        yield pd.DataFrame({"id": rows["id"], "th": rows["th"], "node": node, "n": np.array(n, np.int64), "sig": sig})


def _reread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingles of texts that are still the node they are looked up for."""
    hashes = _Hashes()
    for rows in batches:
        sets = [shingles(t, hashes) for t in rows["text"]]
        stay = np.array([xxhash.xxh3_128_digest(s.tobytes()) == bytes(x) for s, x in zip(sets, rows["node"], strict=True)], bool)
        kept = [s for s, ok in zip(sets, stay, strict=True) if ok]
        yield rows.drop(columns="text")[stay].assign(sh=[s.tobytes() for s in kept], sig=[minhash(s).tobytes() for s in kept])


def _compare(cell: pd.DataFrame) -> pd.DataFrame:
    out = []
    for (_, i, j), rows in cell.groupby(["meet", "i", "j"], sort=False):
        rows = rows.drop_duplicates("node").reset_index(drop=True)
        sig = np.stack([np.frombuffer(s, np.uint32) for s in rows["sig"]])
        sets = [np.frombuffer(s, np.uint64) for s in rows["sh"]]
        part = rows["part"].to_numpy()
        a, b = linked(sig, sets, np.nonzero(part == i)[0], np.nonzero(part == j)[0], i == j, int(rows["band"].iloc[0]))
        k = rows["k"].to_numpy(np.int64)
        links = np.bincount(a, k[b], len(rows)) + np.bincount(b, k[a], len(rows))
        label = _labels(len(rows), a, b)
        out.append(pd.DataFrame({"node": rows["node"], "links": links.astype(np.int64), "label": rows["node"].to_numpy()[label]}))
    return pd.concat(out)


def _parts(nodes: str, size: str) -> Column:
    """Blocks of at most about BLOCK_NODES nodes and BLOCK_SHINGLES shingles."""
    return F.greatest(F.lit(1), F.ceil(F.col(nodes) / BLOCK_NODES), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")


def _meetings(members: DataFrame, keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, k, low_id, low_th and meets (meet, band, parts, part) of every node that meets others."""
    held = materialise(members.join(nodes, "node").select("node", "root", "k", "n", F.col("least.id").alias("low_id"), F.col("least.th").alias("low_th")))
    groups = held.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n").alias("size")).withColumn("parts", _parts("nodes", "size"))
    large = small(materialise(groups.where("parts > 1")))
    whole = held.join(large.select("root"), "root", "left_anti").select("node", F.struct(F.col("root").alias("meet"), F.lit(-1).alias("band"), F.lit(1).alias("parts"), F.lit(0).alias("part")).alias("m"))
    if not large.isEmpty():
        # for each large group: pairs within its buckets against pairs of all its nodes
        inside = materialise(keyed.join(held.join(large.select("root"), "root", "left_semi").select("node", "root", "n"), "node"))
        buckets = inside.groupBy("root", "band", "value").agg(F.count("*").alias("nodes"), F.sum("n").alias("size")).where("nodes > 1").withColumn("parts", _parts("nodes", "size"))
        buckets = materialise(buckets)
        cost = buckets.groupBy("root").agg(F.sum(F.col("nodes").cast("double") * F.col("nodes")).alias("cost"))
        by_bucket = small(materialise(large.join(cost, "root").where(F.col("cost") < F.col("nodes").cast("double") * F.col("nodes")).select("root")))
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
        blocks = held.join(large.join(by_bucket, "root", "left_anti").select("root", "parts"), "root")
        blocks = blocks.select("node", F.struct(F.col("root").alias("meet"), F.lit(-1).alias("band"), "parts", part).alias("m"))
        apart = inside.join(by_bucket, "root", "left_semi").join(buckets.select("band", "value", "parts"), ["band", "value"])
        apart = apart.select("node", F.struct(F.to_binary(F.concat(F.hex("band"), F.lpad(F.hex("value"), 16, "0")), F.lit("hex")).alias("meet"), "band", "parts", part).alias("m"))
        whole = whole.unionAll(blocks).unionAll(apart)
    return materialise(whole.groupBy("node").agg(F.collect_list("m").alias("meets")).join(held.select("node", "k", "n", "low_id", "low_th"), "node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), class_id (least id of the class), links, first (row stays as the class's one) for every row."""
    small_batches(docs.sparkSession)
    held, name = numbered(docs)
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    source = held.select(F.col(name[id_col]).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketched = materialise(source.mapInPandas(_sketch, "id long, th long, node binary, n long, sig binary"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("least")
    nodes = sketched.where("node is not null").groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n"), least)
    width = 4 * BAND_ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    keyed = sketched.where("node is not null").groupBy("node").agg(F.first("sig").alias("sig")).select("node", F.posexplode(bands).alias("band", "value"))
    buckets = keyed.groupBy("value").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("value", "low")
    shared = materialise(keyed.join(buckets, "value"))
    met = materialise(components(shared.select(F.col("node").alias("u"), F.col("low").alias("v"))))
    members = met.select(F.col("u").alias("node"), "root").unionAll(met.select(F.col("root").alias("node"), "root").distinct())
    placed = _meetings(members, shared.drop("low"), nodes)
    groups = max(1, -(-(placed.agg(F.sum(F.col("n") * F.size("meets"))).first()[0] or 0) // BLOCK_SHINGLES))
    maybe, _ = sieved(source, F.xxhash64("id", "th"), placed, F.xxhash64("low_id", "low_th"))  # most texts meet nobody and stay where they are
    found = maybe.join(placed.drop("n"), F.col("id").eqNullSafe(F.col("low_id")) & (F.col("th") == F.col("low_th")))
    read = found.select("node", "k", "meets", "text").mapInPandas(_reread, "node binary, k long, meets array<struct<meet:binary,band:int,parts:int,part:int>>, sh binary, sig binary")
    each = read.select("node", "k", "sh", "sig", F.explode("meets").alias("m")).select("node", "k", "sh", "sig", "m.*")
    cells = (
        each.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
        .withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")}).drop("o")
        .withColumn("cell", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("meet"), F.lit(groups))).otherwise(F.xxhash64("meet", "i", "j")))
    )
    compared = materialise(cells.drop("parts").groupBy("cell").applyInPandas(_compare, "node binary, links long, label binary"))
    joined = components(compared.select(F.col("node").alias("u"), F.col("label").alias("v")).where("u != v"))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = materialise(
        nodes.join(links, "node", "left").join(joined.withColumnRenamed("u", "node"), "node", "left")
        .select("node", "k", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    heads = materialise(rooted.groupBy("root").agg(F.min("least").alias("head"), F.count("*").alias("members")))
    total = rooted.count()
    named = join_keyed(rooted, heads, ["root"], "members", total).select("node", (F.col("links") + F.col("k") - 1).alias("links"), "head", "k")
    named = materialise(named)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    rows = sketched.drop("sig", "n")
    lone = rows.where("node is null").select("id", "th", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("first"))
    met = join_keyed(rows.where("node is not null"), named, ["node"], "k", sketched.count())
    return met.select("id", "th", F.col("head.id").alias("class_id"), "links", (own == F.col("head")).alias("first")).unionAll(lone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least id."""
    rows = materialise(near_duplicates(docs, id_col, text_col))
    goes = materialise(rows.where("not first").select("id", "th").distinct())
    inner, name = numbered(docs)
    content, key = F.coalesce(F.col(name[text_col]), F.lit("")), F.col(name[id_col])
    held = inner.withColumn("th", F.xxhash64(content))
    maybe, sure = sieved(held, F.xxhash64(key, "th"), goes, F.xxhash64("id", "th"))
    kept = maybe.join(goes.toDF("other", "other_th"), key.eqNullSafe(F.col("other")) & (F.col("th") == F.col("other_th")), "left_anti").unionAll(sure)
    if not rows.where("first").groupBy("id", "th").count().where("count > 1").isEmpty():  # equal rows: one of those with shingles stays
        with_words = F.regexp_count(content, F.lit(r"[^\x20\x09-\x0D]")) > 0
        kept = kept.where(with_words).dropDuplicates([name[id_col], "th"]).unionByName(kept.where(~with_words))
    return kept.select(*inner.columns).toDF(*docs.columns)
