"""Mixing to target weights (operator 7): min-cost flow for overlapping sources.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network
carries token capacity from the patterns to the sources' quotas; a pattern's first, second, third ...
pass costs more each time, so nothing is repeated before everything fitting has been taken once. Each
pattern's flow then becomes whole passes over all its documents and a remainder, which goes to the
documents first in a seeded order until the next one would fit by less than half.

The driver holds one row for each distinct pattern, PATTERNS at most (more raise a ValueError: a plan for them would
not fit one machine), and broadcasts the plan if it is small. The flow is found in phases of equal cost. Running sums use per-bucket
subtotals; rows of equal id and size, which one bucket would hold, are counted by partition first, so no source and no
id is brought to one task.

Edge cases: null text has size 0; a null source is a source of its own, last in order; a null or repeated doc_id is ordered by its size too,
and rows that tie in both are taken in the order of their places; a very long text is one size; documents without a source take no part
(0 taken); an empty table gives no rows; extra columns are not read, whatever their names, and ``repeat`` keeps them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_keyed, materialise, numbered, sieved, small, words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_HEX = 3
#: Distinct membership patterns that are planned for.
PATTERNS = 100_000


def quotas(sizes: Sequence[int], weights: Sequence[float], most: float, total: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is reshared by weight."""
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    out, capped, heavy = [0.0] * len(sizes), 0, sum(weights)
    for k, i in enumerate(order):
        level = (total - capped) / heavy if heavy else 0.0
        if level * weights[i] <= most * sizes[i]:
            for j in order[k:]:
                out[j] = level * weights[j]
            break
        out[i] = float(most * sizes[i])
        capped += most * sizes[i]
        heavy -= weights[i]
    return out


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a cheapest largest flow: for each cost of a path, lowest first, a blocking flow."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        out[u].append(len(to)), to.append(v), cap.append(c), cost.append(w)
        out[v].append(len(to)), to.append(u), cap.append(0), cost.append(-w)
    while True:
        dist, queued, queue = [None] * n, [False] * n, deque([s])
        dist[s] = 0
        while queue:
            u = queue.popleft()
            queued[u] = False
            for e in out[u]:
                if cap[e] and (dist[to[e]] is None or dist[u] + cost[e] < dist[to[e]]):
                    dist[to[e]] = dist[u] + cost[e]
                    if not queued[to[e]]:
                        queued[to[e]] = True
                        queue.append(to[e])
        if dist[t] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        while True:  # all paths of this cost, the shortest in arcs first
            level, queue = [None] * n, deque([s])
            level[s] = 0
            while queue:
                u = queue.popleft()
                for e in out[u]:
                    v = to[e]
                    if cap[e] and level[v] is None and dist[v] is not None and dist[v] == dist[u] + cost[e]:
                        level[v] = level[u] + 1
                        queue.append(v)
            if level[t] is None:
                break
            at, path, u = [0] * n, [], s
            while True:
                if u == t:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    first = next(i for i, e in enumerate(path) if not cap[e])
                    u = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    v = to[e]
                    if cap[e] and level[v] == level[u] + 1 and dist[v] == dist[u] + cost[e]:
                        break
                    at[u] += 1
                if at[u] < len(out[u]):
                    path.append(out[u][at[u]])
                    u = to[path[-1]]
                elif u == s:
                    break
                else:
                    e = path.pop()
                    u = to[e ^ 1]
                    at[u] += 1


def _before(base: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``base`` (pattern, key, id, size and ``keep``) with ``before``: the sizes of the rows of its pattern that stand before it.

    Rows that tie in pattern, key, id and size are one line of the running sums, so a repeated id fills no bucket; within a
    line, places are counted by partition first.
    """
    same = ["pattern", "key", "who", "size"]  # an id in a struct, as nulls are equal there
    base = base.withColumn("who", F.struct("id"))
    lines = base.groupBy(*same).agg(F.count("*").alias("ties"), F.first(F.struct("id", *keep)).alias("row")).withColumn("bucket", F.substring("key", 1, BUCKET_HEX))
    lines = materialise(lines)
    order = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("size") * F.col("ties")
    sums = lines.groupBy("pattern", "bucket").agg(F.sum(whole).alias("sum")).select("pattern", "bucket", F.coalesce(F.sum("sum").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("pattern", "bucket").orderBy("key", "who", "size").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("own", F.coalesce(F.sum(whole).over(within), F.lit(0))).join(sums, ["pattern", "bucket"]).withColumn("before", F.col("base") + F.col("own"))
    alone = lines.where("ties = 1").select("pattern", "size", "row.*", "before")
    several = materialise(lines.where("ties > 1").select(*same, "ties", "before"))
    if several.isEmpty():
        return alone
    name = F.xxhash64("pattern", "key", "who", "size")
    maybe, _ = sieved(base, name, several, name)
    tied = materialise(join_keyed(maybe, several, same, "ties", base.count()).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    over = Window.partitionBy(*same).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = tied.groupBy(*same, "p").agg(F.count("*").alias("k")).withColumn("skip", F.coalesce(F.sum("k").over(over), F.lit(0))).drop("k")
    place = F.row_number().over(Window.partitionBy(*same, "p").orderBy("i")) - 1
    placed = tied.withColumn("place", place).join(counts, [*same, "p"])
    return alone.unionByName(placed.select("pattern", "size", "id", *keep, (F.col("before") + F.col("size") * (F.col("place") + F.col("skip"))).alias("before")))


def mix(docs: DataFrame, memberships: Column, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, pattern, size, epochs, taken, source_size and target for every row; source_size and target are the first source's."""
    held, name = numbered(docs.select("*", memberships.alias("pattern")))
    rows = held.select(F.col(name[id_col]).alias("id"), F.col(name[text_col]).alias("text"), F.col(held.columns[-1]).alias("pattern"))
    return _mixed(rows, [], weights, max_epochs, seed).withColumnRenamed("id", id_col)


def _mixed(rows: DataFrame, keep: Sequence[str], weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix of ``rows`` (id, text, pattern and ``keep``)."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string")))
    pattern = F.array_sort(F.array_distinct(F.coalesce("pattern", F.array().cast("array<string>"))))
    base = materialise(rows.select("id", words(F.col("text")).alias("size"), pattern.alias("pattern"), *keep).withColumn("key", key))
    spark = rows.sparkSession
    sums = base.groupBy("pattern").agg(F.sum("size").alias("size")).limit(PATTERNS + 1).collect()
    if len(sums) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} distinct membership patterns")
    sums = sorted(((list(r["pattern"]), int(r["size"])) for r in sums), key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({s for p, _ in sums for s in p}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for p, size in sums:
        for s in p:
            sizes[index[s]] += size
    targets = quotas(sizes, [weights[i % len(weights)] for i in range(len(names))], max_epochs, sum(size for p, size in sums if p))
    routed = route(sums, index, targets, max_epochs)
    plan = spark.createDataFrame(
        [(p, f // size if size else 0, f % size if size else 0, sizes[index[p[0]]] if p else None, targets[index[p[0]]] if p else None) for (p, size), f in zip(sums, routed, strict=True)],
        "pattern array<string>, passes long, rest long, source_size long, target double",
    )
    ranked = _before(base, keep).join(small(plan), "pattern")
    epochs = F.col("passes") + (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).cast("long")
    epochs = F.when((F.col("rest") > 0) & (F.col("size") > 0), epochs).otherwise(F.col("passes"))
    return ranked.select("id", "pattern", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"), *keep)


def route(sums: list[tuple[list[str], int]], index: dict[str, int], targets: Sequence[float], max_epochs: int = MAX_EPOCHS) -> list[int]:
    """Words taken of each pattern (sources, size): a cheapest flow to the sources' targets, each pass dearer than the one before."""
    arcs, end = [], 1 + len(sums) + len(index)
    for k, (p, size) in enumerate(sums):
        arcs += [(0, 1 + k, size, e * (e + 1) // 2) for e in range(max_epochs)]
        arcs += [(1 + k, 1 + len(sums) + index[s], max_epochs * size, 0) for s in p]
    arcs += [(1 + len(sums) + i, end, round(q), 0) for i, q in enumerate(targets)]
    flow = min_cost_flow(end + 1, arcs, 0, end)
    routed = [0] * len(sums)
    for (u, v, _, _), f in zip(arcs, flow, strict=True):
        if u == 0:
            routed[v - 1] += f
    return routed


def repeat(docs: DataFrame, memberships: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (documents without words as often as their pattern's whole passes)."""
    # rows of equal id and size can differ in their epochs, so every row is numbered, for good, before the mix
    inner, name = numbered(docs.select("*", memberships.alias("pattern")))
    held = materialise(inner.withColumn("row_number", F.monotonically_increasing_id()))
    rows = held.select(F.col(name[id_col]).alias("id"), F.col(name[text_col]).alias("text"), F.col(inner.columns[-1]).alias("pattern"), "row_number")
    taken = _mixed(rows, ["row_number"], **how).where("epochs > 0").select("row_number", F.col("epochs").cast("int").alias("epochs"))
    copied = held.join(taken, "row_number").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("epochs"))))
    return copied.select(*inner.columns[:-1]).toDF(*docs.columns)
