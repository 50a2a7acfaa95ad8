"""Operator 8: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they count for). Words
flow from patterns to source quotas; a pattern's first pass costs nothing, each further pass
costs more (convex), so nothing is repeated while unread words can serve. Only patterns and
sources reach the driver, never documents. What a pattern is to give is then taken from its
documents in a seeded order, by histogram: no source's documents meet in one task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .store import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
PASSES = 2
SEED = "mix-1"
#: Hash bins of a pattern when its documents are put in order: 16 ** DIGITS.
DIGITS = 3


@dataclass
class Flow:
    """Min-cost flow by successive shortest paths; capacities are whole words."""

    n: int
    graph: list[list[int]] = field(default_factory=list)
    to: list[int] = field(default_factory=list)
    cap: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.graph = [[] for _ in range(self.n)]

    def add(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.graph[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        potential = [0] * self.n
        while True:
            far, via = [None] * self.n, [-1] * self.n
            far[source] = 0
            queue = [(0, source)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.graph[a]:
                    b = self.to[e]
                    if self.cap[e] > 0 and (far[b] is None or d + self.cost[e] + potential[a] - potential[b] < far[b]):
                        far[b], via[b] = d + self.cost[e] + potential[a] - potential[b], e
                        heapq.heappush(queue, (far[b], b))
            if far[sink] is None:
                return
            potential = [p + (d or 0) if d is not None else p for p, d in zip(potential, far)]
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            most = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= most
                self.cap[e ^ 1] += most


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, passes: int = PASSES) -> list[float]:
    """Shares of ``total`` by weight, none above ``passes`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / weight > passes * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(passes * sizes[i])
            open_.discard(i)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def route(patterns: Sequence[tuple[tuple[int, ...], int]], quotas: Sequence[int], passes: int = PASSES) -> list[int]:
    """Words each pattern (its sources and its size) gives when quotas are met at the least repetition."""
    p, q = len(patterns), len(quotas)
    net = Flow(p + q + 2)
    arcs = []
    for i, (members, size) in enumerate(patterns):
        arcs.append([net.add(p + q, i, size, c) for c in range(passes)])
        for s in members:
            net.add(i, p + s, passes * size, 0)
    for s, quota in enumerate(quotas):
        net.add(p + s, p + q + 1, quota, 0)
    net.run(p + q, p + q + 1)
    return [sum(net.cap[e ^ 1] for e in own) for own in arcs]


def cuts(rows: DataFrame) -> DataFrame:
    """Where each pattern's rest ends: ``pattern``, ``cut_order``, ``cut_size``, ``left`` words and ``ties``.

    ``rows`` have ``pattern``, ``size``, ``order`` (hex digits) and ``rest``, the words that the pattern gives beyond
    its full passes. Sizes are summed in bins of the order's first digits, and rows are put in order only
    within the bin in which the rest ends. Patterns without a rest have no row."""
    rows = rows.where("rest > 0 and size > 0").withColumn("bin", F.substring("order", 1, DIGITS))
    bins = rows.groupBy("pattern", "bin", "rest").agg(F.sum("size").alias("s"))
    over = lambda order: W.partitionBy("pattern").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("s").over(over(["bin"])), F.lit(0))).where("before < rest and rest <= before + s")
    inside = rows.join(bins.select("pattern", "bin", "before"), ["pattern", "bin"]).groupBy("pattern", "rest", "before", "order", "size").agg(F.count("*").alias("ties"))
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("ties") * F.col("size")).over(over(["order", "size"])), F.lit(0)))
    last = inside.where("at < rest and rest <= at + ties * size")
    return last.select("pattern", F.col("order").alias("cut_order"), F.col("size").alias("cut_size"), (F.col("rest") - F.col("at")).alias("left"), "ties")


def taken() -> Column:
    """Words taken of a row: full passes, and one more of the rows that come before the cut; the row at
    the cut gives the words that are missing, in equal parts if it is repeated."""
    here = F.struct(F.col("order").alias("o"), F.col("size").alias("s"))
    cut = F.struct(F.col("cut_order").alias("o"), F.col("cut_size").alias("s"))
    extra = F.when(F.col("cut_order").isNull(), 0).when(here < cut, F.col("size")).when(here == cut, F.floor(F.col("left") / F.col("ties"))).otherwise(0)
    return (F.col("passes") * F.col("size") + extra).cast("long")


def _measure(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = SEED, carry: Sequence[str] = ()
) -> DataFrame:
    """How many words the mix takes of every row of ``docs``.

    ``source`` is a string, or an array of strings where documents count for several sources;
    sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` times all
    words. ``target`` is that of the row's source (of its first, for arrays). A null text has no words; an empty
    table gives no row; rows that repeat a key are rows of their own, ties in the seeded order fall to key and size. Reruns agree: the
    order is an MD5 of seed and key. The driver holds one entry per source and pattern, no document.

    Returns the key, ``size``, ``source_size``, ``target``, ``taken`` and the columns ``carry``."""
    ws = Workspace(docs.sparkSession, "mix")
    spark = docs.sparkSession
    many = docs.schema[source].dataType.typeName() == "array"
    names = F.coalesce(F.array_sort(F.array_distinct(F.col(source))), F.array().cast("array<string>")) if many else F.array(F.col(source))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    # a pattern's name tells null and separators inside names apart
    pattern = F.to_json(F.struct(F.transform(names, lambda x: F.struct(x.alias("s"))).alias("m")))
    measured = docs.select(F.col(key).alias("key"), *[F.col(c).alias(f"c_{c}") for c in carry], names.alias("members"), pattern.alias("pattern"), _measure(F.col(text)).alias("size"), order.alias("order"))
    rows = ws.save(measured.select("key", "members", "pattern", "size", "order"), "rows")
    found = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("whole")).collect()
    known = sorted({s for x in found for s in x["members"]}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    place = {s: i for i, s in enumerate(known)}
    sizes = [0] * len(known)
    for x in found:
        for s in x["members"]:
            sizes[place[s]] += x["whole"]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(known))], share * sum(x["whole"] for x in found), passes)
    gives = route([(tuple(place[s] for s in x["members"]), x["whole"]) for x in found], [math.floor(g + 0.5) for g in goal], passes)
    table = []
    for x, g in zip(found, gives):
        i = place[x["members"][0]] if x["members"] else None
        full = g // x["whole"] if x["whole"] else 0
        table.append((x["pattern"], full, g - full * x["whole"], sizes[i] if i is not None else 0, goal[i] if i is not None else 0.0))
    # written, so that the planner knows their sizes
    table = ws.save(spark.createDataFrame(table, "pattern string, passes long, rest long, source_size long, target double").coalesce(1), "table")
    ends = cuts(rows.join(table.select("pattern", "rest"), "pattern")).collect()  # a row per pattern at most
    ends = spark.createDataFrame(ends, "pattern string, cut_order string, cut_size long, left long, ties long").coalesce(1)
    table = ws.save(table.join(ends, "pattern", "left"), "decided")
    # what decides is a row per pattern: documents meet it where they are, with all their columns
    out = (measured if carry else rows).join(table, "pattern")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", taken().alias("taken"), *[F.col(f"c_{c}").alias(c) for c in carry])
