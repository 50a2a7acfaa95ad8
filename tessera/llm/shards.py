"""Operator 5: sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels. At each level every child draws
-ln(u) / weight, u a hash of the key and the child's name, and the least draw wins (weighted
rendezvous). A change of weights below one child moves rows only into or out of that
child: the draws of all other children stay what they were.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .store import Workspace

#: A tree: weights of shards by region and rack.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
LAW = "key"
BASE_SHARDS = 8
#: Rows ranked together when slots are dealt out.
BLOCK_ROWS = 100_000


def tree(shards: int, base: int = BASE_SHARDS) -> Tree:
    """Shards 0 to ``base`` - 1 in regions of two racks of two; each later one a region of its own,
    so that adding it takes rows only into itself."""
    out: dict[str, dict[str, dict[int, float]]] = {}
    for i in range(shards):
        region, rack = (f"r{i // 4}", f"k{i % 4 // 2}") if i < base else (f"x{i}", "k0")
        out.setdefault(region, {}).setdefault(rack, {})[i] = 1.0
    return out


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def descend(key: Column, node, name: str = "") -> Column:
    """The shard under ``node`` that ``key`` is dealt to."""
    if not isinstance(node, Mapping):
        return F.lit(None)
    children = [(f"{name}/{k}", k, v) for k, v in node.items() if _weight(v) > 0]
    found = [descend(key, v, n) if isinstance(v, Mapping) else F.lit(k) for n, k, v in children]
    if len(children) == 1:
        return found[0]
    draws = [_draw(key, n, _weight(v)) for n, _, v in children]
    least = F.array_position(F.array(*draws), F.array_min(F.array(*draws)))
    out = found[-1]
    for i in range(len(children) - 2, -1, -1):
        out = F.when(least == i + 1, found[i]).otherwise(out)
    return out


def slots(rows: DataFrame, group: str, ordered: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each ``group``.

    Rows are dealt into hashed blocks of about ``block_rows``; blocks are counted, their
    counts are summed up per group, and only the rows of one block are ranked together."""
    total = rows.count()
    blocks = max(1, -(-total // block_rows))
    named = rows.withColumn("__block", F.pmod(F.xxhash64(*ordered), F.lit(blocks)))
    counts = named.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, "__block", before.alias("__before"))
    ranked = named.withColumn("__rank", F.row_number().over(W.partitionBy(group, "__block").orderBy(*ordered)) - 1)
    return ranked.join(starts, [group, "__block"]).withColumn("slot", (F.col("__before") + F.col("__rank")).cast("long")).drop("__block", "__before", "__rank")


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, nodes: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """Placement of every row of ``docs`` under ``nodes`` (``tree(shards)`` if not given).

    The law is ``key``: the key and the tree decide. Rows that repeat a key go to the same
    shard; rows with a null key all go to the one that the draws give for null. A null text
    counts as empty. Ties in the order of slots (repeated rows) are broken by size and checksum.

    Returns the key, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``,
    ``slot`` (gapless from 0 per shard) and ``grown_shard`` (under ``grown``, one shard more
    by default)."""
    ws = Workspace(docs.sparkSession, "shards")
    nodes, grown = nodes or tree(shards), grown or tree(shards + 1)
    body = F.coalesce(F.col(text), F.lit(""))
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("__key"), (F.octet_length(body) + F.lit(1).cast("long")).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"), descend(k, nodes).cast("int").alias("shard"), descend(k, grown).cast("int").alias("grown_shard"),
    )
    rows = ws.save(rows, "placed")
    return slots(rows, "shard", ["__key", "size", "text_crc32"]).select(F.col("__key").alias(key), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
