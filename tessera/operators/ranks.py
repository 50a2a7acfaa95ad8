"""Ranks, quantile bins and z-scores across rows.

A global rank needs a global order, but not all rows in one task: rows are split by ranges of the
order, numbered within each range, and the ranges' sizes are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import pin


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with its range ``__p``, its place ``__at`` from 1, and the range's first and last place ``__from``, ``__to``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = pin(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range
    starts = split.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", (before + 1).alias("__from"), (before + F.col("__n")).alias("__to"))
    inside = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    return split.withColumn("__r", inside).join(F.broadcast(starts), "__p").withColumn("__at", (F.col("__r") + F.col("__from") - 1).cast("long")).drop("__r")


def with_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 1, in ascending order of ``order`` (nulls first)."""
    return _placed(df, order).withColumnRenamed("__at", name).drop("__p", "__from", "__to")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """``keys`` of the left equal ``__k_*`` of the right, nulls being equal."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"__k_{k}"])
    return out


def _sizes(placed: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows of each group and the place before its first."""
    return placed.groupBy(*[F.col(k).alias(f"__k_{k}") for k in within]).agg((F.min("__at") - 1).alias("__rk_before"), F.count("*").alias("__rk_n"))


def places_within(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "place", size: str | None = None) -> DataFrame:
    """``df`` with each row's place, from 1, in its group, and the group's ``size`` if named.

    Rows are split by ranges of group and order together, so that a group of any size is spread over many tasks."""
    placed = _placed(df, [*within, *order])
    sizes = _sizes(placed, within)
    out = placed.join(sizes, same(placed, sizes, within)).withColumn(name, F.col("__at") - F.col("__rk_before"))
    kept = [*df.columns, name]
    if size:
        out, kept = out.withColumn(size, F.col("__rk_n")), [*kept, size]
    return out.select(*kept)


def with_ranks(df: DataFrame, value: str, id_col: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``r_first`` (ties in order of ids), ``r_avg`` (ties share their mean), ``r_pct`` (r_avg / n),
    ``r_mid`` ((r_avg - 0.5) / n) and ``n_ranked``, over all rows or ``within`` groups.

    Rows whose value is null have null ranks and don't count. No group and no value is one task's: rows are split by ranges
    of group, value and id, ties are looked for within ranges, and those that cross a range's border (two values per range at most) are
    put together afterwards."""
    known, missing = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    keys = [*within, value]
    placed = _placed(known, [*keys, id_col])
    tied = W.partitionBy("__p", *keys)
    placed = placed.withColumns({"__rk_lo": F.min("__at").over(tied), "__rk_hi": F.max("__at").over(tied)})
    borders = placed.where((F.col("__rk_lo") == F.col("__from")) | (F.col("__rk_hi") == F.col("__to")))
    borders = borders.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.min("__rk_lo").alias("__rk_first"), F.max("__rk_hi").alias("__rk_last"))
    out = placed.join(F.broadcast(borders), same(placed, borders, keys), "left")
    out = out.withColumn("r_avg", (F.coalesce("__rk_first", "__rk_lo") + F.coalesce("__rk_last", "__rk_hi")) / 2)
    if within:
        sizes = _sizes(placed, within)
        out = out.drop(*[f"__k_{k}" for k in keys])
        out = out.join(sizes, same(out, sizes, within))
    else:
        out = out.crossJoin(F.broadcast(known.agg(F.lit(0).alias("__rk_before"), F.count("*").alias("__rk_n"))))  # one row
    out = out.withColumns({"r_first": (F.col("__at") - F.col("__rk_before")).cast("long"), "n_ranked": F.col("__rk_n"), "r_avg": F.col("r_avg") - F.col("__rk_before")})
    out = out.withColumns({"r_pct": F.col("r_avg") / F.col("n_ranked"), "r_mid": (F.col("r_avg") - 0.5) / F.col("n_ranked")})
    return out.select(*df.columns, "r_first", "r_avg", "n_ranked", "r_pct", "r_mid").unionByName(missing, allowMissingColumns=True)


def exact_quantiles(long: DataFrame, ps: Sequence[float], by: str = "feature", value: str = "x") -> DataFrame:
    """``by``, ``n``, ``n_distinct`` and ``q``, the linearly interpolated quantiles ``ps`` of a long frame's values; nulls don't count.

    Values are counted first, distinct ones are split by ranges and running counts added up, so that no task holds
    all values of a group. Groups without a value have no row."""
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = long.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__b"), F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    split = pin(known.repartitionByRange(parts, "__b", "__x").withColumn("__p", F.spark_partition_id()))
    ranges = split.groupBy("__b", "__p").agg(F.sum("__c").alias("__s"), F.count("*").alias("__d"))  # each group lies in consecutive ranges
    before = F.coalesce(F.sum("__s").over(W.partitionBy("__b").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = ranges.groupBy("__b").agg(F.sum("__s").alias("n"), F.sum("__d").alias("n_distinct"))
    places = lambda n: F.array(*[F.floor((n - 1) * F.lit(float(p))).cast("long") + k for p in ps for k in (0, 1)])
    offsets = ranges.select("__b", "__p", before.alias("__before")).join(sizes, "__b")
    inside = F.sum("__c").over(W.partitionBy("__p", "__b").orderBy("__x"))
    rows = split.withColumn("__upto", inside).join(offsets, ["__b", "__p"]).withColumn("__upto", F.col("__upto") + F.col("__before"))
    hit = F.filter(F.array_distinct(places(F.col("n"))), lambda i: (i < F.col("__upto")) & (i >= F.col("__upto") - F.col("__c")))
    found = rows.select("__b", "n", "n_distinct", "__x", F.explode(hit).alias("__i")).groupBy("__b", "n", "n_distinct").agg(F.map_from_entries(F.collect_list(F.struct("__i", "__x"))).alias("__m"))  # two values a quantile

    def one(p: float) -> Column:
        h = (F.col("n") - 1) * F.lit(float(p))
        lo = F.floor(h).cast("long")
        low = F.col("__m")[lo]
        return low + (h - lo) * (F.coalesce(F.col("__m")[lo + 1], low) - low)

    return found.select(F.col("__b").alias(by), "n", "n_distinct", F.array(*[one(p) for p in ps]).alias("q"))


def rank_then_z(df: DataFrame, value: str, id_col: str, within: Sequence[str] = (), eps: float = 1e-12, name: str = "rank_z") -> DataFrame:
    """``df`` with the z-score of each row's average rank within its group; null where the value is null."""
    ranked = with_ranks(df, value, id_col, within)
    n = F.col("n_ranked")
    # mean and deviation of ranks with ties: the mean is that of 1..n, the deviation is an aggregate
    spread = ranked.where(F.col("r_avg").isNotNull()).groupBy(*[F.col(k).alias(f"__k_{k}") for k in within]).agg(F.stddev_pop("r_avg").alias("__rk_s"))
    joined = ranked.join(spread, same(ranked, spread, within), "left") if within else ranked.crossJoin(F.broadcast(spread))
    return joined.withColumn(name, (F.col("r_avg") - (n + 1) / 2) / (F.col("__rk_s") + F.lit(eps))).select(*df.columns, name)


def quartile_bin(rank: Column, n: Column, classes: int = 4) -> Column:
    """floor(rank / (n + 1) * classes), rank from 1."""
    return F.least(F.floor(rank / (n + 1) * classes), F.lit(classes - 1)).cast("int")


def quartile_label(rank: Column, n: Column, classes: int = 4) -> Column:
    """floor((rank - 1) * classes / n)."""
    return F.least(F.floor((rank - 1) * classes / n), F.lit(classes - 1)).cast("int")


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of columns, from one pass."""
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return {c: (row[c]["m"], row[c]["s"]) for c in columns}


def zscore(df: DataFrame, columns: Sequence[str], eps: float = 1e-12, guarded: bool = False, fitted: dict | None = None, suffix: str = "_z") -> DataFrame:
    """``df`` with (x - mean) / (deviation + eps) of columns; ``guarded`` gives 0 where there is no spread.

    ``fitted`` moments of another frame may be given."""
    fitted = fitted or moments(df, columns)
    out = {}
    for c in columns:
        m, s = fitted[c]
        out[c + suffix] = F.lit(0.0) if guarded and (s is None or s < 1e-12) else (F.col(c) - F.lit(m)) / F.lit((s or 0.0) + (0.0 if guarded else eps))
    return df.withColumns(out)


def zscore_within(value: str, within: Sequence[str], eps: float = 1e-12) -> Column:
    w = W.partitionBy(*within)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(eps))


def rank_average(scores: DataFrame, id_col: str, seed: str, score: str, method: str = "first") -> DataFrame:
    """Mean over seeds of each row's rank within the seed; ``method`` is ``first`` or ``average``."""
    ranked = with_ranks(scores, score, id_col, within=[seed])
    return ranked.groupBy(id_col).agg(F.avg("r_first" if method == "first" else "r_avg").alias("avg_rank"))


def midpoint(label: Column, classes: int = 4) -> Column:
    """Where the middle of a class lies among percentiles."""
    return (label + F.lit(0.5)) / classes


def boundary_distance(percentile: Column, classes: int = 4) -> Column:
    return F.least(*[F.abs(percentile - F.lit(i / classes)) for i in range(1, classes)])
