"""Joins, overlaps, comparisons of prediction sets and same-label pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import places_within, with_positions
from .vectors import packer, searcher

#: Blocks of vectors in a partition: a task holds so many of one side in memory, 0.5 MB each (64 floats, 2,048 rows).
PARTITION_BLOCKS = 32


def zip_by_id(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Rows of two frames side by side; raises if their ids aren't the same."""
    a, b = left.select(id_col), right.select(id_col)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError(f"the frames differ in {id_col}")
    return left.join(right, id_col)


def lookup(df: DataFrame, key: str, table: DataFrame, value: str, default) -> DataFrame:
    """``df`` with ``value`` of ``table`` (one row per key), or ``default``."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def overlap(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows of each side occur in the other, and how many repeat within their own side.

    Both sides are counted per distinct row, then met once; nulls equal nulls."""
    zero = F.lit(0).cast("long")
    counts = train.groupBy(*columns).agg(F.count("*").alias("__a")).withColumn("__b", zero)
    counts = counts.unionByName(test.groupBy(*columns).agg(F.count("*").alias("__b")).withColumn("__a", zero))
    both = counts.groupBy(*columns).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    total = lambda n, cond: F.coalesce(F.sum(F.when(cond, F.col(n))), zero).cast("long")
    met, a, b = (F.col("__a") > 0) & (F.col("__b") > 0), F.col("__a"), F.col("__b")
    return both.agg(total("__a", met).alias("overlap_train"), total("__b", met).alias("overlap_test"), total("__a", a > 1).alias("duplicates_train"), total("__b", b > 1).alias("duplicates_test"))


def nearest(train: DataFrame, test: DataFrame, id_col: str, vector: str, block: int = 2048) -> DataFrame:
    """Nearest row of ``train`` for every row of ``test`` by Euclidean distance, the smallest id on ties; no row if ``train`` is empty.

    Places that one of two vectors lacks are left out of their distance; where they share none it is null, which comes after NaN, the
    largest number. Both sides are packed into blocks of up to ``block`` rows; every two blocks meet in a matrix product
    (``operators/vectors.py``) and the best over blocks is kept."""
    floats = all(isinstance(x.schema[vector].dataType.elementType, T.FloatType) for x in (train, test))
    dtype, element = ("<f4", "float") if floats else ("<f8", "double")
    kind = lambda x: x.schema[id_col].dataType.simpleString()

    def packed(df: DataFrame, once: bool) -> DataFrame:
        blocks = max(1, -(-df.count() // block))
        parts = max(min(blocks, df.sparkSession.sparkContext.defaultParallelism), -(-blocks // PARTITION_BLOCKS))
        rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast(f"array<{element}>").alias("v")).repartition(parts)
        rows = (rows.sortWithinPartitions("id") if once else rows).mapInArrow(packer(block, dtype, once), f"ids array<{kind(df)}>, width int, v binary, missing binary")
        return rows.withColumn("k", F.monotonically_increasing_id()).repartition(parts)  # written once, read by many tasks

    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    pairs = side(packed(test, False), "a").crossJoin(side(packed(train, True), "b").drop("b_k").hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(searcher(dtype), f"id {kind(test)}, none boolean, dist double, nn {kind(train)}")
    best = found.groupBy("id").agg(F.min(F.struct("none", "dist", "nn")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("b.nn").alias("nn_id"), F.when(~F.col("b.none"), F.col("b.dist")).alias("dist"))


def compare_predictions(old: DataFrame, new: DataFrame, id_col: str, label: str) -> DataFrame:
    """Ids with ``old``, ``new`` and whether they differ; raises if the ids aren't the same."""
    return zip_by_id(old.select(id_col, F.col(label).alias("old")), new.select(id_col, F.col(label).alias("new")), id_col).withColumn("changed", F.col("old") != F.col("new"))


def rows_common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have."""
    return a.intersect(b)


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name."""
    return a.unionByName(b)


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty()


def are_disjoint(a: DataFrame, b: DataFrame) -> bool:
    return a.intersect(b).isEmpty()


def draw(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from an MD5 of the parts and the seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def mixup(df: DataFrame, id_col: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), counts: tuple[str, str] | None = None, factor: float = 0.25, low: float = 0.25, high: float = 0.75, seed: int = 0) -> DataFrame:
    """``df`` and synthetic rows, ``factor`` times as many per label, each between two rows of that label.

    Numbers are weighted means with a weight from ``low`` to ``high``, categories come from the first donor, and of
    the completed and assigned ``counts`` (whole numbers) the first is not above the second. New ids are
    negative, below all of ``df``'s. Donors are dealt by seeded places within labels: a factor of 0 leaves ``df`` as it is."""
    if factor <= 0:
        return df
    spots = df.withColumn("__o", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")))
    spots = places_within(spots, [label], ["__o", id_col], "__i").withColumn("__i", F.col("__i") - 1).drop("__o")
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    wanted = sizes.withColumn("__k", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__n") * factor).cast("int"))))
    # new rows are numbered through all labels: no two ids are equal, and none is one of ``df``'s
    lowest = F.broadcast(df.agg(F.least(F.coalesce(F.min(F.col(id_col).cast("long")), F.lit(0)), F.lit(0)).alias("__low")))  # one row
    wanted = with_positions(wanted.where(F.col("__k") <= F.round(F.col("__n") * factor)), [label, "__k"], "__new").crossJoin(lowest)
    wanted = wanted.withColumns({"__a": F.floor(draw(seed + 1, label, "__k") * F.col("__n")), "__b": F.floor(draw(seed + 2, label, "__k") * F.col("__n")), "__w": F.lit(low) + F.lit(high - low) * draw(seed + 3, label, "__k")})
    side = lambda p: spots.select(F.col(label).alias(f"{p}_label"), F.col("__i").alias(f"{p}_i"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != label])
    a, b = side("a"), side("b")
    pairs = wanted.join(a, (F.col(label) == F.col("a_label")) & (F.col("__a") == F.col("a_i"))).join(b, (F.col(label) == F.col("b_label")) & (F.col("__b") == F.col("b_i")))
    out = []
    blend = lambda c: F.col("__w") * F.col(f"a_{c}") + (1 - F.col("__w")) * F.col(f"b_{c}")
    for c in df.columns:
        kind = df.schema[c].dataType.simpleString()
        if c == id_col:
            out.append((F.col("__low") - F.col("__new")).cast(kind).alias(c))
        elif c == label:
            out.append(F.col(label))
        elif counts and c in counts:
            given = F.round(blend(counts[1]))
            out.append((given if c == counts[1] else F.greatest(F.lit(0.0), F.least(F.round(blend(c)), given))).cast(kind).alias(c))
        elif c in numeric:
            out.append(blend(c).cast(kind).alias(c))
        else:
            out.append(F.col(f"a_{c}").alias(c))
    return df.unionByName(pairs.select(*out))
