"""Counts, contingency, group statistics and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .ranks import exact_quantiles


def value_counts(df: DataFrame, key: str, domain: Sequence | None = None) -> DataFrame:
    """Rows per value; over a ``domain`` absent values count 0 and others are left out."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    if domain is None:
        return counts
    wanted = df.sparkSession.createDataFrame([(x,) for x in domain], f"{key} {df.schema[key].dataType.simpleString()}")
    return wanted.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def crosstab(df: DataFrame, rows: str, columns: str, domain: Sequence) -> DataFrame:
    """Dense contingency in long form: every pair of ``domain`` with its count."""
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    sides = F.array(*[F.lit(x) for x in domain])
    kind = df.schema[rows].dataType.simpleString()
    sides = sides.cast(f"array<{kind}>")
    grid = df.sparkSession.range(1).select(F.explode(sides).alias(rows)).withColumn(columns, F.explode(sides))
    return grid.join(counts, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def delta_counts(df: DataFrame, old: str, new: str) -> DataFrame:
    """How often the label moved by how much."""
    return df.groupBy((F.col(new) - F.col(old)).alias("delta")).agg(F.count("*").alias("n"))


def target_encoding(df: DataFrame, key: str, label: str, classes: Sequence[int], smoothing: float = 10.0) -> tuple[DataFrame, dict[int, float]]:
    """Class shares per key, drawn towards the overall shares as by ``smoothing`` further rows; and those."""
    is_c = lambda c: F.count_if(F.col(label) == c)
    total = df.agg(F.count("*").alias("n"), *[is_c(c).alias(f"c{c}") for c in classes]).first()
    prior = {c: total[f"c{c}"] / total["n"] if total["n"] else 0.0 for c in classes}
    table = df.groupBy(key).agg(*[((is_c(c) + F.lit(smoothing * prior[c])) / (F.count("*") + F.lit(smoothing))).alias(f"te_{c}") for c in classes])
    return table, prior


def encode(df: DataFrame, key: str, table: DataFrame, prior: dict[int, float]) -> DataFrame:
    """``df`` with encoded columns; keys that weren't seen get the overall shares."""
    joined = df.join(table, key, "left")
    return joined.withColumns({f"te_{c}": F.coalesce(F.col(f"te_{c}"), F.lit(p)) for c, p in prior.items()})


def encode_out_of_fold(df: DataFrame, key: str, label: str, fold: str, classes: Sequence[int], smoothing: float = 10.0) -> DataFrame:
    """Each row encoded from the other folds only: totals less the fold's own, in two aggregates."""
    sums = [F.count("*").alias("n"), *[F.count_if(F.col(label) == c).alias(f"c{c}") for c in classes]]
    names = ["n", *[f"c{c}" for c in classes]]
    by = lambda keys, prefix: df.groupBy(*keys).agg(*[s.alias(prefix + x) for s, x in zip(sums, names)])
    out = df.join(by([key], "k_"), key).join(by([key, fold], "kf_"), [key, fold])
    out = out.join(F.broadcast(by([fold], "f_")), fold).crossJoin(F.broadcast(df.agg(*[s.alias("t_" + x) for s, x in zip(sums, names)])))  # folds; one row
    rest = lambda x, a, b: F.col(f"{a}_{x}") - F.col(f"{b}_{x}")
    encoded = {}
    for c in classes:
        prior = F.try_divide(rest(f"c{c}", "t", "f"), rest("n", "t", "f"))
        encoded[f"te_{c}"] = (rest(f"c{c}", "k", "kf") + F.lit(smoothing) * prior) / (rest("n", "k", "kf") + F.lit(smoothing))
    return out.withColumns(encoded).select(*df.columns, *encoded)


def contrast(df: DataFrame, features: Sequence[str], group: Column) -> DataFrame:
    """Mean and median of features inside and outside a group and the difference of means, a row per feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    long = df.select(group.alias("__in"), F.explode(pairs).alias("r")).where("__in is not null").select("__in", "r.feature", "r.x")
    inside, outside = F.when(F.col("__in"), F.col("x")), F.when(~F.col("__in"), F.col("x"))
    rows = long.groupBy("feature").agg(F.avg(inside).alias("mean_in"), F.avg(outside).alias("mean_out"))
    half = lambda test, name: exact_quantiles(long.where(test), [0.5]).select("feature", F.get("q", F.lit(0)).alias(name))
    rows = rows.join(half("__in", "median_in"), "feature", "left").join(half("not __in", "median_out"), "feature", "left")
    return rows.withColumn("delta", F.col("mean_in") - F.col("mean_out")).select("feature", "mean_in", "mean_out", "median_in", "median_out", "delta")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, quartiles, missing and distinct values, a row per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.explode(pairs).alias("r")).select("r.feature", "r.x")
    rows = long.groupBy("feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count_if(F.col("x").isNull()).alias("missing"))
    q = exact_quantiles(long, [0.25, 0.5, 0.75])
    at = lambda i: F.get("q", F.lit(i))
    both = rows.join(q.drop("n"), "feature", "left")
    return both.select("feature", "n", "mean", "std", "min", at(0).alias("q25"), at(1).alias("q50"), at(2).alias("q75"), "max", "missing", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def cluster_majority(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Size, most frequent label (the smallest on ties) and its count per cluster."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    best = F.max_by(F.col(label), F.struct("n", -F.col(label)))
    return counts.groupBy(cluster).agg(F.sum("n").alias("size"), best.alias("majority"), F.max("n").alias("majority_n"))


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of rows whose label is their cluster's majority, and the number of clusters."""
    return cluster_majority(df, cluster, label).agg((F.sum("majority_n") / F.sum("size")).alias("purity"), F.count("*").alias("n_clusters"))


def group_mode(df: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label per key and over all as ``fallback`` (the smallest on ties)."""
    overall = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.max_by(F.col(label), F.struct("n", -F.col(label))).alias("fallback"))
    return cluster_majority(df, key, label).select(key, "majority").crossJoin(F.broadcast(overall))  # one row


def accuracy(prediction: Column, label: Column) -> Column:
    return F.avg((prediction == label).cast("double"))


def within_one(prediction: Column, label: Column) -> Column:
    return F.avg((F.abs(prediction - label) <= 1).cast("double"))


def errors_by(df: DataFrame, key: str, prediction: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(prediction) != F.col(label)).alias("errors"))


def score_summary(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean, population deviation and least of a score per configuration."""
    return df.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"))


def fold_scores(df: DataFrame, fold: str, prediction: str, label: str) -> DataFrame:
    """Accuracy by fold and, with a null fold, over all rows."""
    return df.rollup(fold).agg(accuracy(F.col(prediction), F.col(label)).alias("accuracy"), F.count("*").alias("n"))


def decimals(c: Column) -> Column:
    """Decimal places of a number as it prints with ten at most."""
    return F.length(F.regexp_replace(F.regexp_extract(F.format_string("%.10f", c.cast("double")), r"\.(\d+)$", 1), "0+$", ""))


def grid_profile(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Distinct values, most decimals, least positive step and whether all are whole, a row per column.

    Steps are taken between neighbours of the sorted distinct values of one column at a time."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*").where("x is not null").distinct()
    step = F.col("x") - F.lag("x").over(W.partitionBy("feature").orderBy("x"))
    rows = long.withColumn("step", F.when(step > tolerance, step))
    return rows.groupBy("feature").agg(F.count("*").alias("n_distinct"), F.max(decimals(F.col("x"))).alias("max_decimals"), F.min("step").alias("min_step"), F.bool_and(F.col("x") == F.floor("x")).alias("is_integer"))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows agree with another in all ``columns``."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("duplicates"))


def pooled_ar1(df: DataFrame, series: str, by: str) -> DataFrame:
    """First-order coefficient over all pairs of neighbours of a group's series, and the deviation of what is left."""
    from ..functions.arrays import head, tail_from

    a = F.col(series)
    pairs = df.select(by, F.explode(F.arrays_zip(head(a, F.greatest(F.size(a) - 1, F.lit(0))).alias("x"), tail_from(a, 1).alias("y"))).alias("p")).select(by, "p.x", "p.y")
    return pairs.groupBy(by).agg(F.regr_slope("y", "x").alias("coef"), F.sqrt(F.var_pop("y") - F.pow(F.covar_pop("x", "y"), F.lit(2)) / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("innovation_std"))
