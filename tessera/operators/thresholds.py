"""Cutting scores into ordered labels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .ranks import exact_quantiles, with_ranks


def quartile_thresholds(df: DataFrame, score: str, classes: int = 4) -> list[float]:
    """Linearly interpolated quantiles that cut the scores into equal parts."""
    found = exact_quantiles(df.select(F.lit(0).alias("feature"), F.col(score).alias("x")), [i / classes for i in range(1, classes)]).first()
    return found["q"] if found else None


def apply_thresholds(score: Column, cuts: Sequence[float], right_closed: bool = True) -> Column:
    """Number of cuts below the score (``right_closed``), or not above it. Raises if cuts fall."""
    if any(b < a for a, b in zip(cuts, cuts[1:])):
        raise ValueError("thresholds must not fall")
    out = F.lit(0)
    for c in cuts:
        out = out + ((score > c) if right_closed else (score >= c)).cast("int")
    return out


def offset_grid(values: Sequence[int], cuts: int = 3) -> list[tuple[int, ...]]:
    """All tuples of offsets, the smallest in sum of magnitudes first, then in order."""
    return sorted(product(values, repeat=cuts), key=lambda o: (sum(map(abs, o)), o))


def offset_accuracy(df: DataFrame, score: str, label: str, id_col: str, offsets: Sequence[tuple[int, ...]], classes: int = 4) -> DataFrame:
    """Accuracy and class counts for labels cut at places n * k / classes + offset in order of scores.

    Rows are placed once; how many of each class come before a place is a table of running counts, and
    each combination is three look-ups in it, whatever the number of rows."""
    placed = with_ranks(df, score, id_col)
    n = df.count()
    cuts = sorted({min(max(n * (k + 1) // classes + o, 0), n) for offs in offsets for k, o in enumerate(offs)} | {0, n})
    edges = F.array(*[F.lit(c) for c in cuts])
    piece = F.size(F.filter(edges, lambda e: e < F.col("r_first")))
    counts = placed.groupBy(piece.alias("piece"), F.col(label).alias("c")).agg(F.count("*").alias("n")).collect()  # at most len(cuts) * classes rows
    before = {c: {cut: sum(r["n"] for r in counts if r["c"] == c and r["piece"] <= i) for i, cut in enumerate(cuts)} for c in range(classes)}
    rows = []
    for offs in offsets:
        at = [0]
        for k, o in enumerate(offs):
            at.append(max(at[-1], min(max(n * (k + 1) // classes + o, 0), n)))
        at.append(n)
        hit = sum(before[c][at[c + 1]] - before[c][at[c]] for c in range(classes))
        rows.append((*map(int, offs), hit / n if n else 0.0, [at[c + 1] - at[c] for c in range(classes)]))
    names = ", ".join(f"o{k + 1} int" for k in range(classes - 1))
    return df.sparkSession.createDataFrame(rows, f"{names}, accuracy double, counts array<int>")


def learn_offsets(table: DataFrame) -> tuple[int, ...]:
    """The offsets of highest accuracy, the smallest on ties."""
    cols = [c for c in table.columns if c.startswith("o")]
    size = sum((F.abs(c) for c in cols[1:]), F.abs(cols[0]))
    row = table.orderBy(F.desc("accuracy"), size, *cols).first()
    return tuple(row[c] for c in cols)


def passes_balance(counts: Column, target: float, drift: float) -> Column:
    """Whether every class's count is within ``drift`` of ``target``."""
    return F.forall(counts, lambda c: F.abs(c - F.lit(target)) <= drift)


def shift_labels(percentile: Column, correction: Column, alpha: float) -> Column:
    """A percentile moved by a weighted correction, within 0 and 1."""
    return F.least(F.greatest(percentile + F.lit(alpha) * correction, F.lit(0.0)), F.lit(1.0))


def best_config(df: DataFrame, mean: str, std: str, alpha: str, method: str, order: Sequence[str]) -> DataFrame:
    """Highest mean, then least deviation, least weight and first method."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(method))
    return df.orderBy(F.desc(mean), F.asc(std), F.abs(alpha), place).limit(1)


def promoted(df: DataFrame, config: str, seed: str, score: str, baseline: str, gain: float = 0.001, seeds: int = 3) -> DataFrame:
    """Whether a configuration gains enough over the baseline on the mean and on so many seeds."""
    delta = F.col(score) - F.first(F.when(F.col(config) == baseline, F.col(score)), ignorenulls=True).over(W.partitionBy(seed))
    rows = df.withColumn("delta", delta).where(F.col(config) != baseline)
    return rows.groupBy(config).agg(F.avg("delta").alias("gain"), F.count_if(F.col("delta") > 0).alias("improved")).withColumn("promoted", (F.col("gain") >= gain) & (F.col("improved") >= seeds))
