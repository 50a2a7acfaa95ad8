"""Audits that put several screens together: residuals, model diversity, combined terms and identifier patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import products
from .models import fit_predict, out_of_fold, regressor, stratified_folds
from .ranks import with_ranks, zscore
from .statistics import partial, risk, safe_corr, screen, shift_moments, spearman, unpivot, with_average_ranks


def residual_audit(df: DataFrame, id_col: str, seed: str, features: Sequence[str], residual: str, is_test=None) -> DataFrame:
    """How each feature goes with a residual: rank correlation with its signed value and its size over all rows,
    mean and deviation of the signed one over seeds, the share of seeds that agree with its sign, and, with
    ``is_test``, the feature's SMD between splits and its risk."""
    labelled = df.where(F.col(residual).isNotNull()).withColumn("__size", F.abs(residual))
    long = unpivot(labelled, [id_col, seed, residual, "__size"], features)
    signed = spearman(long, residual).withColumnRenamed("spearman", "signed")
    size = spearman(long, "__size").withColumnRenamed("spearman", "absolute")
    each = spearman(long, residual, by=("feature", seed))
    by_seed = each.join(signed, "feature").groupBy("feature").agg(F.avg("spearman").alias("seed_mean"), F.stddev_pop("spearman").alias("seed_std"), F.avg((F.signum("spearman") == F.signum("signed")).cast("double")).alias("sign_agreement"))
    out = signed.join(size, "feature").join(by_seed, "feature")
    if is_test is None:
        return out
    shift = shift_moments(unpivot(df.withColumn("__t", is_test), ["__t"], features), F.col("__t"))
    return out.join(shift.select("feature", "smd"), "feature").withColumn("risk", risk(None, F.abs("smd")))


def stable(df: DataFrame, smd: str = "smd", gain: str = "gain", max_smd: float = 0.1, min_gain: float = 0.001) -> DataFrame:
    """Candidates that neither shift between splits nor gain too little."""
    return df.where((F.abs(smd) < max_smd) & (F.col(gain) >= min_gain))


def rank_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of the ranks of every two scores: how alike models order the rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(columns, 2)])).alias("r")).select("r.*")
    ranked = with_average_ranks(long, {"__x": "x", "__y": "y"}, ["pair"])
    return ranked.groupBy("pair").agg(safe_corr("__x", "__y").alias("r")).select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def planted_products(df: DataFrame, features: Sequence[str], target: str, top: int = 5) -> DataFrame:
    """The pair products that go best with the target by rank."""
    terms = products(features)
    long = df.select(target, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x")) for n, c in terms.items()])).alias("r")).select(target, "r.*")
    return spearman(long, target).orderBy(F.abs("spearman").desc(), "feature").limit(top)


def combined_score(df: DataFrame, id_col: str, features: Sequence[str], target: str, control: str, top: int = 3) -> DataFrame:
    """Sum of the z-scores of the features of highest partial correlation, each with its sign."""
    best = screen(df, id_col, features, target, control).orderBy(F.abs("partial").desc(), "feature").limit(top).collect()
    rows = zscore(df, [r["feature"] for r in best])
    terms = [F.lit(1.0 if r["partial"] >= 0 else -1.0) * F.col(f"{r['feature']}_z") for r in best]
    return rows.withColumn("combined", sum(terms[1:], terms[0]) if terms else F.lit(0.0)).select(*df.columns, "combined")


def linear_probe(df: DataFrame, id_col: str, features: Sequence[str], target: str, control: str, folds: int = 5, seed: int = 42, alpha: float = 20.0) -> float:
    """Partial correlation of an out-of-fold ridge score with the target, given the control."""
    rows = stratified_folds(df, id_col, target, folds, seed)
    n = rows.count()
    score = out_of_fold(rows, "fold", folds, lambda a, b: fit_predict(a, b, features, F.col(target), regressor("ridge", alpha=alpha, n=n), id_col, scale=True))
    long = unpivot(score.join(df.select(id_col, target, control), id_col), [id_col, target, control], ["score"])
    return float(partial(long, target, control).first()["partial"])


def pattern_search(df: DataFrame, id_col: str, label: str, moduli: Sequence[int], score: Callable[[DataFrame, list[str]], float]) -> DataFrame:
    """A model's score from nothing but remainders and floors of the id, for every modulus, best first."""
    rows = []
    for m in moduli:
        x = F.col(id_col)
        got = df.select(id_col, label, F.pmod(x, F.lit(m)).cast("double").alias("mod"), F.floor(x / m).cast("double").alias("div"))
        rows.append((int(m), float(score(got, ["mod", "div"]))))
    return df.sparkSession.createDataFrame(rows, "modulus int, score double").orderBy(F.desc("score"), "modulus")


def seed_vote(scores: DataFrame, id_col: str, seed: str, score: str) -> DataFrame:
    """How far seeds disagree about a row: least and largest percentile and their distance."""
    ranked = with_ranks(scores, score, id_col, within=[seed])
    return ranked.groupBy(id_col).agg(F.min("r_mid").alias("low"), F.max("r_mid").alias("high")).withColumn("spread", F.col("high") - F.col("low"))
