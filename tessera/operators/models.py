"""Folds, ordinal rankers, blends and clusters on Spark MLlib."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import pin
from .aggregates import cluster_majority
from .ranks import places_within, quartile_bin, quartile_label, rank_then_z, with_positions, with_ranks, zscore_within
from .relations import draw
from .statistics import safe_corr


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """``df`` with folds of equal class shares: rows of a class are dealt in order of an MD5 of id and seed."""
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    placed = places_within(df.withColumn("__order", order), [label], ["__order", id_col], "__place")
    return placed.withColumn(name, F.pmod(F.col("__place") - 1, F.lit(folds)).cast("int")).drop("__order", "__place")


def assemble(features: Sequence[str], scale: bool = False) -> list:
    """Stages that put features into ``features``, standardised if asked."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw_features" if scale else "features", handleInvalid="error")]
    return stages + ([StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)] if scale else [])


def classifier(kind: str, seed: int = 42, trees: int = 20, depth: int = 4):
    match kind:
        case "logistic":
            return LogisticRegression(labelCol="y", regParam=0.01, maxIter=50)
        case "forest":
            return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)
        case "gbt":  # two classes only
            return GBTClassifier(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    raise ValueError(kind)


def regressor(kind: str, seed: int = 42, trees: int = 20, depth: int = 4, alpha: float = 10.0, n: int = 1):
    match kind:
        case "ridge":
            return LinearRegression(labelCol="y", elasticNetParam=0.0, regParam=alpha / max(n, 1), solver="normal")
        case "forest":
            return RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)
        case "gbt":
            return GBTRegressor(labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    raise ValueError(kind)


def fit_predict(train: DataFrame, apply: DataFrame, features: Sequence[str], label: Column, estimator, id_col: str, scale: bool = False) -> DataFrame:
    """Id and ``score``: class shares as an array for a classifier, the prediction for a regressor."""
    model = Pipeline(stages=[*assemble(features, scale), estimator]).fit(train.withColumn("y", label.cast("double")))
    out = model.transform(apply)
    return out.select(id_col, vector_to_array("probability").alias("score") if "probability" in out.columns else F.col("prediction").alias("score"))


def ordinal_score(train: DataFrame, apply: DataFrame, features: Sequence[str], label: str, id_col: str, classes: int = 4, make: Callable[[int], object] = lambda seed: classifier("gbt", seed), seed: int = 42, bag: int = 1) -> DataFrame:
    """Expected class as the sum of P(label > k), each from a two-class model; averaged over ``bag`` seeds."""
    total = None
    for b in range(bag):
        for k in range(classes - 1):
            one = fit_predict(train, apply, features, F.col(label) > k, make(seed + 100 * b), id_col).select(id_col, F.get("score", F.lit(1)).alias("p"))
            total = one if total is None else total.unionByName(one)
    return total.groupBy(id_col).agg((F.sum("p") / bag).alias("score"))


def out_of_fold(df: DataFrame, fold: str, folds: int, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Scores of every row from models of the other folds."""
    parts = [score(df.where(F.col(fold) != k), df.where(F.col(fold) == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def repeated_scores(df: DataFrame, id_col: str, label: str, seeds: Iterable[int], folds: int, score: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """``seed``, id, ``score`` over several seeds' folds."""
    out = None
    for s in seeds:
        split = stratified_folds(df, id_col, label, folds, s)
        one = out_of_fold(split, "fold", folds, lambda a, b, s=s: score(a, b, s)).withColumn("seed", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return pin(out.select("seed", id_col, "score"))


def quartile_accuracy(scores: DataFrame, id_col: str, score: str, label: str, by: Sequence[str] = ("seed",), formula: str = "bin") -> DataFrame:
    """Accuracy of quartile labels of a score within groups."""
    ranked = with_ranks(scores, score, id_col, within=list(by))
    pick = quartile_bin if formula == "bin" else quartile_label
    return ranked.withColumn("__p", pick(F.col("r_first"), F.col("n_ranked"))).groupBy(*by).agg(F.avg((F.col("__p") == F.col(label)).cast("double")).alias("accuracy"))


def monotone_accuracy(scores: DataFrame, id_col: str, label: str, classes: int = 4) -> DataFrame:
    """For a long frame (feature, id, x, label): accuracy of quartile labels in the better direction."""
    ranked = with_ranks(scores.where(F.col("x").isNotNull()), "x", id_col, within=["feature"])
    p = quartile_label(F.col("r_first"), F.col("n_ranked"), classes)
    hit = lambda q: F.avg((q == F.col(label)).cast("double"))
    return ranked.withColumn("__p", p).groupBy("feature").agg(F.greatest(hit(F.col("__p")), hit(F.lit(classes - 1) - F.col("__p"))).alias("accuracy"))


def one_against_rest(train: DataFrame, apply: DataFrame, features: Sequence[str], label: str, id_col: str, classes: int = 4, make: Callable[[int], object] = lambda seed: classifier("gbt", seed), seed: int = 42) -> DataFrame:
    """Class shares ``score`` from a two-class model per class, brought to a sum of 1 (equal shares if all are 0).

    Makes a classifier of several classes out of boosted trees, which take two only. A class without a training row has share 0."""
    total = None
    for k in range(classes):
        if train.where(F.col(label) == k).isEmpty():
            one = apply.select(id_col, F.lit(k).alias("k"), F.lit(0.0).alias("p"))
        else:
            one = fit_predict(train, apply, features, F.col(label) == k, make(seed), id_col).select(id_col, F.lit(k).alias("k"), F.get("score", F.lit(1)).alias("p"))
        total = one if total is None else total.unionByName(one)
    shares = F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: s["p"])  # a row per class
    return total.groupBy(id_col).agg(shares.alias("s"), F.sum("p").alias("t")).select(id_col, F.transform("s", lambda p: F.when(F.col("t") > 0, p / F.col("t")).otherwise(F.lit(1.0 / classes))).alias("score"))


def family_rank_blend(scores: DataFrame, id_col: str, family: str, seed: str, score: str) -> DataFrame:
    """Mean over families of the z-score of ranks of each family's mean score over its seeds, ``blend`` per id."""
    means = scores.groupBy(id_col, family).agg(F.avg(score).alias("__m"))
    return rank_then_z(means, "__m", id_col, [family], name="__z").groupBy(id_col).agg(F.avg("__z").alias("blend"))


def expected_value(probabilities: Column) -> Column:
    return F.aggregate(F.transform(probabilities, lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)


def argmax(probabilities: Column) -> Column:
    """The first largest entry's place."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def one_hot(prediction: Column, classes: int) -> Column:
    """Class shares of a model that gives labels only."""
    return F.array(*[(prediction == c).cast("double") for c in range(classes)])


def soft_vote(probabilities: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of class shares."""
    weights = weights or [1.0] * len(probabilities)
    total = sum(weights)
    out = F.transform(probabilities[0], lambda x: x * F.lit(weights[0] / total))
    for p, w in zip(probabilities[1:], weights[1:]):
        out = _add(out, p, w / total)
    return out


def _add(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(weight))


def better_vote(df: DataFrame, equal: str, weighted: str, label: str) -> str:
    """Which of two columns of class shares is right more often; the equal one on ties."""
    row = df.agg(*[F.avg((argmax(F.col(c)) == F.col(label)).cast("double")).alias(c) for c in (equal, weighted)]).first()
    return weighted if row[weighted] > row[equal] else equal


def z_blend(df: DataFrame, columns: Sequence[str], weights: Sequence[float], within: Sequence[str]) -> Column:
    """Weighted mean of z-scores within groups."""
    terms = [F.lit(w / sum(weights)) * zscore_within(c, within) for c, w in zip(columns, weights)]
    return sum(terms[1:], terms[0])


def blend_subsets(df: DataFrame, id_col: str, columns: Sequence[str], label: str, sizes: Sequence[int] = (2, 3), within: Sequence[str] = ()) -> DataFrame:
    """Accuracy of the mean z-score of every subset of scores, all in one plan in long form."""
    within = list(within)
    base = df if within else df.withColumn("__all", F.lit(0))
    keys = within or ["__all"]
    z = base.withColumns({f"__z_{c}": zscore_within(c, keys) for c in columns})
    subsets = [s for k in sizes for s in combinations(columns, k)]
    mean = lambda s: F.round(sum((F.col(f"__z_{c}") for c in s[1:]), F.col(f"__z_{s[0]}")) / len(s), 9)
    long = z.select(*keys, id_col, label, F.explode(F.array(*[F.struct(F.lit("+".join(s)).alias("subset"), mean(s).alias("x")) for s in subsets])).alias("r")).select(*keys, id_col, label, "r.*")
    ranked = with_ranks(long, "x", id_col, within=[*keys, "subset"]).withColumn("__p", quartile_bin(F.col("r_first"), F.col("n_ranked")))
    return ranked.groupBy("subset").agg(F.avg((F.col("__p") == F.col(label)).cast("double")).alias("accuracy"))


def rank_blend_sweep(df: DataFrame, id_col: str, first: str, second: str, label: str, weights: Sequence[float]) -> DataFrame:
    """Accuracy of (1 - w) * rank(first) + w * rank(second) for each weight."""
    a = with_ranks(df.select(id_col, first, second, label), first, id_col).select(id_col, second, label, F.col("r_avg").alias("ra"))
    both = with_ranks(a, second, id_col).select(id_col, label, "ra", F.col("r_avg").alias("rb"))
    long = both.select(id_col, label, F.explode(F.array(*[F.struct(F.lit(float(w)).alias("w"), (F.col("ra") * F.lit(1 - w) + F.col("rb") * F.lit(w)).alias("x")) for w in weights])).alias("r")).select(id_col, label, "r.*")
    return quartile_accuracy(long, id_col, "x", label, by=["w"])


def nested_correction(df: DataFrame, id_col: str, features: Sequence[str], percentile: str, label: str, folds: int = 5, seed: int = 10042, alpha: float = 20.0, kind: str = "ridge") -> DataFrame:
    """Out-of-fold estimates of how far a percentile lies from the middle of the row's class, by ``ridge`` of ``alpha`` or by ``gbt``."""
    rows = stratified_folds(df.withColumn("residual", (F.col(label) + 0.5) / 4 - F.col(percentile)), id_col, label, folds, seed)
    n = rows.count()
    return out_of_fold(rows, "fold", folds, lambda a, b: fit_predict(a, b, features, F.col("residual"), regressor(kind, alpha=alpha, n=n), id_col, scale=True)).withColumnRenamed("score", "correction")


def correction_grid(df: DataFrame, id_col: str, features: Sequence[str], percentile: str, label: str, alphas: Sequence[float] = (1.0, 5.0, 20.0, 100.0), kinds: Sequence[str] = ("ridge", "gbt"), folds: int = 5, seed: int = 10042) -> DataFrame:
    """``nested_correction`` for every ridge ``alpha`` and for boosted trees: ``config``, id, ``correction``."""
    configs = [(f"ridge-{a:g}", "ridge", a) for a in alphas if "ridge" in kinds] + ([("gbt", "gbt", 0.0)] if "gbt" in kinds else [])
    out = None
    for name, kind, alpha in configs:
        one = nested_correction(df, id_col, features, percentile, label, folds, seed, alpha, kind).select(F.lit(name).alias("config"), id_col, "correction")
        out = one if out is None else out.unionByName(one)
    return out


def cluster(train: DataFrame, apply: DataFrame, features: Sequence[str], k: int, pca: int | None = None, seed: int = 42) -> DataFrame:
    """``apply`` with ``cluster`` from k-means on standardised features, or on their first components."""
    stages = assemble(features, scale=True)
    column = "features"
    if pca:
        stages.append(PCA(k=pca, inputCol="features", outputCol="components"))
        column = "components"
    stages.append(KMeans(k=k, featuresCol=column, predictionCol="cluster", seed=seed))
    return Pipeline(stages=stages).fit(train).transform(apply).drop("raw_features", "features", "components")


def cluster_majority_cv(df: DataFrame, id_col: str, features: Sequence[str], label: str, k: int, folds: int = 5, pca: int | None = None, seed: int = 42) -> DataFrame:
    """Out-of-fold labels by the majority of the row's cluster, or of all rows for clusters without any."""
    rows = stratified_folds(df, id_col, label, folds, seed)

    def one(train: DataFrame, held: DataFrame) -> DataFrame:
        both = cluster(train, train.withColumn("__t", F.lit(True)).unionByName(held.withColumn("__t", F.lit(False))), features, k, pca, seed)
        major = cluster_majority(both.where("__t"), "cluster", label).select("cluster", "majority")
        fallback = train.groupBy(label).count().orderBy(F.desc("count"), label).first()[0]
        return both.where(~F.col("__t")).join(major, "cluster", "left").select(id_col, F.coalesce("majority", F.lit(fallback)).alias("predicted"))

    return out_of_fold(rows, "fold", folds, one).join(df.select(id_col, label), id_col)


def permutation_importance(df: DataFrame, id_col: str, features: Sequence[str], model, label: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """Loss of squared correlation with the label when one feature's values are dealt anew.

    ``model`` maps a frame with the features to one with ``score``."""
    r2 = lambda frame: (frame.agg(safe_corr("score", label)).first()[0] or 0.0) ** 2
    base, rows = r2(model(df)), []
    numbered = with_positions(df, [id_col], "__i")
    for f in features:
        losses = []
        for k in range(repeats):
            other = with_positions(df.select(F.col(f), F.col(id_col).alias("__id"), draw(seed + k, id_col, F.lit(f)).alias("__draw")), ["__draw", "__id"], "__i").select(f, "__i")
            losses.append(base - r2(model(numbered.drop(f).join(other, "__i").drop("__i"))))
        rows.append((f, sum(losses) / repeats))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def linear_r2(df: DataFrame, features: Sequence[str], target: str) -> tuple[float, list[float]]:
    """R squared and coefficients of a least-squares fit."""
    data = Pipeline(stages=assemble(features)).fit(df).transform(df)
    model = LinearRegression(labelCol=target, featuresCol="features", solver="normal").fit(data)
    return float(model.summary.r2), [float(x) for x in model.coefficients]


def random_search(space: dict[str, Sequence], score: Callable[[dict, Sequence[int]], float], trials: int, tune_seeds: Sequence[int], held_seeds: Sequence[int], seed: int = 0) -> dict:
    """Best of seeded random draws from a space on the tuning seeds, with its score on the held-out ones."""
    import random

    r = random.Random(seed)
    tried = [{k: r.choice(list(v)) for k, v in space.items()} for _ in range(trials)]
    scored = [(score(t, tune_seeds), -i) for i, t in enumerate(tried)]
    best = tried[-max(scored)[1]]
    return {"params": best, "tune": max(scored)[0], "held_out": score(best, held_seeds)}


def grid_search(configs: Iterable[dict], score: Callable[[dict], float]) -> list[tuple[dict, float]]:
    """Configurations with their scores, best first."""
    return sorted(((c, score(c)) for c in configs), key=lambda x: -x[1])


def ablation(features: Sequence[str], extras: Sequence[str], score: Callable[[list[str]], float]) -> dict[str, float]:
    """How much each extra feature adds to the base set's score."""
    base = score(list(features))
    return {e: score([*features, e]) - base for e in extras}
