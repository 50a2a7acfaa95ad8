"""Correlation screens, distribution shift and other audits.

Features are screened in long form (feature, id, value): ranks are taken within each feature, so
many features are many groups of one plan, not many windows of one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .cleaning import finite_or
from .ranks import exact_quantiles, same, with_ranks


def unpivot(df: DataFrame, id_cols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """A row per feature and row of ``df``: id columns, ``feature``, ``x`` (what isn't finite is null)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), finite_or(F.col(f), None).alias("x")) for f in features])
    return df.select(*id_cols, F.explode(pairs).alias("r")).select(*id_cols, "r.feature", "r.x")


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; 0 without spread or rows."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def with_average_ranks(df: DataFrame, columns: Mapping[str, str], within: Sequence[str]) -> DataFrame:
    """``df`` with ranks of ``columns`` (new name by column) within groups, ties at their mean.

    Ranks are taken one column after the other by ranges of group and value: no group is one task's."""
    for name, column in columns.items():
        # ids aren't needed, as ties share their rank; a hash of the row spreads a frequent value over ranges
        ranked = with_ranks(df.withColumn("__tie", F.xxhash64(*df.columns)), column, "__tie", within)
        df = ranked.withColumnRenamed("r_avg", name).drop("__tie", "r_first", "n_ranked", "r_pct", "r_mid")
    return df


def pearson_with(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of every feature with ``target``, in one pass."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), safe_corr(f, target).alias("r")) for f in features])
    return df.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("r")) for a in features for b in features])
    return df.agg(pairs.alias("p")).select(F.explode("p").alias("p")).select("p.*")


def spearman(long: DataFrame, target: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Rank correlation of ``x`` with ``target`` within groups of a long frame; 0 below three rows."""
    rows = long.where(F.col("x").isNotNull() & F.col(target).isNotNull())
    ranked = with_average_ranks(rows, {"__rx": "x", "__ry": target}, by)
    return ranked.groupBy(*by).agg(F.when(F.count("*") < 3, F.lit(0.0)).otherwise(safe_corr("__rx", "__ry")).alias("spearman"))


def partial(long: DataFrame, target: str, control: str, by: Sequence[str] = ("feature",), rerank_control: bool = True) -> DataFrame:
    """Correlation of the ranks of ``x`` and ``target`` with what ``control`` explains taken out of both.

    ``rerank_control`` takes the control's ranks too, else its values. Written with correlations of
    the three pairs, so one aggregate suffices."""
    rows = long.where(F.col("x").isNotNull() & F.col(target).isNotNull() & F.col(control).isNotNull())
    ranked = with_average_ranks(rows, {"__rx": "x", "__ry": target} | ({"__rc": control} if rerank_control else {}), by)
    ranked = ranked if rerank_control else ranked.withColumn("__rc", F.col(control).cast("double"))
    sums = ranked.groupBy(*by).agg(safe_corr("__rx", "__ry").alias("xy"), safe_corr("__rx", "__rc").alias("xc"), safe_corr("__ry", "__rc").alias("yc"))
    left = F.sqrt((1 - F.col("xc") * F.col("xc")) * (1 - F.col("yc") * F.col("yc")))
    value = F.when((1 - F.col("xc") * F.col("xc") < 1e-12) | (1 - F.col("yc") * F.col("yc") < 1e-12), 0.0).otherwise(F.try_divide(F.col("xy") - F.col("xc") * F.col("yc"), left))
    return sums.select(*by, F.coalesce(value, F.lit(0.0)).alias("partial"))


def partial_of_many(long: DataFrame, target: str, controls: Sequence[str], by: Sequence[str] = ("feature",)) -> DataFrame:
    """The same with several controls, taken out one after the other."""
    names = {"x": "x", "y": target} | {f"c{i}": c for i, c in enumerate(controls)}
    rows = long.where(" and ".join(f"`{c}` is not null" for c in names.values()))
    ranked = with_average_ranks(rows, {f"__{k}": c for k, c in names.items()}, by)
    keys = list(names)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    r = ranked.groupBy(*by).agg(*[safe_corr(f"__{a}", f"__{b}").alias(f"{a}_{b}") for a, b in pairs])

    def given(a: str, b: str, left: Sequence[str]) -> Column:
        if not left:
            return F.col(f"{a}_{b}" if (a, b) in pairs else f"{b}_{a}")
        c, rest = left[-1], left[:-1]
        ab, ac, bc = given(a, b, rest), given(a, c, rest), given(b, c, rest)
        return F.coalesce(F.try_divide(ab - ac * bc, F.sqrt((1 - ac * ac) * (1 - bc * bc))), F.lit(0.0))

    return r.select(*by, given("x", "y", keys[2:]).alias("partial"))


def partial_of_two(long: DataFrame, target: str, controls: tuple[str, str], by: Sequence[str] = ("feature",)) -> DataFrame:
    return partial_of_many(long, target, controls, by)


def partial_of_fits(long: DataFrame, target: str, control: str, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Pearson correlation of the residuals of straight-line fits of ``x`` and ``target`` on ``control``, values as they are."""
    rows = long.where(F.col("x").isNotNull() & F.col(target).isNotNull() & F.col(control).isNotNull())
    fits = rows.groupBy(*[F.col(k).alias(f"__k_{k}") for k in by]).agg(*[f(*c).alias(n) for n, f, c in (("__bx", F.regr_slope, ("x", control)), ("__ax", F.regr_intercept, ("x", control)), ("__by", F.regr_slope, (target, control)), ("__ay", F.regr_intercept, (target, control)))])
    joined = rows.join(fits, same(rows, fits, by))
    left = joined.withColumns({"__rx": F.col("x") - F.col("__ax") - F.col("__bx") * F.col(control), "__ry": F.col(target) - F.col("__ay") - F.col("__by") * F.col(control)})
    return left.groupBy(*by).agg(safe_corr("__rx", "__ry").alias("partial"))


def screen(df: DataFrame, id_col: str, features: Sequence[str], target: str, control: str, least: float = 0.04, prefilter: float = 0.0, rerank_control: bool = True) -> DataFrame:
    """Spearman and partial correlation per feature, ``flag`` where the partial one reaches ``least``.

    Features whose Spearman correlation isn't above ``prefilter`` are left out first."""
    long = unpivot(df, [id_col, target, control], features)
    first = spearman(long, target).where(F.abs("spearman") > prefilter) if prefilter else spearman(long, target)
    both = first.join(partial(long, target, control, rerank_control=rerank_control), "feature")
    return both.withColumn("flag", F.abs("partial") >= least)


def hash_fold(id_col: str, folds: int, seed: int | str = 0) -> Column:
    """A fold from the first digits of an MD5 of id and seed."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def stability(df: DataFrame, id_col: str, features: Sequence[str], target: str, control: str, folds: int = 2, seed: int = 0) -> DataFrame:
    """Partial correlation per feature and fold."""
    long = unpivot(df.withColumn("fold", hash_fold(id_col, folds, seed)), [id_col, target, control, "fold"], features)
    return partial(long, target, control, by=("feature", "fold"))


def same_sign(stable: DataFrame) -> DataFrame:
    """Whether a feature's sign is the same in all folds."""
    return stable.groupBy("feature").agg((F.min(F.signum("partial")) == F.max(F.signum("partial"))).alias("same_sign"), F.avg("partial").alias("mean_partial"))


def smd(train: Sequence[Column], test: Sequence[Column], toward: str = "test") -> Column:
    """Standardised difference of two (mean, population variance) pairs: test less train, or the other
    way ``toward`` train. 0 where there is no spread."""
    (m0, v0), (m1, v1) = train, test
    d = F.try_divide(m1 - m0, F.sqrt((v0 + v1) / 2))
    return F.coalesce(d if toward == "test" else -d, F.lit(0.0))


def risk(psi_value: Column | None, abs_smd: Column) -> Column:
    """high from 0.25 (PSI) or 0.5 (SMD), medium from 0.1 or 0.25, else low."""
    high, medium = abs_smd >= 0.5, abs_smd >= 0.25
    if psi_value is not None:
        high, medium = high | (psi_value >= 0.25), medium | (psi_value >= 0.1)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def shift_moments(long: DataFrame, is_test: Column) -> DataFrame:
    """Means, variances, SMD and quantile differences (test less train) per feature of a long frame."""
    train, test = F.when(~is_test, F.col("x")), F.when(is_test, F.col("x"))
    rows = long.groupBy("feature").agg(F.avg(train).alias("m0"), F.var_pop(train).alias("v0"), F.avg(test).alias("m1"), F.var_pop(test).alias("v1"))
    for name, part in (("q0", ~is_test), ("q1", is_test)):
        rows = rows.join(exact_quantiles(long.where(part), [0.1, 0.5, 0.9]).select("feature", F.col("q").alias(name)), "feature", "left")
    c = F.col
    deltas = [(F.get("q1", F.lit(i)) - F.get("q0", F.lit(i))).alias(f"q{p}_delta") for i, p in enumerate((10, 50, 90))]
    return rows.select("feature", c("m0").alias("train_mean"), c("m1").alias("test_mean"), smd((c("m0"), c("v0")), (c("m1"), c("v1"))).alias("smd"), *deltas)


def psi(long: DataFrame, is_test: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index per feature: shares of train and test among the train's quantile bins.

    Bins are (a, b], open at both ends; equal edges are one. With two edges or fewer the range is cut
    evenly. 0 for constant or empty features."""
    rows = long.withColumn("t", is_test).where(F.col("x").isNotNull())
    cuts = exact_quantiles(rows.where("not t"), [i / bins for i in range(bins + 1)]).select("feature", F.array_sort(F.array_distinct("q")).alias("e"))
    edges = rows.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).join(cuts, "feature")
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins)
    edges = edges.where("lo < hi and e is not null").withColumn("e", F.when(F.size("e") > 2, F.col("e")).otherwise(even))
    inner = F.slice("e", 2, F.size("e") - 2)
    placed = rows.join(F.broadcast(edges.select("feature", inner.alias("inner"))), "feature")  # a row per feature
    placed = placed.withColumn("bin", F.size(F.filter("inner", lambda e: e < F.col("x"))))
    counts = placed.groupBy("feature", "bin").agg(F.count_if(~F.col("t")).alias("n0"), F.count_if(F.col("t")).alias("n1"), F.first(F.size("inner") + 1).alias("b"))
    sums = counts.groupBy("feature").agg(F.collect_list(F.struct("n0", "n1")).alias("c"), F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.first("b").alias("b"))
    share = lambda n, t: F.greatest(F.coalesce(F.try_divide(n, t), F.lit(0.0)), F.lit(floor))
    term = lambda p, q: (q - p) * F.ln(q / p)
    value = F.aggregate("c", F.lit(0.0), lambda s, x: s + term(F.when(x["n0"] > 0, share(x["n0"], F.col("t0"))).otherwise(F.lit(floor)), F.when(x["n1"] > 0, share(x["n1"], F.col("t1"))).otherwise(F.lit(floor))))
    found = sums.where("t0 > 0 and t1 > 0").select("feature", value.alias("psi"))
    return long.select("feature").distinct().join(found, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def shift_table(df: DataFrame, features: Sequence[str], is_test: Column, bins: int = 10) -> DataFrame:
    """PSI, SMD, quantile differences and risk per feature, the largest PSI first, then the largest SMD, then by name."""
    long = unpivot(df.withColumn("__t", is_test), ["__t"], features)
    both = shift_moments(long, F.col("__t")).join(psi(long, F.col("__t"), bins), "feature")
    return both.withColumn("risk", risk(F.col("psi"), F.abs("smd"))).orderBy(F.desc("psi"), F.desc(F.abs("smd")), "feature")


def transfer(scores: DataFrame, id_col: str, seed: str, base: str, extra: str, label: str, alphas: Sequence[float]) -> DataFrame:
    """For each seed the weight of ``extra`` that is best on the other seeds' mean score, and its accuracy there.

    Scores are z-scored within seeds; quartile labels in order of the sum are compared with ``label``; the first of
    equally good weights counts."""
    from .ranks import quartile_label, zscore_within

    spark = scores.sparkSession
    z = scores.withColumns({"__b": zscore_within(base, [seed]), "__e": zscore_within(extra, [seed])})
    seeds = z.select(F.col(seed).alias("held")).distinct()
    grid = spark.createDataFrame([(float(a), i) for i, a in enumerate(alphas)], "alpha double, ord int")
    others = z.join(F.broadcast(seeds), F.col(seed) != F.col("held")).groupBy("held", id_col).agg(F.avg("__b").alias("__b"), F.avg("__e").alias("__e"), F.first(label).alias(label))
    own = z.withColumn("held", F.col(seed)).select("held", id_col, "__b", "__e", label)

    def score(rows: DataFrame) -> DataFrame:
        rows = rows.crossJoin(F.broadcast(grid)).withColumn("__s", F.round(F.col("__b") + F.col("alpha") * F.col("__e"), 9))
        w = W.partitionBy("held", "alpha")
        label_of = quartile_label(F.row_number().over(w.orderBy("__s", id_col)), F.count("*").over(w))
        return rows.withColumn("__l", label_of).groupBy("held", "alpha", "ord").agg(F.avg((F.col("__l") == F.col(label)).cast("double")).alias("accuracy"))

    best = score(others).groupBy("held").agg(F.max_by("alpha", F.struct("accuracy", -F.col("ord"))).alias("alpha"))
    return best.join(score(own).drop("ord"), ["held", "alpha"])


def quantiles(df: DataFrame, column: str, ps: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, a row each."""
    got = exact_quantiles(df.select(F.lit(0).alias("feature"), F.col(column).alias("x")), ps)
    return got.select(F.posexplode("q").alias("i", "value")).select(F.get(F.array(*[F.lit(float(p)) for p in ps]), F.col("i")).alias("p"), "value")


def top_by_magnitude(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    return df.orderBy(F.abs(column).desc(), name).limit(n)
