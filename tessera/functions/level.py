"""Level, dispersion, order statistics and shape of one series per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A


def slope(a: Column) -> Column:
    """Least-squares slope against positions 0, 1, ...; null for fewer than two elements."""
    return A.let(A.centre(A.positions(a)), lambda t: F.try_divide(A.dot(A.centre(a), t), A.square_sum(t)))


def detrend(a: Column) -> Column:
    """Residuals of the straight line."""
    return A.let(F.struct(A.mean(a).alias("m"), slope(a).alias("b"), ((A.length(a) - 1) / 2).alias("t")), lambda k: F.transform(a, lambda x, i: x - k["m"] - k["b"] * (i - k["t"])))


def amplitude(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)


def iqr(a: Column) -> Column:
    return A.quantiles(a, (0.25, 0.75), lambda q25, q75: q75 - q25)


def last_minus_first(a: Column) -> Column:
    return F.get(a, F.size(a) - 1) - F.get(a, F.lit(0))


def half(a: Column) -> Column:
    return F.floor(F.size(a) / 2).cast("int")


def late_minus_early(a: Column) -> Column:
    """Mean of the second half less that of the first (the shorter, if the length is odd)."""
    return A.mean(A.tail_from(a, half(a))) - A.mean(A.head(a, half(a)))


def abs_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def abs_mean(a: Column) -> Column:
    return F.try_divide(abs_sum(a), A.length(a))


def summary(a: Column, ddof: int = 0, full: bool = False) -> dict[str, Column]:
    """Named statistics of a series: 14, or 21 with ``full``. ``ddof`` is that of ``std``; differences
    always have the population's."""
    d = A.diff(a)
    out = {"mean": A.mean(a), "std": A.std(a, ddof), "min": F.array_min(a), "max": F.array_max(a), "range": amplitude(a), "median": A.quantile(a, 0.5)}
    if full:
        out |= {"q25": A.quantile(a, 0.25), "q75": A.quantile(a, 0.75)}
    out["iqr"] = iqr(a)
    if full:
        out |= {"first": F.get(a, F.lit(0)), "last": F.get(a, F.size(a) - 1)}
    out["last_minus_first"] = last_minus_first(a)
    if full:
        out |= {"early_mean": A.mean(A.head(a, half(a))), "late_mean": A.mean(A.tail_from(a, half(a)))}
    out["late_minus_early"] = late_minus_early(a)
    if full:
        out["diff_mean"] = A.mean(d)
    return out | {"diff_std": A.std(d), "diff_abs_mean": abs_mean(d), "positive_steps": A.count_if(d, lambda x: x > 0), "negative_steps": A.count_if(d, lambda x: x < 0), "slope": slope(a)}


def cumulative(a: Column) -> dict[str, Column]:
    """Range, population deviation, maximum and minimum of the running sum."""
    c = A.cumulate(a)
    return {"cum_range": A.let(c, amplitude), "cum_std": A.let(c, A.std), "cum_max": F.array_max(c), "cum_min": F.array_min(c)}


def drawdown(a: Column) -> Column:
    """Deepest fall of the running sum below its highest value so far; ``final`` and ``peak`` beside it."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, x: Column) -> Column:
        now = s["sum"] + x
        peak = F.greatest(s["peak"], now)
        return F.struct(now.alias("sum"), peak.alias("peak"), F.greatest(s["worst"], peak - now).alias("worst"))

    return F.aggregate(a, zero, step)


def trimmed_mean(a: Column, each_side: int = 1) -> Column:
    """Mean without the ``each_side`` least and largest; the plain mean if nothing would be left."""
    inner = A.let(F.sort_array(a), lambda s: A.mean(A.part(s, each_side, -each_side)))
    return F.when(F.size(a) <= 2 * each_side, A.mean(a)).otherwise(inner)


def mad(a: Column) -> Column:
    """Median distance from the median."""
    return A.let(A.quantile(a, 0.5), lambda m: A.quantile(F.transform(a, lambda x: F.abs(x - m)), 0.5))


def quantile_spread(a: Column, low: float = 0.1, high: float = 0.9) -> Column:
    return A.quantiles(a, (low, high), lambda x, y: y - x)


def bowley_skew(a: Column) -> Column:
    return A.quantiles(a, (0.25, 0.5, 0.75), lambda x, y, z: (z + x - 2 * y) / (z - x + F.lit(A.EPS)))


def _standard_moment(a: Column, k: int) -> Column:
    return A.let(A.centre(a), lambda c: A.mean(F.transform(c, lambda x: F.pow(x, F.lit(k)))) / F.pow(F.sqrt(A.mean(F.transform(c, lambda x: x * x))) + F.lit(A.EPS), F.lit(k)))


def skew(a: Column) -> Column:
    return _standard_moment(a, 3)


def kurtosis(a: Column) -> Column:
    """Excess kurtosis of the population."""
    return _standard_moment(a, 4) - 3


def skew_corrected(a: Column) -> Column:
    """Skewness with the finite-sample factor; null below three elements, 0 without spread."""
    n = A.length(a)
    return F.when(F.size(a) < 3, None).otherwise(F.sqrt(n * (n - 1)) / (n - 2) * skew(a))


def kurtosis_corrected(a: Column) -> Column:
    """Excess kurtosis with the finite-sample factor; null below four elements."""
    n = A.length(a)
    return F.when(F.size(a) < 4, None).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurtosis(a) + 6))


def spikes(a: Column, digits: int | None = None) -> Column:
    """How many elements lie above median plus interquartile range, which is rounded to ``digits`` if given:
    of two elements the larger lies on it."""
    limit = A.quantiles(a, (0.25, 0.5, 0.75), lambda x, y, z: y + z - x)
    return A.let(limit if digits is None else F.round(limit, digits), lambda t: A.count_if(a, lambda x: x > t))


def segment_mean(a: Column, start: int, stop: int | None = None) -> Column:
    return A.mean(A.part(a, start, stop))


def curvature(a: Column, middle: tuple[int, int] = (4, 8), first: int = 4) -> Column:
    """Last four less twice the middle plus the first, as means."""
    return segment_mean(a, -4) - 2 * segment_mean(a, *middle) + segment_mean(a, 0, first)


def volatility_ratio(a: Column) -> Column:
    """Sample deviation of the second half over that of the first; 0 if the first has none."""
    return F.coalesce(F.try_divide(A.std(A.tail_from(a, half(a)), 1), A.std(A.head(a, half(a)), 1)), F.lit(0.0))


def zscore(a: Column) -> Column:
    """Each element's distance from the mean in deviations; a deviation below 1e-9 counts as 1."""
    return A.let(F.struct(A.mean(a).alias("m"), A.std(a).alias("s")), lambda k: F.transform(a, lambda x: (x - k["m"]) / F.when(k["s"] < 1e-9, 1.0).otherwise(k["s"])))


def roughness(a: Column) -> Column:
    """Mean size of second differences over the deviation."""
    return abs_mean(A.diff(A.diff(a))) / (A.std(a) + F.lit(A.EPS))


def difference_variance_ratio(a: Column) -> Column:
    return A.variance(A.diff(a)) / (A.variance(a) + F.lit(A.EPS))


def mobility(a: Column) -> Column:
    return F.sqrt(difference_variance_ratio(a) + F.lit(A.EPS))


def complexity(a: Column) -> Column:
    """Mobility of the differences over that of the series."""
    return mobility(A.diff(a)) / (mobility(a) + F.lit(A.EPS))


def gini_of_steps(a: Column) -> Column:
    """Gini coefficient of absolute differences."""

    def over(s: Column) -> Column:
        n = A.length(s)
        return A.total(F.transform(s, lambda x, i: (2 * (i + 1) - n - 1) * x)) / (n * A.total(s) + F.lit(A.EPS))

    return A.let(F.sort_array(F.transform(A.diff(a), F.abs)), over)
