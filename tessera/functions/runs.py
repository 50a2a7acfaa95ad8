"""Runs, crossings, extrema and positions of one series per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A


def longest_run(a: Column, test: Callable[[Column], Column]) -> Column:
    """Most consecutive elements that pass ``test``."""
    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(test(x), s["now"] + 1).otherwise(F.lit(0).cast("long"))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(a, zero, step, lambda s: s["best"])


def longest_step_run(a: Column, sign: int) -> Column:
    """Most consecutive steps up (``sign`` 1) or down (-1)."""
    return longest_run(A.diff(a), lambda x: F.signum(x) == sign)


def step_run_asymmetry(a: Column) -> Column:
    return longest_step_run(a, 1) - longest_step_run(a, -1)


def longest_above_mean(a: Column) -> Column:
    return longest_run(A.centre(a), lambda x: x > 0)


def longest_above_median(a: Column) -> Column:
    return A.let(A.quantile(a, 0.5), lambda m: longest_run(a, lambda x: x > m))


def step_runs(a: Column) -> Column:
    """Runs of steps of one sign as structs ``sign``, ``length``; a zero step is a run of its own."""
    kind = "array<struct<sign:double,length:int>>"

    def step(s: Column, x: Column) -> Column:
        sign = F.signum(x)
        last = F.try_element_at(s, F.lit(-1))
        longer = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(sign.alias("sign"), (last["length"] + 1).alias("length"))))
        fresh = F.concat(s, F.array(F.struct(sign.alias("sign"), F.lit(1).alias("length"))))
        return F.when((last["sign"] == sign) & (sign != 0), longer).otherwise(fresh)

    return F.aggregate(A.diff(a), F.array().cast(kind), step)


def run_statistics(a: Column) -> dict[str, Column]:
    """Longest run up and down, number of runs and their mean length."""
    runs = step_runs(a)
    longest = lambda sign: F.coalesce(F.array_max(F.transform(F.filter(runs, lambda r: r["sign"] == sign), lambda r: r["length"])), F.lit(0)).cast("long")
    return {"longest_up": longest(1.0), "longest_down": longest(-1.0), "n_runs": F.size(runs).cast("long"), "mean_run": A.mean(F.transform(runs, lambda r: r["length"].cast("double")))}


def longest_monotone_run(a: Column) -> Column:
    """Longest run of steps of one sign that isn't zero, 1 at least."""
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(F.filter(step_runs(a), lambda r: r["sign"] != 0), lambda r: r["length"])), F.lit(1))).cast("long")


def _changes(signs: Column) -> Column:
    return A.let(signs, lambda s: A.count_if(F.zip_with(A.tail_from(s, 1), A.head(s, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, y: x != y), lambda c: c))


def turning_points(a: Column) -> Column:
    """Changes of the step's sign, zero being a sign of its own."""
    return _changes(F.transform(A.diff(a), F.signum))


def mean_crossings(a: Column, zero_is_positive: bool = True) -> Column:
    """Changes of the side of the mean; an element at the mean is above it, or a side of its own."""
    sign = (lambda x: F.when(x >= 0, 1.0).otherwise(-1.0)) if zero_is_positive else F.signum
    return _changes(F.transform(A.centre(a), sign))


def sign_changes(a: Column) -> Column:
    """Changes of the raw sign."""
    return _changes(F.transform(a, F.signum))


def mean_run_length(a: Column) -> Column:
    return A.length(a) / (mean_crossings(a) + 1)


def cycles(a: Column) -> Column:
    return mean_crossings(a) / F.lit(2.0)


def effective_period(a: Column) -> Column:
    return 2 * A.length(a) / (mean_crossings(a) + F.lit(1e-9))


def fraction_above_mean(a: Column) -> Column:
    return F.try_divide(A.count_if(A.centre(a), lambda x: x > 0), F.size(a))


def _triples(a: Column, test: Callable[[Column, Column, Column], Column]) -> Column:
    last = F.size(a) - 2
    return F.when(F.size(a) < 3, F.lit(0).cast("long")).otherwise(A.count_if(F.sequence(F.lit(1), last), lambda i: test(F.get(a, i - 1), F.get(a, i), F.get(a, i + 1))))


def local_maxima(a: Column) -> Column:
    return _triples(a, lambda x, y, z: (y > x) & (y > z))


def extrema_fraction(a: Column) -> Column:
    return F.try_divide(_triples(a, lambda x, y, z: ((y > x) & (y > z)) | ((y < x) & (y < z))), F.size(a))


def peak_position(a: Column, normalised: bool = True) -> Column:
    """Place of the first largest element, from 0 to 1 (or to the length less 1)."""
    at = (F.array_position(a, F.array_max(a)) - 1).cast("double")
    return F.try_divide(at, A.length(a) - 1) if normalised else at


def trough_position(a: Column, normalised: bool = True) -> Column:
    at = (F.array_position(a, F.array_min(a)) - 1).cast("double")
    return F.try_divide(at, A.length(a) - 1) if normalised else at
