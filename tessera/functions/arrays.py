"""Building blocks over ``array<double>`` columns.

An expression that is used inside a lambda is evaluated once per element; ``let`` binds
a value first, so what is computed from a whole array is computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
_names = iter(range(1 << 60))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def const(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.size(a).cast("double")


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(a), length(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def square_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def head(a: Column, n: Column | int) -> Column:
    return F.slice(a, 1, n)


def tail_from(a: Column, i: Column | int) -> Column:
    """Elements from position ``i`` (0-based) on."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.slice(a, i + 1, F.greatest(F.size(a) - i, F.lit(0)))


def part(a: Column, start: int, stop: int | None = None) -> Column:
    """``a[start:stop]`` with Python's rules for fixed bounds."""
    n = F.size(a)
    lo = F.greatest(n + start, F.lit(0)) if start < 0 else F.least(F.lit(start), n)
    hi = n if stop is None else F.greatest(n + stop, F.lit(0)) if stop < 0 else F.least(F.lit(stop), n)
    return F.slice(a, lo + 1, F.greatest(hi - lo, F.lit(0)))


def diff(a: Column) -> Column:
    """First differences; empty for fewer than two elements."""
    return F.zip_with(tail_from(a, 1), head(a, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def centre(a: Column) -> Column:
    return let(mean(a), lambda m: F.transform(a, lambda x: x - m))


def variance(a: Column, ddof: int = 0) -> Column:
    return let(centre(a), lambda c: F.try_divide(square_sum(c), length(c) - ddof))


def std(a: Column, ddof: int = 0) -> Column:
    return F.sqrt(variance(a, ddof))


def quantile(a: Column, p: float) -> Column:
    """Linear interpolation between order statistics."""

    def at(s: Column) -> Column:
        h = (length(s) - 1) * F.lit(float(p))
        lo = F.floor(h).cast("int")
        return F.get(s, lo) + (h - lo) * (F.coalesce(F.get(s, lo + 1), F.get(s, lo)) - F.get(s, lo))

    return let(F.sort_array(a), at)


def quantiles(a: Column, ps: Sequence[float], body: Callable[..., Column]) -> Column:
    """``body`` of several quantiles of the array, which is sorted once."""

    def spread(s: Column) -> Column:
        def one(p: float) -> Column:
            h = (length(s) - 1) * F.lit(float(p))
            lo = F.floor(h).cast("int")
            return F.get(s, lo) + (h - lo) * (F.coalesce(F.get(s, lo + 1), F.get(s, lo)) - F.get(s, lo))

        return let(F.array(*[one(p) for p in ps]), lambda q: body(*[F.get(q, i) for i in range(len(ps))]))

    return let(F.sort_array(a), spread)


def cumulate(a: Column) -> Column:
    """Running sums."""
    empty = F.array().cast("array<double>")
    return F.aggregate(a, empty, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + x)))


def positions(a: Column) -> Column:
    """0.0, 1.0, ... as long as the array."""
    return F.transform(a, lambda x, i: i.cast("double"))


def count_if(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, test)).cast("long")


def pack(*columns: Column | str) -> Column:
    """A series out of columns."""
    return F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns])
