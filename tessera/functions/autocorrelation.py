"""Autocorrelation, autoregression and coupling of two series per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A

SMALL = 1e-9


def lagged(a: Column, k: int) -> tuple[Column, Column]:
    """The series without its last ``k`` and without its first ``k`` elements."""
    return A.head(a, F.greatest(F.size(a) - k, F.lit(0))), A.tail_from(a, k)


def lag_dot(a: Column, k: int) -> Column:
    x, y = lagged(a, k)
    return A.dot(x, y)


def acf(a: Column, k: int, eps: float = SMALL) -> Column:
    """Autocorrelation at lag ``k`` over the whole series' variance."""
    return A.let(A.centre(a), lambda c: lag_dot(c, k) / (A.square_sum(c) + F.lit(eps)))


def acf_list(a: Column, lags: int, eps: float = SMALL) -> Column:
    """Autocorrelations at lags 1 to ``lags``."""
    return A.let(A.centre(a), lambda c: A.let(A.square_sum(c) + F.lit(eps), lambda v: F.array(*[lag_dot(c, k) / v for k in range(1, lags + 1)])))


def acf_pairwise(a: Column, k: int) -> Column:
    """Autocorrelation over the variances of the two overlapping parts."""

    def over(c: Column) -> Column:
        x, y = lagged(c, k)
        return A.dot(x, y) / (F.sqrt(A.square_sum(x) * A.square_sum(y)) + F.lit(SMALL))

    return A.let(A.centre(a), over)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two series; 0 where one has no spread."""
    return A.let(
        F.struct(A.centre(a).alias("a"), A.centre(b).alias("b")),
        lambda c: F.coalesce(F.try_divide(A.dot(c["a"], c["b"]), F.sqrt(A.square_sum(c["a"]) * A.square_sum(c["b"]))), F.lit(0.0)),
    )


def acf_pearson(a: Column, k: int) -> Column:
    """Correlation of the series with itself ``k`` later, each part centred by itself."""
    return pearson(*lagged(a, k))


def ar_no_intercept(a: Column, k: int = 1) -> Column:
    """Least-squares coefficient on the value ``k`` before, of the centred series."""
    return A.let(A.centre(a), lambda c: lag_dot(c, k) / (A.square_sum(lagged(c, k)[0]) + F.lit(SMALL)))


def ar_intercept(a: Column) -> Column:
    """Coefficient and innovation deviation of a first-order fit with intercept: ``coef``, ``innovation``."""

    def fit(p: Column) -> Column:
        coef = F.coalesce(F.try_divide(A.dot(p["x"], p["y"]), A.square_sum(p["x"])), F.lit(0.0))
        return A.let(coef, lambda b: F.struct(b.alias("coef"), A.std(F.zip_with(p["x"], p["y"], lambda x, y: y - b * x)).alias("innovation")))

    x, y = lagged(a, 1)
    return A.let(F.struct(A.centre(x).alias("x"), A.centre(y).alias("y")), fit)


def pacf(a: Column, eps: float = A.EPS) -> Column:
    """Partial autocorrelations at lags 1 to 3 by the Durbin-Levinson recursion, written out."""

    def recurse(r: Column) -> Column:
        r1, r2, r3 = (F.get(r, i) for i in range(3))
        second = A.let(F.array(r1, (r2 - r1 * r1) / (1 - r1 * r1 + F.lit(eps)), r3), lambda q: F.struct(F.get(q, 0).alias("p1"), F.get(q, 1).alias("p2"), (F.get(q, 0) - F.get(q, 1) * F.get(q, 0)).alias("f1"), F.get(q, 2).alias("r3")))
        return A.let(second, lambda s: F.array(s["p1"], s["p2"], (s["r3"] - s["f1"] * r2 - s["p2"] * r1) / (1 - s["f1"] * r1 - s["p2"] * r2 + F.lit(eps))))

    return A.let(acf_list(a, 3, eps), recurse)


def ar3(a: Column, ridge: float = SMALL) -> Column:
    """Third coefficient of a least-squares fit on the three values before, by Cramer's rule."""

    def solve(c: Column) -> Column:
        n = F.size(c) - 3
        lag = [F.slice(c, 4 - k, n) for k in range(4)]
        g = [[A.dot(lag[i], lag[j]) + (F.lit(ridge) if i == j else F.lit(0.0)) for j in (1, 2, 3)] for i in (1, 2, 3)]
        b = [A.dot(lag[0], lag[i]) for i in (1, 2, 3)]

        def cramer(v: Column) -> Column:
            m = [[F.get(v, 3 * i + j) for j in range(3)] for i in range(3)]
            r = [F.get(v, 9 + i) for i in range(3)]
            det = lambda x: x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0]) + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])
            return F.coalesce(F.try_divide(det([[m[i][0], m[i][1], r[i]] for i in range(3)]), det(m)), F.lit(0.0))

        return A.let(F.array(*[x for row in g for x in row], *b), cramer)

    return F.when(F.size(a) > 3, A.let(A.centre(a), solve)).otherwise(F.lit(0.0))


def resample(a: Column, n: int) -> Column:
    """The series at ``n`` evenly spaced places by linear interpolation."""
    at = lambda i: i.cast("double") * (A.length(a) - 1) / F.lit(float(max(n - 1, 1)))

    def value(i: Column) -> Column:
        lo = F.least(F.floor(at(i)).cast("int"), F.size(a) - 1)
        return F.get(a, lo) + (at(i) - lo) * (F.coalesce(F.get(a, lo + 1), F.get(a, lo)) - F.get(a, lo))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)


def cross(a: Column, b: Column, offset: int) -> Column:
    """Product sum of ``a`` and ``b`` moved by ``offset`` over the norms of both whole series."""
    x, y = (lagged(a, offset)[1], lagged(b, offset)[0]) if offset >= 0 else (lagged(a, -offset)[0], lagged(b, -offset)[1])
    return A.dot(x, y) / (F.sqrt(A.square_sum(a) * A.square_sum(b)) + F.lit(SMALL))


def cross_pearson(a: Column, b: Column, lag: int) -> Column:
    """Correlation of ``a`` with ``b`` ``lag`` later, each part centred by itself."""
    return pearson(lagged(a, lag)[0], lagged(b, lag)[1]) if lag >= 0 else pearson(lagged(a, -lag)[1], lagged(b, -lag)[0])


def lead_minus_lag(a: Column, b: Column, n: int = 12, offset: int = 1) -> Column:
    """How much more ``a`` follows ``b`` than leads it, both centred and brought to ``n`` places."""
    both = F.struct(resample(A.centre(a), n).alias("a"), resample(A.centre(b), n).alias("b"))
    return A.let(both, lambda s: cross(s["a"], s["b"], offset) - cross(s["a"], s["b"], -offset))


def coherence(a: Column, b: Column) -> Column:
    """Mean product of two series' own z-scores."""
    from .level import zscore

    return A.mean(F.zip_with(zscore(a), zscore(b), lambda x, y: x * y))


def gather_contrast(a: Column, b: Column, n: int = 3) -> Column:
    """Mean of ``b`` where ``a`` is among its ``n`` largest less where it is among its least."""
    pairs = F.sort_array(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    return A.let(pairs, lambda p: A.mean(F.transform(A.part(p, -n), lambda s: s["y"])) - A.mean(F.transform(A.part(p, 0, n), lambda s: s["y"])))
